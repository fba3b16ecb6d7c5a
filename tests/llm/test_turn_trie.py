"""The trie of conversations against brute force and on the odd cases."""

import hashlib
import math
import random
import zlib

import pytest

from pairspace.llm import turn_trie


def brute(rows, span=100, openings=6):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(ts)] for c, ts in convs.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % openings
        # the remainder has the sign of c, as in SQL
        base = c - int(math.copysign(abs(c) % span, c))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def found(spark, rows, parts=5, **more):
    made = spark.createDataFrame([(*r, "mine", 1) for r in rows], "c long, n int, who string, said string, depth string, n_convs int").repartition(parts)
    got = turn_trie.conversation_trie(made, "c", "n", "who", "said", **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 1), (2, 7), (3, 40), (4, 100_000)])
def test_against_brute_force(spark, seed, shard_turns):
    rng = random.Random(seed)
    rows = []
    for c in [*range(130), *range(480, 500), 700, 10_000_000_000, -3]:
        if c == 400 or rng.random() < 0.1:
            continue
        alike = rng.random() < 0.5
        for n in range(rng.randrange(1, 9)):
            rows.append((c, n, "user" if n % 2 else "assistant", f"turn {n}" if alike else "éa" * rng.randrange(3)))
    rows += [(7, None, None, None), (7, None, "user", None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 1, "user", "lost")]
    rows += [(200 + i, 0, "user", "the same") for i in range(40)] + [(240 + i, k, "user", "long " * 900) for i in range(3) for k in range(60)]
    rng.shuffle(rows)
    assert found(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_few_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []
    assert found(spark, [(1, 1, None, None)]) == brute([(1, 1, None, None)])
    # conversation 1 takes its opening from 0, which is absent, and has no turns of its own left
    assert zlib.crc32(b"1") % 6 > 0 and found(spark, [(1, 1, "a", "b")])[0][:2] == (1, 0)
    rows = [(c, n, "u", "x" * n) for c in (5, 6) for n in range(3)]
    assert found(spark, rows, span=1, openings=1) == brute(rows, 1, 1)


def test_tree_is_balanced():
    tree = turn_trie.TernaryTree()
    ends = tree.insert_sorted([[i] for i in range(1023)])
    assert len(set(ends)) == 1023

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.less[node]), height(tree.more[node]))

    assert height(tree.child[0]) == 10
