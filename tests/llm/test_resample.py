"""Importance resampling against brute force and on the odd cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pairspace.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, aims, largest, buckets, least, share, seed):
    def found(text):
        w = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(w[i : i + n]) for n in range(1, largest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    source, target = [0] * buckets, [0] * buckets
    every = [(i, *found(t)) for i, t in docs]
    for _, _, bs in every:
        for b in bs:
            source[b] += 1
    for t in aims:
        for b in found(t)[1]:
            target[b] += 1
    s, t = sum(source), sum(target)
    gain = [math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(source, target, strict=True)]
    rows = []
    for i, n, bs in every:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = share[0] * len(able) // share[1]
    ranks = {id(r): k for k, r in enumerate(able[:drawn], 1)}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("largest", [1, 2, 3])
def test_against_brute_force(spark, largest):
    rng = random.Random(largest)
    words = ["wort", "Über", "x1", "naïve", "A", "b", "long" * 30, "漢字", "é"]
    said = [" .,\n"[rng.randrange(4)].join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    docs = [*enumerate(said), (500, None), (501, ""), (502, "same words " * 12), (503, "same words " * 12), (504, "Lang und länger " * 60_000), (None, "a b c")]
    aims = [*said[:20], None, ""]
    made = spark.createDataFrame([(i, t, "mine", "x") for i, t in docs], "key long, body string, score string, n_words string").repartition(7)
    target = spark.createDataFrame([(t,) for t in aims], "text string")
    got = resample.resample(made, "key", "body", target, "text", largest, 97, 5, (30, 100), 7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, aims, largest, 97, 5, (30, 100), 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "d e f g")], "doc_id long, text string")
    assert resample.resample(none, "doc_id", "text", some, "text").collect() == []
    got = resample.resample(some, "doc_id", "text", none, "text", min_words=1, share=(100, 100))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(1, "a b c d"), (1, "a b c d"), (2, "d e f g")], [], 1, 10_000, 1, (100, 100), 2024)


def test_joined_checksums_and_forgotten_words():
    rng = random.Random(3)
    parts = [(bytes(rng.randrange(256) for _ in range(rng.randrange(50))), bytes(rng.randrange(256) for _ in range(n))) for n in [*range(70), 5_000, 70_000]]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    joined = resample.joined_crc(first, second, np.array([len(b) for _, b in parts]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in parts]
    scanner = resample.WordScanner(kept=5)
    for text in (b"a b c", b"d e f g h i j", b"a b", b"", b"k l a"):
        counts, crc, length = scanner.payloads([text, None])
        assert crc.tolist() == [zlib.crc32(w) for w in text.split()] and counts.tolist() == [len(text.split()), 0]
