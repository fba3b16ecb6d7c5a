"""Near-duplicate documents: a join on the Jaccard similarity of word shingles by token-combination prefixes.

Tokens are hashes of shingles. In an order that is the same for all sets, two sets that are similar
enough share tokens in their prefixes: one in the shortest sufficient prefix, k more if the prefix is k tokens
longer. That is used twice.

1. A cheap order (by hash) over all sets: a set stays a candidate only if enough tokens of its prefix occur in
   another set at all. Most sets of a corpus end here.
2. The order by frequency over the candidates, rare tokens first. A prefix is extended by G tokens, and frequent tokens are dealt
   into G classes: of G + 1 shared tokens either one is rare, or two are frequent and of one class. Rare tokens are
   indexed one by one, frequent ones as pairs within their class. G grows with the size of the sets, so the number of pairs stays
   in proportion to it.

Sets with equal indices are verified. Within an index entry the most central set is verified against all
others first; links found that way join components, and only sets of different components are
compared further, so a large group of copies costs its size, not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.plans.storage import materialise

from .components import components
from .rows import col, map_rows

SHINGLE = 5
# similarity of at least PART / WHOLE
PART, WHOLE = 75, 100
# tokens of at most so many candidates are indexed by themselves
RARE = 64
# text hashed at once
CHUNK_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE, np.uint64)]), dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit tokens of each text: ``size`` words in a row, or all words of a shorter text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for text in texts:
        # ASCII letters lowered, words between ASCII white space
        part.append(b" ".join((text or b"").lower().split()))
        held += len(part[-1])
        if held >= CHUNK_BYTES:
            out += _chunk_sets(part, size)
            part, held = [], 0
    return out + _chunk_sets(part, size) if part else out


def _chunk_sets(joined: list[bytes], size: int) -> list[np.ndarray]:
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in joined])
    data = np.frombuffer(b" ".join(t for t in joined if t) + b" ", np.uint8)
    if not counts.any():
        return [np.empty(0, np.int64) for _ in joined]
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts
    places = np.arange(len(data)) - np.repeat(starts, lengths + 1)
    with np.errstate(over="ignore"):
        values = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()) + 1)[places]
        values[ends] = 0
        words = _mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _STEPS[4])
        sums = np.zeros(len(words), np.uint64)
        for j in range(min(size, len(words))):
            sums[: len(words) - j] += words[j:] * (_STEPS[j % 5] + np.uint64(2 * (j // 5)))
    out, at = [], 0
    for n in counts.tolist():
        if n == 0:
            out.append(np.empty(0, np.int64))
            continue
        if n >= size:
            tokens = sums[at : at + n - size + 1]
        else:
            with np.errstate(over="ignore"):
                tokens = np.array([sum((words[at + j] * _STEPS[j % 5] for j in range(n)), np.uint64(n))], np.uint64)
        out.append(np.unique(_mix(tokens).view(np.int64)))
        at += n
    return out


def least_overlap(n: int, part: int = PART, whole: int = WHOLE) -> int:
    """Tokens that a set of n shares with any set similar to it."""
    return -(-part * n // whole)


SUMMARY = T.StructType().add("n", "long").add("d1", "long").add("d2", "long")


def _summaries(docs: DataFrame, size: int, part: int, whole: int, with_prefix: bool) -> DataFrame:
    """``id, n, d1, d2`` (size and digest of the set) and, if asked for, ``prefix`` in the order of hashes."""
    extra = [T.StructField("prefix", T.ArrayType(T.LongType()))] if with_prefix else []

    def start() -> Callable[..., list[list]]:
        def work(texts: list) -> list[list]:
            sets = shingle_sets(texts, size)
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() for s in sets]
            out = [[len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests]]
            if with_prefix:
                # copies: a view would keep the memory of the whole set
                out.append([s[: prefix_length(len(s), part, whole)].copy() for s in sets])
            return out

        return work

    return map_rows(docs, ["text"], T.StructType([*SUMMARY, *extra]), start, ["id"])


def spare(n: int) -> int:
    """Tokens by which the first prefix is longer than needed: so many more must be shared."""
    return n // 12


def prefix_length(n: int, part: int, whole: int) -> int:
    return n - least_overlap(n, part, whole) + 1 + spare(n) if n else 0


def _candidates(docs: DataFrame, size: int, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """All documents as ``id, n, d1, d2``, and the distinct sets that may have a partner as ``cid, n, d1, d2``."""
    members = materialise(_summaries(docs, size, part, whole, False), "jaccard-members")
    prefixes = _summaries(docs, size, part, whole, True).select("n", "d1", F.explode("prefix").alias("token"))
    shared = (
        prefixes.groupBy("token").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high").select("token")
    )
    shared = materialise(shared, "jaccard-shared")
    # equal sets have equal rows here: count tokens, not rows
    enough = prefixes.join(shared, "token").groupBy("d1", "n").agg(F.count_distinct("token").alias("hits"))
    # a partner may be as small as the least overlap, and its prefix is then longer by less
    smallest = F.expr(f"(n * {part} + {whole - 1}) div {whole}")
    enough = enough.filter(F.col("hits") > F.floor(smallest / 12)).select("d1").distinct()
    classes = members.filter("n > 1").groupBy("d1", "d2").agg(F.min("id").alias("cid"), F.first("n").alias("n"))
    return members, materialise(classes.filter("cid is not null").join(enough, "d1", "left_semi"), "jaccard-candidates")


def _shared_tokens(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``cid, n, s, tokens, dfs, common``: of each candidate the tokens that others have too, rare ones first."""

    def start() -> Callable[..., list[list]]:
        def work(texts: list) -> list[list]:
            sets = shingle_sets(texts, size)
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() for s in sets]
            return [[d[0] for d in digests], [d[1] for d in digests], sets]

        return work

    ids = chosen.select(F.col("cid").alias("id"))
    added = T.StructType().add("d1", "long").add("d2", "long").add("set", T.ArrayType(T.LongType()))
    sets = map_rows(docs.join(ids, "id", "left_semi"), ["text"], added, start, ["id"])
    tokens = (
        sets.withColumnRenamed("id", "cid").join(chosen, ["cid", "d1", "d2"]).select("cid", "n", F.explode("set").alias("token"))
    )
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    counted = tokens.join(counts, "token").groupBy("cid", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("t"))
    counted = counted.select("cid", "n", F.size("t").cast("bigint").alias("s"), F.col("t.token").alias("tokens"), F.col("t.df").alias("dfs"))
    # how common the tokens of a set are: the original of a group of copies has the most common ones
    return counted.withColumn("common", F.aggregate("dfs", F.lit(0.0), lambda a, x: a + x) / F.col("n"))


def _indices(candidates: DataFrame, part: int, whole: int) -> DataFrame:
    """``sig, cid, n, s, common, bits``: rare tokens of the extended prefixes, and pairs of frequent ones of one class."""

    def start() -> Callable[..., list[list]]:
        def indices(n: int, s: int, tokens: np.ndarray, dfs: np.ndarray) -> np.ndarray:
            found = []
            needed = least_overlap(n, part, whole)
            # the bucket of the larger of two similar sets is one of these
            for bucket in range(n.bit_length() - 1, (whole * n // part).bit_length()):
                classes = max(1, 2**bucket // 8)
                length = n - needed + 1 + classes - (n - s)
                if length <= classes:
                    continue
                taken, rare = tokens[:length], dfs[:length] <= RARE
                with np.errstate(over="ignore"):
                    tag = np.uint64(bucket + 1) * _BASE
                    found.append(_mix(taken[rare] ^ tag))
                    often = np.sort(taken[~rare])
                    kind = often % np.uint64(classes)
                    order = np.argsort(kind, kind="stable")
                    often, kind = often[order], kind[order]
                    for d in range(1, len(often)):
                        same = kind[d:] == kind[:-d]
                        if not same.any():
                            break
                        found.append(_mix(_mix(often[:-d][same] ^ tag) + often[d:][same]))
            return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)

        def parities(tokens: np.ndarray) -> list[int]:
            """Of each of 256 places whether an odd number of tokens falls there, as four integers."""
            odd = np.bincount((_mix(tokens) % np.uint64(256)).astype(np.int64), minlength=256) & 1
            return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()

        def work(n: list, s: list, tokens: list, dfs: list) -> list[list]:
            tokens = [np.array(c, np.int64).view(np.uint64) for c in tokens]
            sigs = [
                indices(a, b, c, np.array(d, np.int64)).view(np.int64) for a, b, c, d in zip(n, s, tokens, dfs, strict=True)
            ]
            return [sigs, [parities(c) for c in tokens]]

        return work

    longs = T.ArrayType(T.LongType())
    added = T.StructType().add("sigs", longs).add("bits", longs)
    made = map_rows(candidates, ["n", "s", "tokens", "dfs"], added, start, ["cid", "n", "s", "common"])
    return made.select(F.explode("sigs").alias("sig"), "cid", "n", "s", "common", "bits")


def _possible(one: dict[str, str], other: dict[str, str], part: int, whole: int) -> Column:
    """Whether two sets can have enough tokens in common.

    Each place where the parities of their shared tokens differ stands for a token that only one of them has.
    """
    n, m, s, t = F.col(one["n"]), F.col(other["n"]), F.col(one["s"]), F.col(other["s"])
    differ = sum((F.bit_count(F.col(one["bits"])[i].bitwiseXOR(F.col(other["bits"])[i])) for i in range(4)), F.lit(0))
    common = F.least(s, t, F.floor((s + t - differ) / 2))
    return common * (part + whole) >= (n + m) * part


def _verified(pairs: DataFrame, candidates: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    one = candidates.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    two = candidates.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter(both * whole >= (F.col("n_a") + F.col("n_b") - both) * part).select("a", "b")


def _links(candidates: DataFrame, part: int, whole: int) -> DataFrame:
    """Links ``a, b`` that connect exactly the similar candidates (not all of their pairs)."""
    entries = _indices(candidates, part, whole)
    central = F.struct("common", (-F.col("cid")).alias("order"), "cid", "n", "s", "bits")
    heads = entries.groupBy("sig").agg(F.count("*").alias("k"), F.max(central).alias("head")).filter("k > 1")
    entries = materialise(entries.join(heads.select("sig", "head"), "sig"), "jaccard-entries")
    flat = entries.select("sig", "cid", "n", "s", "bits", F.col("head.cid").alias("head"), F.col("head").alias("h"))
    own, heads_own = ({k: f"{of}{k}" for k in ("n", "s", "bits")} for of in ("", "h."))
    first = flat.filter("cid <> head").filter(_possible(own, heads_own, part, whole))
    first = first.select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b")).distinct()
    tested = materialise(first, "jaccard-pairs")
    links = materialise(_verified(tested, candidates, part, whole), "jaccard-links")

    label = components(links)
    named = flat.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("of", F.coalesce("component", "cid"))
    head_of = label.select(F.col("node").alias("head"), F.col("component").alias("head_component"))
    named = named.join(head_of, "head", "left").withColumn("head_of", F.coalesce("head_component", "head"))
    named = materialise(named.select("sig", "cid", "n", "s", "bits", "of", "head_of"), "jaccard-named")
    # where all of an entry are of the head's component nothing is left
    apart = named.filter("of <> head_of")
    rest = apart.alias("x").join(named.alias("y"), F.col("x.sig") == F.col("y.sig"))
    left, right = ({k: f"{of}.{k}" for k in ("n", "s", "bits")} for of in "xy")
    rest = rest.filter((F.col("x.of") != F.col("y.of")) & _possible(left, right, part, whole))
    rest = rest.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    rest = rest.join(tested, ["a", "b"], "left_anti")
    return links.unionByName(materialise(_verified(rest, candidates, part, whole), "jaccard-links"))


def near_duplicates(
    docs: DataFrame, key: str, text: str, size: int = SHINGLE, part: int = PART, whole: int = WHOLE
) -> DataFrame:
    """``key, n_shingles, component_id`` for every row: two texts are linked from a similarity of ``part / whole`` on.

    ``key`` is an integer. ``component_id`` is the smallest key that is reached by links, or the row's own. A text without
    words (or null) has no shingles and is linked with nothing. Equal sets are one class with the smallest of its keys; copies never
    meet as pairs. Repeated rows give a row each; rows of one key with different texts count as one document where components
    are concerned. Rows with a null key get the component of their class if it has keys, else null. An empty table gives
    an empty result.
    """
    docs = docs.select(col(key).cast("bigint").alias("id"), col(text).alias("text"))
    members, chosen = _candidates(docs, size, part, whole)
    least = F.expr(f"(n * {part} + {whole - 1}) div {whole}")
    candidates = materialise(_shared_tokens(docs, chosen, size).filter(F.col("s") >= least), "jaccard-tokens")
    label = materialise(components(_links(candidates, part, whole)), "jaccard-components")
    classes = members.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("cid"))
    named = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    joined = members.join(named.select("d1", "d2", "component"), ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
