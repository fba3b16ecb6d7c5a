"""Repeated byte strings across documents, from longest-previous-factor arrays.

Every string of ``length`` bytes (a window) belongs to one anchor: the smallest hash among its ``GRAM``-byte pieces
(the leftmost of equals). Equal windows have equal anchors, so windows are compared only with those of their own anchor. Neighbouring windows of a text
with one anchor are kept together as one short stretch. Anchors that occur once are dropped,
equal stretches are counted instead of compared, and only the different stretches of an anchor meet in one
place, where their suffixes are sorted: previous and next smaller positions in suffix order give for each position the longest
factor that occurs earlier, and reversed the longest that occurs later. An anchor with too many different stretches
for that is divided by the hashes of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.plans.storage import materialise

from .rows import col, map_rows

LENGTH = 200
GRAM = 64
# different stretches of one anchor whose suffixes are sorted together
TOGETHER = 3_000
# stretches that one task gets at a time
BUCKET = 8_000
# bytes of texts hashed at once; longer texts are cut with overlaps
SEGMENT = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
# bits of a place inside a segment
PLACE = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)
    return _POWERS[base][:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Hashes:
    """Rolling hashes of all pieces of some bytes."""

    def __init__(self, data: bytes) -> None:
        n = len(data)
        with np.errstate(over="ignore"):
            values = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, n + 1)

    def every(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def stretches(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, digest, start, run``: ``run`` windows from ``start`` on have the anchor, ``digest`` is that of all their bytes."""
    found: list[tuple[np.ndarray, ...]] = []
    for offset in range(0, len(data) - length + 1, SEGMENT):
        part = data[offset : offset + SEGMENT + length - 1]
        hashes = Hashes(part)
        grams = hashes.every(gram)
        # the place in the low bits: of equal hashes the leftmost counts, and another occurrence is another stretch
        packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchors = _sliding_least(packed, length - gram + 1)
        start = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        run = np.diff(np.append(start, len(anchors)))
        anchor = grams[(anchors[start] & PLACE).astype(np.int64)].view(np.int64)
        found.append((anchor, hashes.spans(start, start + run + length - 1).view(np.int64), start + offset, run))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def previous_and_next_factors(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """For each position the longest prefix of its key that a key at an earlier position starts with, and at a later one.

    The positions are put in the order of their keys (a suffix array to the depth of the keys) with the common
    prefixes of neighbours. A stack finds the previous and the next smaller (or larger) position in that order,
    with the least common prefix on the way to them, and the longer of the two is the answer.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    shared = [0] * len(order)
    for i in range(1, len(order)):
        shared[i] = _common(keys[order[i - 1]], keys[order[i]])
    return _factors(order, order, shared), _factors(order, [-p for p in order], shared)


def _factors(order: list[int], rank: list[int], shared: list[int]) -> list[int]:
    out = [0] * len(order)
    # positions that still wait for their next smaller one, and the common prefix with the one below
    ranks: list[int] = []
    waiting: list[int] = []
    below: list[int] = []
    for p, r, common in zip(order, rank, shared, strict=True):
        while ranks and r < ranks[-1]:
            ranks.pop()
            at = waiting.pop()
            if common > out[at]:
                out[at] = common
            under = below.pop()
            if under < common:
                common = under
        if ranks:
            out[p] = common
        ranks.append(r)
        waiting.append(p)
        below.append(common)
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


TEXT_KEY = ["d1", "d2"]
RUN = T.StructType().add("a", "integer").add("b", "integer")
FOUND = T.StructType().add("anchor", "long").add("digest", "long").add("runs", T.ArrayType(RUN))


def _digest(data: bytes) -> list[int]:
    return np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist()


def _summaries(docs: DataFrame) -> DataFrame:
    """``id, n_bytes, sha, d1, d2`` of every row."""
    added = T.StructType().add("n_bytes", "long").add("sha", "string").add("d1", "long").add("d2", "long")

    def start() -> Callable[..., list[list]]:
        def work(texts: list) -> list[list]:
            texts = [t or b"" for t in texts]
            digests = [_digest(t) for t in texts]
            return [[len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts], [d[0] for d in digests], [d[1] for d in digests]]

        return work

    return map_rows(docs, ["text"], added, start, ["id"])


def _anchors(docs: DataFrame, length: int, gram: int, with_place: bool) -> DataFrame:
    """Of every stretch of every row its anchor, and the place it has in its text (equal texts have equal places) or the text's digest."""
    item = T.StructType().add("anchor", "long").add("place", "long")

    def start() -> Callable[..., list[list]]:
        def work(texts: list) -> list[list]:
            anchors, places, first, second = [], [], [], []
            for t in texts:
                d1, d2 = _digest(t or b"")
                m, _, at, _ = stretches(t or b"", length, gram)
                if with_place:
                    with np.errstate(over="ignore"):
                        place = _mix(at.astype(np.uint64) * np.uint64(_BASE) + np.array([d1], np.int64).view(np.uint64)).view(np.int64)
                    places.append(place)
                else:
                    m = np.unique(m)
                anchors.append(m)
                first.append(d1)
                second.append(d2)
            return [anchors, places] if with_place else [anchors, first, second]

        return work

    longs = T.ArrayType(T.LongType())
    if with_place:
        added = T.StructType().add("anchor", longs).add("place", longs)
        zipped = F.explode(F.arrays_zip("anchor", "place")).alias("z")
        return map_rows(docs, ["text"], added, start, []).select(zipped).select("z.anchor", "z.place")
    added = T.StructType().add("anchor", longs).add("d1", "long").add("d2", "long")
    return map_rows(docs, ["text"], added, start, []).select(F.explode("anchor").alias("anchor"), "d1", "d2")


def _spots(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``d1, d2, id, anchor, digest, start, run`` of all stretches of the stored texts."""
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    added = T.StructType().add("anchor", longs).add("digest", longs).add("start", ints).add("run", ints)

    def start() -> Callable[..., list[list]]:
        return lambda data: [list(x) for x in zip(*(stretches(d, length, gram) for d in data), strict=True)] if data else [[], [], [], []]

    made = map_rows(texts, ["data"], added, start, [*TEXT_KEY, "id"])
    zipped = F.explode(F.arrays_zip("anchor", "digest", "start", "run")).alias("z")
    return made.select(*TEXT_KEY, "id", zipped).select(*TEXT_KEY, "id", "z.*")


def _compare_suffixes(length: int, keep_first: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of each stretch the runs of windows that another stretch of its anchor has as well (earlier, if the first is to stay)."""

    def compare(bucket: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for anchor, group in bucket.groupby("anchor", sort=False):
            group = group.sort_values(["id", "start"])
            keys: list[bytes] = []
            for data, run in zip(group["data"], group["run"], strict=True):
                data = bytes(data)
                keys += [data[i : i + length] for i in range(run)]
            before, after = previous_and_next_factors(keys)
            flags = np.array(before) >= length
            if not keep_first:
                flags |= np.array(after) >= length
            at = 0
            for digest, run in zip(group["digest"], group["run"], strict=True):
                runs = _runs(flags[at : at + run])
                at += run
                if runs:
                    rows.append((anchor, digest, [{"a": a, "b": b} for a, b in runs]))
        return pd.DataFrame(rows, columns=["anchor", "digest", "runs"])

    return compare


def _compare_windows(hot: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for anchors with very many stretches: windows meet by their hashes, summed up before they are shuffled."""

    def start() -> Callable[..., list[list]]:
        return lambda data, run: [[Hashes(d).every(length)[:r].view(np.int64) for d, r in zip(data, run, strict=True)]]

    windows = map_rows(hot, ["data", "run"], T.StructType().add("h", T.ArrayType(T.LongType())), start, ["anchor", "digest", "id", "start"])
    windows = windows.select("anchor", "digest", "id", "start", F.posexplode("h").alias("at", "h"))
    place = F.struct("id", (F.col("start") + F.col("at")).alias("start"))
    counts = windows.groupBy("anchor", "h").agg(F.count("*").alias("k"), F.min(place).alias("first")).filter("k > 1")
    hits = windows.join(counts, ["anchor", "h"])
    if keep_first:
        hits = hits.filter(place > F.col("first"))
    hits = hits.groupBy("anchor", "digest").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("runs"))
    return hits


def find_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH, keep_first: bool = False, gram: int = GRAM) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row.

    Texts are UTF-8 bytes. Removed is every byte covered by a string of ``length`` bytes that also starts anywhere
    else, in another row or in the same one; with ``keep_first``, only where it started earlier (rows in the order of
    ``key``), so that one copy stays. Strings are judged on the input. ``spans`` are the maximal removed runs (end exclusive).

    Null and empty texts, and texts shorter than ``length``, lose nothing. Rows are documents: a repeated row is a copy. Copies of
    a whole text are counted, not compared; with ``keep_first`` the row with the smallest key keeps its text (of rows that
    share that key, all do; a null key counts as largest). An empty table gives an empty result.
    """
    docs = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    members = materialise(_summaries(docs), "repeat-members")
    anchors = _anchors(docs, length, gram, True).groupBy("anchor").agg(F.min("place").alias("p"), F.max("place").alias("q"))
    shared = materialise(anchors.filter("p <> q").select("anchor"), "repeat-anchors")
    touched = _anchors(docs, length, gram, False).join(shared, "anchor", "left_semi").select(*TEXT_KEY).distinct()
    classes = members.groupBy(*TEXT_KEY).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = materialise(classes.join(touched.withColumn("touched", F.lit(True)), TEXT_KEY, "left"), "repeat-classes")

    chosen = classes.filter("touched").select("id", *TEXT_KEY)
    keyed = docs.join(chosen.select("id").distinct(), "id", "left_semi")
    # texts of which no copy has a key
    data = _with_digest(keyed.unionByName(docs.filter("id is null"))).join(chosen.withColumnRenamed("id", "of"), TEXT_KEY)
    data = data.filter(F.col("id").eqNullSafe(F.col("of"))).drop("of").dropDuplicates(TEXT_KEY)
    texts = materialise(data, "repeat-texts")

    spots = materialise(_spots(texts, length, gram).join(shared, "anchor", "left_semi"), "repeat-spots")
    kinds = spots.groupBy("anchor", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "start", "run", *TEXT_KEY)).alias("first")
    )
    many = kinds.groupBy("anchor").agg(F.count("*").alias("k"))
    kinds = materialise(kinds.join(many, "anchor"), "repeat-kinds")
    wanted = kinds.filter("k > 1").select("anchor", "digest", "k", "first.*")
    cut = F.substring("data", F.col("start") + 1, F.col("run") + (length - 1))
    fetched = wanted.join(texts.select(*TEXT_KEY, "data"), TEXT_KEY).select("anchor", "digest", "k", "id", "start", "run", cut.alias("data"))
    fetched = materialise(fetched, "repeat-stretches")
    cold = fetched.filter(F.col("k") <= TOGETHER)
    buckets = max(1, -(-cold.count() // BUCKET))
    by_suffix = (
        cold.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        .groupBy("bucket").applyInPandas(_compare_suffixes(length, keep_first), FOUND)
    )
    by_window = _compare_windows(fetched.filter(F.col("k") > TOGETHER), length, keep_first)
    found = materialise(by_suffix.unionByName(by_window), "repeat-found")

    # where each stretch of each text loses what: whole stretches that are repeated, and runs of the others
    known = spots.join(kinds.select("anchor", "digest", "n", "first"), ["anchor", "digest"]).join(found, ["anchor", "digest"], "left")
    later = F.struct("id", "start", "run", *TEXT_KEY) != F.col("first")
    whole = (F.col("n") > 1) & (later if keep_first else F.lit(True))
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("run").alias("b")))
    lost = known.select(*TEXT_KEY, "start", F.explode(F.when(whole, every).otherwise(F.col("runs"))).alias("r"))
    lost = lost.select(*TEXT_KEY, F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b")).alias("span"))
    gathered = lost.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_list("span")).alias("spans"))
    cuts = _cut(texts.join(gathered, TEXT_KEY))

    rows = members.join(classes.select(*TEXT_KEY, "copies", F.col("id").alias("rep")), TEXT_KEY).join(cuts, TEXT_KEY, "left")
    copied = F.col("copies") > 1
    if keep_first:
        copied &= ~F.col("id").eqNullSafe(F.col("rep"))
    all_gone = copied & (F.col("n_bytes") >= length)
    one = F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b")))
    return rows.select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(all_gone, one).otherwise(F.coalesce("merged", F.array().cast("array<struct<a:int,b:int>>"))).alias("spans"),
    )


def _with_digest(docs: DataFrame) -> DataFrame:
    added = T.StructType().add("d1", "long").add("d2", "long").add("data", "binary")

    def start() -> Callable[..., list[list]]:
        def work(texts: list) -> list[list]:
            digests = [_digest(t) for t in texts]
            return [[d[0] for d in digests], [d[1] for d in digests], texts]

        return work

    return map_rows(docs, ["text"], added, start, ["id"])


def _cut(texts: DataFrame) -> DataFrame:
    """``d1, d2, n_removed, n_spans, kept_sha, merged`` from texts and the sorted spans that they lose."""
    added = T.StructType().add("n_removed", "long").add("n_spans", "long").add("kept_sha", "string").add("merged", T.ArrayType(RUN))

    def start() -> Callable[..., list[list]]:
        def work(data: list, spans: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            for d, given in zip(data, spans, strict=True):
                merged: list[list[int]] = []
                for s in given:
                    if merged and s["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["b"])
                    else:
                        merged.append([s["a"], s["b"]])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(d[at:a])
                    at = b
                kept.update(d[at:])
                row = (sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"a": a, "b": b} for a, b in merged])
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            return out

        return work

    return map_rows(texts, ["data", "spans"], added, start, TEXT_KEY)
