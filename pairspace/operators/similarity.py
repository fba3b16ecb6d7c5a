"""Similarities and distances between sparse vectors in long form."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.numbering import dense_ids
from ..plans.skew import PAIR_CHUNK, gather, shared_group_pairs
from ..plans.storage import materialise

SLACK = 1e-9


# pairs formed by one task, and entries of a vector beyond which its pairs are divided
TASK_PAIRS, LONG_VECTOR = 4_000_000, 10_000


def met_pairs(members: DataFrame, key: str, row: list[str], col: list[str], chunk: int = PAIR_CHUNK) -> DataFrame:
    """Pairs of vectors, ``row >= col``, one for each feature that they share: ``row, _share, col, hi_*, lo_*``.

    ``members`` is stored and holds ``key``, ``idx`` and the columns that ``row`` and ``col`` name, which come as ``hi_*`` of ``row`` and
    ``lo_*`` of ``col``. All pairs of one ``row`` and ``_share`` are in one task, and ``_share`` follows from ``row`` and ``col``.

    The members of a feature travel to each of its vectors as arrays of at most about ``chunk``, and the pairs are formed after that
    shuffle: a pair costs what it says of ``col``, and nothing is summed, sorted or stored before. The tasks are so many that
    each forms about ``TASK_PAIRS`` pairs; the pairs of a vector with many entries are divided by the hash of ``col``.
    """
    members = members.filter(F.col(key).isNotNull() & F.col("idx").isNotNull())
    groups = members.groupBy("idx").agg(F.count("*").cast("double").alias("d"))
    n_pairs = groups.agg(F.sum(F.col("d") * (F.col("d") + 1) / 2)).first()[0] or 0
    session = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(session, math.ceil(n_pairs / TASK_PAIRS))
    others = gather(members, ["idx"], F.struct(F.col(key).alias("col"), *[F.col(c).alias(f"lo_{c}") for c in col]), F.col(key), "others", chunk)
    lengths = members.groupBy(key).agg(F.ceil(F.count("*") / F.lit(LONG_VECTOR)).cast("int").alias("_shares"))
    rows = members.join(lengths, key).select(
        F.col(key).alias("row"), "idx", *[F.col(c).alias(f"hi_{c}") for c in row], "_shares", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")
    )
    # arrays of plain numbers are shuffled in much less room than arrays of structs
    parts = ["col", *[f"lo_{c}" for c in col]]
    flat = others.select("idx", *[F.col(f"others.{c}").alias(c) for c in parts])
    # sorted by col: the lower ones come first
    n_lower = F.size(F.filter("col", lambda c: c <= F.col("row")))
    dealt = rows.join(flat, "idx").withColumn("_n", n_lower).filter("_n > 0")
    dealt = dealt.select("row", "_share", "_shares", *[f"hi_{c}" for c in row], *[F.slice(c, 1, F.col("_n")).alias(c) for c in parts])
    dealt = dealt.repartition(tasks, "row", "_share")
    mine = (F.col("_shares") == 1) | (F.pmod(F.xxhash64("o.col"), F.col("_shares")) == F.col("_share"))
    met = dealt.select("row", "_share", "_shares", *[f"hi_{c}" for c in row], F.explode(F.arrays_zip(*parts)).alias("o")).filter(mine)
    return met.select("row", "_share", *[f"hi_{c}" for c in row], *[f"o.{c}" for c in parts])


def candidate_pairs(vectors: DataFrame, key: str = "id", chunk: int = PAIR_CHUNK) -> DataFrame:
    """Distinct ``(row, col)`` with ``row >= col`` that share a feature; each vector with itself."""
    members = materialise(vectors.select(key, "idx"), "pair-members")
    return met_pairs(members, key, [], [], chunk).groupBy("row", "_share", "col").agg(F.lit(1)).select("row", "col")


def _cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a dot product and two lengths; two zero vectors count as equal."""
    below = F.greatest(norm_a * norm_b, dot)
    return F.when((below == 0) & (dot == 0), F.lit(1.0)).otherwise(F.try_divide(dot, below))


def cosine_distances(
    vectors: DataFrame,
    key: str = "id",
    value: str = "value",
    skip_value: float | None = 1.0,
    offset: float = 0.0,
    drop_last_index: bool = False,
    chunk: int = PAIR_CHUNK,
) -> DataFrame:
    """Lower triangle, with diagonal, of ``1 - cosine``: ``(row, col, distance)``.

    Pairs that share no feature are absent; a distance that, with ``offset``
    added, equals ``skip_value`` exactly is dropped. ``drop_last_index``
    ignores the values at indexes from the number of distinct indexes on,
    while the pairs that they connect stay.

    The dot products are summed straight from the inverted index, by the tasks that
    form the pairs: see :func:`met_pairs`. Lengths come with ``row``, and
    by a join for ``col``.
    """
    # the joins below infer these filters; alike everywhere, they let exchanges be reused
    known = vectors.filter(F.col(key).isNotNull() & F.col("idx").isNotNull())
    entries = known.select(key, "idx", F.col(value).cast("double").alias("v"))
    if drop_last_index:
        cardinality = entries.agg(F.count_distinct("idx")).scalar()
        entries = entries.withColumn("v", F.when(F.col("idx") >= cardinality, 0.0).otherwise(F.col("v")))
    norms = materialise(entries.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")), "norms")
    members = materialise(entries.join(norms, key), "pair-members")
    paired = met_pairs(members, key, ["v", "norm"], ["v"], chunk)
    sums = paired.groupBy("row", "_share", "col").agg(F.sum(F.col("hi_v") * F.col("lo_v")).alias("dot"), F.max("hi_norm").alias("hi_norm"))
    # one number a vector, mostly small enough for Spark to send it to all tasks
    dots = sums.join(norms.select(F.col(key).alias("col"), F.col("norm").alias("lo_norm")), "col")
    cos = _cosine(F.col("dot"), F.col("hi_norm"), F.col("lo_norm"))
    distances = dots.select("row", "col", (F.lit(1.0) - cos + F.lit(offset)).alias("distance"))
    return distances if skip_value is None else distances.filter(F.col("distance") != skip_value)


def matrix_stats(vectors: DataFrame, distances: DataFrame, key: str = "id") -> DataFrame:
    """One row: numbers of features, of vectors and of matrix entries.

    Each number is counted by itself: two distinct counts in one pass would double the rows and group them by both columns.
    """
    features, keys = (vectors.select(c).distinct().agg(F.count(c).alias(n)) for c, n in (("idx", "n_features"), (key, "n_pairs")))
    return features.withColumn("n_pairs", keys.scalar()).withColumn("n_entries", distances.agg(F.count("*")).scalar())


def pair_similarity(
    pairs: DataFrame,
    vectors: DataFrame,
    how: str = "overlap",
    left: str = "left",
    right: str = "right",
    key: str = "key",
    idx: str = "idx",
    value: str = "value",
) -> DataFrame:
    """Similarity of given pairs of vectors: adds ``similarity``.

    ``how`` is ``overlap`` (number of shared features), ``dot`` or
    ``cosine``. Pairs without a shared feature get 0, pairs of which one
    vector does not exist get null.
    """
    if how not in ("overlap", "dot", "cosine"):
        raise ValueError("how must be 'overlap', 'dot' or 'cosine'")
    ids = pairs.select(left, right).distinct()
    lengths = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    a = vectors.select(F.col(key).alias(left), F.col(idx).alias("i"), F.col(value).alias("a"))
    b = vectors.select(F.col(key).alias(right), F.col(idx).alias("i"), F.col(value).alias("b"))
    # merged, as both grow with the corpus: a broadcast would go whole through the driver
    shared = (
        ids.join(a.hint("merge"), left)
        .join(b.hint("merge"), [right, "i"])
        .groupBy(left, right)
        .agg(F.count("*").cast("double").alias("overlap"), F.sum(F.col("a") * F.col("b")).alias("dot"))
    )
    both = (
        ids.join(lengths.select(F.col(key).alias(left), F.col("norm").alias("norm_l")).hint("merge"), left)
        .join(lengths.select(F.col(key).alias(right), F.col("norm").alias("norm_r")).hint("merge"), right)
        .join(shared.hint("merge"), [left, right], "left")
    )
    score = {
        "overlap": F.coalesce("overlap", F.lit(0.0)),
        "dot": F.coalesce("dot", F.lit(0.0)),
        "cosine": F.coalesce(F.try_divide("dot", F.col("norm_l") * F.col("norm_r")), F.lit(0.0)),
    }[how]
    return pairs.join(both.select(left, right, score.alias("similarity")).hint("merge"), [left, right], "left")


def equal_vectors(vectors: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """``(key, first)``: for each vector the smallest key whose vector has the same entries.

    A vector is known by its number of entries and two 64-bit digests of the set of them, so nothing is collected.
    """
    digests = [F.bit_xor(F.xxhash64(F.lit(seed), "idx", value)).alias(f"d{seed}") for seed in (1, 2)]
    known = vectors.groupBy(key).agg(F.count("*").alias("n"), *digests)
    first = known.groupBy("n", "d1", "d2").agg(F.min(key).alias("first"))
    return known.join(first, ["n", "d1", "d2"]).select(key, "first")


def _unit_entries(vectors: DataFrame, key: str, value: str) -> DataFrame:
    known = vectors.filter(F.col(key).isNotNull() & F.col("idx").isNotNull()).select(key, "idx", F.col(value).cast("double").alias("v")).filter("v <> 0")
    norms = known.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return known.join(norms, key).select(key, "idx", (F.col("v") / F.col("norm")).alias("v"))


def indexed_entries(unit: DataFrame, min_similarity: float, key: str = "id") -> DataFrame:
    """``key, idx, v, rare, left``: of each vector of length 1 the entries by which a similar one can find it.

    The features are ordered from the most common to the rarest. The entries before the place where a vector's part reaches the length
    ``min_similarity`` are left out: that part's product with any vector of length 1 is smaller. So the rarest
    feature that two similar vectors share is among the indexed entries of both. ``left`` is the squared length of what is left
    out, ``rare`` the place of the first indexed feature in the order.
    """
    common = unit.groupBy("idx").agg(F.count("*").alias("df"))
    placed = unit.join(common, "idx").withColumn("at", F.struct((-F.col("df")).alias("df"), "idx"))
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("so_far", F.sum(F.col("v") * F.col("v")).over(so_far))
    # rounding must not lose an entry
    kept = summed.filter(F.col("so_far") >= min_similarity * min_similarity - SLACK)
    first = kept.groupBy(key).agg(F.min(F.struct("at", (F.col("so_far") - F.col("v") * F.col("v")).alias("left"))).alias("f"))
    return kept.join(first, key).select(key, "idx", "v", F.col("f.at").alias("rare"), F.greatest("f.left", F.lit(0.0)).alias("left"))


# of a vector in blocks: features with a column of their own, and columns that the others share; vectors of a block, and rows multiplied at once
OWN, SHARED, BLOCK, ROWS_AT_ONCE = 512, 1024, 20_000, 2_048
# members of an indexed feature beyond which its vectors are compared in blocks
CROWD = 16
# above what products of 32-bit numbers of length 1 can lose by rounding
ROUNDING = 2e-4


def _compare_block(min_similarity: float, key: str, out: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Pairs of the vectors of two blocks, or of one with itself, at or above ``min_similarity``: ``a, b, similarity``."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["entries"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        nums, vals = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("num", "v"))
        of_block = table["block"].to_numpy()
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        left, right = np.flatnonzero(of_block == first), np.flatnonzero(of_block == second)

        def places(rows: np.ndarray) -> np.ndarray:
            n = lengths[rows]
            return np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())

        def bounds(rows: np.ndarray) -> np.ndarray:
            # common features by themselves, the length of what each group of others holds: the product is never too small
            at, owner = places(rows), np.repeat(np.arange(len(rows)), lengths[rows])
            num, v = nums[at], vals[at]
            own = num < OWN
            cell = owner * (OWN + SHARED) + np.where(own, num, OWN + num % SHARED)
            m = np.sqrt(np.bincount(cell, weights=v * v, minlength=len(rows) * (OWN + SHARED))).astype(np.float32)
            m[cell[own]] = v[own]
            return m.reshape(len(rows), OWN + SHARED)

        line = np.zeros(int(nums.max()) + 1)
        found = []
        for i in range(0, len(left), ROWS_AT_ONCE):
            mine = left[i : i + ROWS_AT_ONCE]
            told = bounds(mine)
            for j in range(i if first == second else 0, len(right), ROWS_AT_ONCE):
                theirs = right[j : j + ROWS_AT_ONCE]
                x, y = np.nonzero(told @ bounds(theirs).T >= min_similarity - ROUNDING)
                if first == second and i == j:
                    x, y = x[x < y], y[x < y]
                ends = np.flatnonzero(np.diff(x, append=-1)) + 1
                for begin, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True) if len(x) else ():
                    one, others = mine[x[begin]], theirs[y[begin:end]]
                    its = slice(starts[one], starts[one] + lengths[one])
                    line[nums[its]] = vals[its]
                    at = places(others)
                    dots = np.add.reduceat(line[nums[at]] * vals[at], np.cumsum(lengths[others]) - lengths[others])
                    line[nums[its]] = 0.0
                    near = dots >= min_similarity
                    found.append((np.full(near.sum(), one), others[near], dots[near]))
        a, b, dots = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.array([], int), np.array([], int), np.array([]))
        ids = table[key]
        return pa.Table.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(dots)], names=["a", "b", "similarity"]).cast(out)

    return compare


def _similar_in_blocks(unit: DataFrame, members: DataFrame, n: int, min_similarity: float, key: str, block: int) -> DataFrame:
    """``(row, col, similarity)`` of the similar pairs among the ``n`` vectors ``members`` (``key``).

    Features are numbered from the most common on. Every vector meets every other one, so the work grows with the square of ``n``, but nothing is
    stored per pair: a task holds two blocks of vectors, multiplies short dense forms of them that bound the product from
    above, and computes the product of the pairs that are left. Each vector travels once to each block.
    """
    spark = unit.sparkSession
    blocks = max(math.ceil(n / block), min(n, math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    entries = unit.join(members, key, "left_semi")
    shared = entries.groupBy("idx").agg(F.count("*").alias("df")).filter("df > 1")
    numbers = dense_ids(shared, [F.desc("df"), "idx"], "num").select("idx", (F.col("num") - 1).alias("num"))
    summed = entries.join(numbers, "idx").repartition(key).groupBy(key, "num").agg(F.sum("v").alias("v"))
    vectors = summed.groupBy(key).agg(F.collect_list(F.struct("num", "v")).alias("entries"))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = met.select(key, "entries", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    tasks = blocks * (blocks + 1)
    kind = unit.schema[key].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])
    compare = _compare_block(min_similarity, key, to_arrow_schema(out))
    pairs = dealt.repartition(tasks, "first", "second").groupBy("first", "second").applyInArrow(compare, out)
    return pairs.select(F.greatest("a", "b").alias("row"), F.least("a", "b").alias("col"), "similarity")


def similar_pairs(
    vectors: DataFrame,
    min_similarity: float,
    key: str = "id",
    value: str = "value",
    chunk: int = PAIR_CHUNK,
    crowd: int = CROWD,
    block: int = BLOCK,
) -> DataFrame:
    """``(row, col, similarity)`` with ``row > col`` of all pairs whose cosine is at least ``min_similarity`` (above 0). Exact.

    Pairs are formed at indexed entries only, see :func:`indexed_entries`; there, a common feature of many vectors is mostly left out.
    Vectors with an indexed entry that more than ``crowd`` vectors index, as most of long texts, would meet nearly all others there, once for each
    such entry; these are compared with each other in blocks of at most about ``block``, see :func:`_similar_in_blocks`. A pair with any other vector meets at the
    entries that this one has indexed, each of at most ``crowd`` vectors.
    What two vectors can still share before the later of their first indexed places is at most the product of the lengths that remain; pairs that cannot reach
    the threshold with it go before the vectors are compared. Vectors without entries, or of zeros only, are similar to nothing.

    Equal vectors are similar to each other, so their pairs are as many as the square of their number: take one of each
    (:func:`equal_vectors`) if that is not wanted.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity must be above 0 and at most 1")
    unit = materialise(_unit_entries(vectors, key, value), "unit-vectors")
    index = materialise(indexed_entries(unit, min_similarity, key), "indexed-entries")
    crowded = index.groupBy("idx").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    many = materialise(index.join(crowded, "idx", "left_semi").select(key).distinct(), "crowded-vectors")
    n_many = many.count()
    told = index.join(many.withColumn("many", F.lit(True)), key, "left")
    few = told.filter("many is null").select("idx").distinct()
    met = shared_group_pairs(told.join(few, "idx", "left_semi"), "idx", key, ["v", "rare", "left", "many"], chunk)
    met = met.filter((F.col(f"hi_{key}") != F.col(f"lo_{key}")) & (F.col("hi_many").isNull() | F.col("lo_many").isNull()))
    hi, lo = F.col(f"hi_{key}").alias("row"), F.col(f"lo_{key}").alias("col")
    sums = met.groupBy(hi, lo).agg(
        F.sum(F.col("hi_v") * F.col("lo_v")).alias("dot"),
        F.sum(F.col("hi_v") * F.col("hi_v")).alias("hi2"),
        F.sum(F.col("lo_v") * F.col("lo_v")).alias("lo2"),
        *[F.max(c).alias(c) for c in ("hi_rare", "lo_rare", "hi_left", "lo_left")],
    )

    def rest(left: str, met_of_other: str) -> Column:
        return F.sqrt(F.col(left) * F.greatest(F.lit(1.0) - F.col(met_of_other), F.lit(0.0)))

    hi_later = F.col("hi_rare") >= F.col("lo_rare")
    most = F.col("dot") + F.when(hi_later, rest("hi_left", "lo2")).otherwise(rest("lo_left", "hi2"))
    possible = sums.filter(most >= min_similarity - SLACK).select("row", "col")
    left = unit.select(F.col(key).alias("row"), "idx", F.col("v").alias("a"))
    right = unit.select(F.col(key).alias("col"), "idx", F.col("v").alias("b"))
    exact = possible.join(left, "row").join(right, ["col", "idx"]).groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("similarity"))
    found = exact.filter(F.col("similarity") >= min_similarity)
    return found.unionByName(_similar_in_blocks(unit, many, n_many, min_similarity, key, block)) if n_many > 1 else found
