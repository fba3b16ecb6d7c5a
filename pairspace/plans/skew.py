"""Hot groups: bounded collections and bounded pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLECT_CHUNK = 50_000
PAIR_CHUNK = 1_000


def gather(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    spread: Column,
    name: str,
    chunk: int = COLLECT_CHUNK,
) -> DataFrame:
    """One sorted array of ``item`` per key, cut into parts of about ``chunk``.

    A key with few rows has the single part 0. A hot key is divided over
    ``ceil(rows / chunk)`` parts by the hash of ``spread``, so that no task
    and no row ever holds an unbounded group, and no element is lost.
    Returns ``(*keys, part, <name>)``.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("_parts"))
    parted = df.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    return parted.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(item)).alias(name))


def shared_group_pairs(
    members: DataFrame,
    group: str,
    member: str,
    payload: Sequence[str],
    chunk: int = PAIR_CHUNK,
) -> DataFrame:
    """All unordered pairs of members that share a group, each member with itself.

    Returns ``group, hi_<member>, lo_<member>`` with ``hi >= lo`` and the
    payload of both sides as ``hi_*`` and ``lo_*``. A group with ``d`` members
    is divided into ``ceil(d / chunk)`` buckets and joined bucket pair by
    bucket pair, so a hot group is spread over many tasks of at most about
    ``chunk * chunk`` rows instead of landing in one.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("_buckets"))
    bucketed = members.join(sizes, group).withColumn(
        "_bucket", F.pmod(F.xxhash64(member), F.col("_buckets")).cast("int")
    )
    values = [member, *payload]
    left = bucketed.select(
        group,
        F.col("_bucket").alias("_upper"),
        F.explode(F.sequence(F.lit(0), "_bucket")).alias("_lower"),
        *[F.col(c).alias(f"_l_{c}") for c in values],
    )
    right = bucketed.select(
        group,
        F.explode(F.sequence(F.col("_bucket"), F.col("_buckets") - 1)).alias("_upper"),
        F.col("_bucket").alias("_lower"),
        *[F.col(c).alias(f"_r_{c}") for c in values],
    )
    l_key, r_key = F.col(f"_l_{member}"), F.col(f"_r_{member}")
    # within one bucket both orders of a pair meet: keep one of them
    once = (F.col("_upper") != F.col("_lower")) | (l_key >= r_key)
    joined = left.join(right, [group, "_upper", "_lower"]).filter(once)
    left_is_hi = l_key >= r_key
    return joined.select(
        group,
        *[F.when(left_is_hi, F.col(f"_l_{c}")).otherwise(F.col(f"_r_{c}")).alias(f"hi_{c}") for c in values],
        *[F.when(left_is_hi, F.col(f"_r_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"lo_{c}") for c in values],
    )
