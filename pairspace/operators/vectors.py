"""Sparse vectors.

Vectors are computed in long form, one row ``(key, idx, value)`` per entry;
:func:`collect_vectors` makes arrays of them for export.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import dense_ids
from ..plans.skew import COLLECT_CHUNK, gather
from ..plans.storage import materialise
from .counts import PAIR, pair_pattern_frequencies


@dataclass
class FeatureVectors:
    """``vectors (id, idx, cnt)``, both renumbered dictionaries and the old-to-new map."""

    vectors: DataFrame
    pairs: DataFrame
    patterns: DataFrame
    index_map: DataFrame


def feature_entries(
    features: DataFrame, pairs: DataFrame, patterns: DataFrame, min_pat_freq: int, min_num_pat: int
) -> DataFrame:
    """Pair-pattern counts that survive the pruning, still under their names.

    Only members of both dictionaries count; an entry must occur more than
    ``min_pat_freq`` times and its pair must keep more than ``min_num_pat``
    entries.
    """
    counted = pair_pattern_frequencies(features).filter(F.col("freq") > min_pat_freq)
    known = counted.join(patterns.select("pattern"), "pattern", "left_semi").join(
        pairs.select(*PAIR), PAIR, "left_semi"
    )
    rich = known.groupBy(*PAIR).agg(F.count("*").alias("n")).filter(F.col("n") > min_num_pat)
    return known.join(rich, PAIR, "left_semi").withColumnRenamed("freq", "cnt")


def feature_vectors(
    features: DataFrame, pairs: DataFrame, patterns: DataFrame, min_pat_freq: int, min_num_pat: int
) -> FeatureVectors:
    """Pattern counts per pair as sparse vectors with gap-free numbers.

    ``pairs`` and ``patterns`` are the dictionaries of
    :mod:`pairspace.operators.counts`; their surviving members are numbered
    anew in the order of their names.
    """
    entries = materialise(
        feature_entries(features, pairs, patterns, min_pat_freq, min_num_pat), "feature-entries"
    )
    kept_pairs = pairs.select(*PAIR, "freq", "num_patterns").join(entries.select(*PAIR).distinct(), PAIR, "left_semi")
    kept_patterns = patterns.select(F.col("id").alias("prev_id"), "pattern", "freq", "num_pairs").join(
        entries.select("pattern").distinct(), "pattern", "left_semi"
    )
    new_pairs = dense_ids(kept_pairs, PAIR)
    new_patterns = dense_ids(kept_patterns, ["pattern"])
    vectors = (
        entries.join(new_patterns.select(F.col("id").alias("idx"), "pattern"), "pattern")
        .join(new_pairs.select("id", *PAIR), PAIR)
        .select("id", "idx", "cnt")
    )
    return FeatureVectors(
        vectors,
        new_pairs,
        new_patterns.select("id", "pattern", "freq", "num_pairs"),
        new_patterns.select("prev_id", F.col("id").alias("new_id")),
    )


def context_vectors(contexts: DataFrame, value: str = "cnt") -> DataFrame:
    """``(id, jo, idx, value)``: items and distinct contexts numbered in the order of their names."""
    jos = dense_ids(contexts.select("jo").distinct(), ["jo"])
    bims = dense_ids(contexts.select("bim").distinct(), ["bim"], "idx")
    return (
        contexts.join(bims, "bim").join(jos, "jo").select("id", "jo", "idx", F.col(value).cast("double").alias("value"))
    )


def collect_vectors(entries: DataFrame, keys: list[str], idx: str = "idx", value: str = "value", chunk: int = COLLECT_CHUNK) -> DataFrame:
    """``(*keys, part, values)`` with ``values`` sorted by index.

    A vector longer than ``chunk`` comes in several parts.
    """
    item = F.struct(F.col(idx).alias("idx"), F.col(value).alias("value"))
    return gather(entries, keys, item, F.col(idx), "values", chunk)


def explode_vectors(vectors: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Long form of array vectors; empty and null vectors vanish."""
    return vectors.select(*keys, F.explode(values).alias("e")).select(*keys, "e.idx", "e.value")


def reindex(entries: DataFrame, index_map: DataFrame, idx: str = "idx") -> DataFrame:
    """Replace ``idx`` by ``new_id`` of the map; an unknown index becomes null."""
    return (
        entries.join(index_map.select(F.col("prev_id").alias(idx), "new_id"), idx, "left")
        .drop(idx)
        .withColumnRenamed("new_id", idx)
    )
