"""Frequencies, pruned dictionaries and top-n selection.

Feature rows are ``(noun1, noun2, pattern, sentence)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.numbering import dense_ids
from ..plans.skew import COLLECT_CHUNK, gather
from ..plans.storage import fresh_path, materialise

PAIR = ["noun1", "noun2"]


def sentence_frequencies(features: DataFrame) -> DataFrame:
    """Rows and distinct pairs per sentence."""
    per_pair = features.groupBy("sentence", *PAIR).agg(F.count("*").alias("rows"))
    return per_pair.groupBy("sentence").agg(F.sum("rows").alias("freq"), F.count("*").alias("num_pairs"))


def pair_pattern_frequencies(features: DataFrame) -> DataFrame:
    """Rows per pair and pattern."""
    return features.groupBy(*PAIR, "pattern").agg(F.count("*").alias("freq"))


def _with_sets(features: DataFrame, keys: Sequence[str], member: Column, n: str, name: str, chunk: int) -> DataFrame:
    """``(*keys, freq, n, part, name)``: rows and distinct members per group, and the sorted set of members, in parts of about ``chunk``.

    The pair-pattern counts are stored, so the features are computed once. A group is joined to its sums as a structure, which
    is equal to itself where a key is null. A null member counts as rows only.
    """
    counted = materialise(pair_pattern_frequencies(features), "pair-patterns").select(F.struct(*keys).alias("_key"), member.alias("_member"), "freq")
    sums = counted.groupBy("_key").agg(F.sum("freq").alias("freq"), F.count("_member").alias(n))
    parts = F.greatest(F.ceil(F.col(n) / F.lit(chunk)), F.lit(1)).cast("int")
    told = counted.drop("freq").join(sums, "_key").withColumn("part", F.pmod(F.xxhash64("_member"), parts).cast("int"))
    # the part of a null member alone would be an empty one
    told = told.filter(F.col("_member").isNotNull() | (F.col(n) == 0))
    made = told.groupBy("_key", "part").agg(F.first("freq").alias("freq"), F.first(n).alias(n), F.sort_array(F.collect_list("_member")).alias(name))
    return made.select("_key.*", "freq", n, "part", name)


def pair_frequencies(features: DataFrame, sets: bool = False, chunk: int = COLLECT_CHUNK) -> DataFrame:
    """Rows and distinct patterns per pair, from the pair-pattern counts; with ``sets`` also the set ``patterns``, in parts (``part``) of bounded size."""
    if sets:
        return _with_sets(features, PAIR, F.col("pattern"), "num_patterns", "patterns", chunk)
    return (
        pair_pattern_frequencies(features)
        .groupBy(*PAIR)
        .agg(F.sum("freq").alias("freq"), F.count("pattern").alias("num_patterns"))
    )


def pattern_frequencies(features: DataFrame, sets: bool = False, chunk: int = COLLECT_CHUNK) -> DataFrame:
    """Rows and distinct pairs per pattern, from the pair-pattern counts; with ``sets`` also the set ``pairs``, in parts (``part``) of bounded size."""
    if sets:
        return _with_sets(features, ["pattern"], F.struct(*PAIR), "num_pairs", "pairs", chunk)
    return (
        pair_pattern_frequencies(features)
        .groupBy("pattern")
        .agg(F.sum("freq").alias("freq"), F.count("*").alias("num_pairs"))
    )


def patterns_of_pairs(features: DataFrame, chunk: int = COLLECT_CHUNK) -> DataFrame:
    """The set of patterns of each pair, in parts of bounded size."""
    return gather(pair_pattern_frequencies(features), PAIR, F.col("pattern"), F.col("pattern"), "patterns", chunk)


def pairs_of_patterns(features: DataFrame, chunk: int = COLLECT_CHUNK) -> DataFrame:
    """The set of pairs of each pattern, in parts of bounded size."""
    pair = F.struct(*PAIR)
    return gather(pair_pattern_frequencies(features), ["pattern"], pair, pair, "pairs", chunk)


OUTPUTS = ("sentence", "pair", "pattern", "pair_pattern")


def frequencies(features: DataFrame) -> dict[str, DataFrame]:
    """The four frequency tables, stored; see :func:`store_frequencies`."""
    return store_frequencies(features)[0]


def store_frequencies(features: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The four frequency tables from one pass over the features, and counters of that pass.

    The features are read once: each row counts for its pair and pattern and for its sentence and pair, summed up before one
    shuffle. The four tables are made of these stored counts and written in one go, each row under the name of its output.
    The counters are metrics of the pass itself: ``features``, and ``incomplete`` of those with a null part. A row
    counts as it is, nulls included.
    """
    seen = Observation("features")
    parts = [*PAIR, "pattern", "sentence"]
    lacking = F.count(F.when(reduce(lambda x, y: x | y, [F.col(c).isNull() for c in parts]), 1))
    watched = features.select(*parts).observe(seen, F.count(F.lit(1)).alias("features"), lacking.alias("incomplete"))
    sets = [[*PAIR, "pattern"], [*PAIR, "sentence"]]
    counted = watched.groupingSets([[F.col(c) for c in s] for s in sets], *parts).agg(F.count("*").alias("freq"), F.grouping("pattern").alias("by_sentence"))
    counted = materialise(counted, "feature-counts")
    by_pattern, by_sentence = counted.filter("by_sentence = 0"), counted.filter("by_sentence = 1")

    def summed(table: DataFrame, *keys: str, of: str = "*") -> DataFrame:
        return table.groupBy(*keys).agg(F.sum("freq").alias("freq"), F.count(of).alias("n"))

    made = {
        "sentence": summed(by_sentence, "sentence"),
        "pair": summed(by_pattern, *PAIR, of="pattern"),
        "pattern": summed(by_pattern, "pattern"),
        "pair_pattern": by_pattern.select(*PAIR, "pattern", "freq"),
    }
    tagged = [t.withColumn("output", F.lit(name)) for name, t in made.items()]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    path = fresh_path(features.sparkSession, "frequencies")
    every.write.partitionBy("output").parquet(path)
    schema = every.schema
    renamed = {"sentence": "num_pairs", "pair": "num_patterns", "pattern": "num_pairs"}
    tables = {}
    for name in OUTPUTS:
        # an output without rows has no folder of its own
        stored = features.sparkSession.read.schema(schema).parquet(path).filter(F.col("output") == name)
        tables[name] = stored.select(*[F.col(c).alias(renamed.get(name, c) if c == "n" else c) for c in made[name].columns if c != "output"])
    # of an empty input nothing is observed
    counters = {k: 0 for k in ("features", "incomplete")} if counted.isEmpty() else seen.get
    return tables, counters


def pair_dictionary(features: DataFrame, min_rows: int = 0, min_patterns: int = 2) -> DataFrame:
    """Pairs above both thresholds, numbered by frequency: ``(id, noun1, noun2, freq, num_patterns)``."""
    kept = pair_frequencies(features).filter((F.col("freq") > min_rows) & (F.col("num_patterns") > min_patterns))
    return dense_ids(kept, [F.desc("freq"), *PAIR])


def pattern_dictionary(features: DataFrame, min_rows: int = 0, min_pairs: int = 3) -> DataFrame:
    """Patterns above both thresholds, numbered by frequency: ``(id, pattern, freq, num_pairs)``."""
    kept = pattern_frequencies(features).filter((F.col("freq") > min_rows) & (F.col("num_pairs") > min_pairs))
    return dense_ids(kept, [F.desc("freq"), "pattern"])


def top_n(df: DataFrame, by: Sequence[str], score: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the highest score per group, ties by ``tie`` ascending.

    The rank filter lets Spark keep ``n`` rows per group and task before the
    shuffle, so a hot group does not travel whole.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(score), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
