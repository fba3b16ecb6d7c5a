"""Gold lists and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_nouns(raw: DataFrame, first: str = "c0", label: str = "c2", second: str = "c3") -> DataFrame:
    """Rows whose two words are tagged ``-n``, as ``(noun1, noun2, label)`` without the tag."""
    return raw.filter(F.col(first).endswith("-n") & F.col(second).endswith("-n")).select(
        F.regexp_replace(first, "-n$", "").alias("noun1"),
        F.regexp_replace(second, "-n$", "").alias("noun2"),
        F.col(label).alias("label"),
    )


def gold_profile(gold: DataFrame) -> DataFrame:
    """Rows in all, per label, per word and per word and label.

    ``(level, noun1, noun2, label, n)``. The list is counted once per
    (noun1, noun2, label) before it is unfolded into the groupings.
    """
    counted = gold.groupBy("noun1", "noun2", "label").agg(F.count("*").alias("n"))
    n1, n2, lab, null = F.col("noun1"), F.col("noun2"), F.col("label"), F.lit(None).cast("string")

    def level(name, a, b, c):
        return F.struct(F.lit(name).alias("level"), a.alias("noun1"), b.alias("noun2"), c.alias("label"))

    levels = F.array(
        level("all", null, null, null),
        level("label", null, null, lab),
        level("noun1", n1, null, null),
        level("noun2", null, n2, null),
        level("noun1_label", n1, null, lab),
        level("noun2_label", null, n2, lab),
    )
    return (
        counted.select("n", F.explode(levels).alias("g"))
        .groupBy("g.level", "g.noun1", "g.noun2", "g.label")
        .agg(F.sum("n").alias("n"))
    )


def histogram(df: DataFrame, col: str, bins: int = 100, lo: float = -1.0, hi: float = 1.5) -> DataFrame:
    """``(bin, n)`` with bin 0 for values below ``lo`` and ``bins + 1`` for values from ``hi`` on."""
    return (
        df.select(F.width_bucket(F.col(col).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
