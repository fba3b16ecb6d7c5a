"""Boilerplate lines by their frequency inside a site [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairspace.plans.storage import materialise

from .rows import col, pack, unpack, without

MAX_RATIO = 0.1
MIN_PAGES = 3


def _keys(line: Column) -> list[Column]:
    """128 bits of a trimmed line, so that counts travel without the text."""
    line = F.trim(line)
    return [F.xxhash64(line), F.xxhash64(F.lit(1), line)]


def boilerplate_lines(
    pages: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Per site, the keys of its boilerplate lines: ``site, lines`` (an array of key pairs).

    A line counts once per page. It is boilerplate when more than ``max_ratio``
    of the site's pages hold it, and at least ``min_pages`` do. A site can
    therefore have at most (mean number of lines per page) / ``max_ratio`` of
    them, however many pages it has.
    """
    base = pages.select(col(site).cast("string").alias("site"), col(text).alias("text"))
    totals = base.groupBy("site").agg(F.count("*").alias("pages"))
    # lines that differ only at their ends are one line of the page
    lines = base.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line"))
    first, second = _keys(F.col("line"))
    counts = (
        lines.filter("line <> ''")
        .groupBy("site", first.alias("a"), second.alias("b"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    return (
        counts.join(totals.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of")))
        .filter(F.col("n") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("site")
        .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("lines"))
    )


def dedup_lines(
    pages: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with boilerplate lines cut out of ``text``, and ``n_lines_removed``.

    Lines are compared without the blanks at their ends; blank lines always
    stay. Rows are pages: a repeated row counts again. Pages without a site form
    one site of their own. A null text stays null, an empty one empty, and a text
    of nothing but boilerplate becomes empty; 0 lines are removed from the first two.
    An empty table gives an empty result. An input column ``n_lines_removed`` is replaced.

    Only line keys are shuffled. The keys per site are stored, so that Spark
    knows their size: it broadcasts them when they are small, and otherwise joins
    on the site and splits hot sites.
    """
    pages = without(pages, ["n_lines_removed"])
    found = materialise(boilerplate_lines(pages, site, text, max_ratio, min_pages), "boilerplate")
    rows = pages.select(pack(pages).alias("row"), col(site).cast("string").alias("site"))
    joined = rows.join(
        found.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of")), "left"
    ).select("row", "lines")
    old = F.col("row").getField(text)
    pieces = F.split(old, "\n")
    stays = F.filter(pieces, lambda x: ~F.array_contains(F.col("lines"), F.struct(*[k.alias(n) for k, n in zip(_keys(x), "ab", strict=True)])))
    done = joined.withColumn("kept", F.when(F.col("lines").isNotNull(), stays))
    new = F.when(F.col("kept").isNull(), old).otherwise(F.array_join("kept", "\n"))
    removed = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size(pieces) - F.size("kept"))
    return done.select(*unpack(done, "row", pages.columns, **{text: new.alias(text)}), removed.alias("n_lines_removed"))
