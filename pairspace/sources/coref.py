"""Bracketed mention spans in the last column of token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import running_sums


def coref_mentions(lines: DataFrame) -> DataFrame:
    """``(doc, cluster, start, end)`` from token lines ``(doc, line_no, value)``.

    The last field of a line may open ``(7``, close ``7)`` or do both
    ``(7)``; brackets nest. Tokens are counted per document without comment
    and empty lines. Of mentions with one and the same span the outermost one
    is kept.

    Brackets of one cluster are matched by their running depth: the closing of a depth belongs to the last opening of it. Token
    numbers, depths and these numbers are running sums that pass from one range of rows to the next, so a document may be
    longer than a task can hold. ``line_no`` must order the lines of a document; a closing without opening is no mention.
    """
    tokens = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    numbered = running_sums(tokens.select("doc", "line_no", "value"), ["doc"], ["line_no"], F.lit(1), "token")
    tagged = numbered.select("doc", F.col("token").cast("int").alias("token"), F.element_at(F.split(F.trim("value"), r"\s+"), -1).alias("tag"))
    marks = tagged.select(
        "doc", "token", F.posexplode(F.regexp_extract_all("tag", F.lit(r"(\(?[0-9]+\)?)"), 1)).alias("nth", "mark")
    ).select(
        "doc",
        "token",
        "nth",
        F.regexp_replace("mark", r"[()]", "").alias("cluster"),
        F.col("mark").startswith("(").alias("opens"),
        F.col("mark").endswith(")").alias("closes"),
    )
    # a mark may open and close: two events in this order
    events = marks.select(
        "doc",
        "token",
        "nth",
        "cluster",
        F.explode(
            F.concat(
                F.when(F.col("opens"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
                F.when(F.col("closes"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")),
            )
        ).alias("step"),
    )
    order = [F.col("token"), F.col("nth"), F.desc("step")]
    # an opening bracket and the closing one at the same depth belong together
    depth = running_sums(events, ["doc", "cluster"], order, F.col("step"), "depth")
    level = F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    opening = F.col("step") == 1
    opened = F.when(opening, 1).otherwise(0)
    counted = running_sums(depth.withColumn("level", level).drop("depth"), ["doc", "cluster", "level"], order, opened, "couple")
    at = F.struct("token", "nth")
    couples = counted.groupBy("doc", "cluster", "level", "couple").agg(
        F.max(F.when(opening, at)).alias("open"), F.min(F.when(~opening, at)).alias("close")
    )
    spans = couples.filter("open is not null and close is not null").select(
        "doc", "cluster", F.col("open.token").alias("start"), F.col("close.token").alias("end"), F.col("close.nth").alias("nth")
    )
    # closings come inside out: the last one of a span is the outermost
    return (
        spans.groupBy("doc", "start", "end")
        .agg(F.max_by("cluster", "nth").alias("cluster"))
        .select("doc", "cluster", "start", "end")
    )
