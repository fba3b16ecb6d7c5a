"""JSON lines as maps of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP = "map<string,string>"


def json_map(text: Column) -> Column:
    """The members of a JSON object as text without quotes; null stays null.

    A nested object or array keeps its JSON text, to be read by this function
    or by :func:`json_bag`.
    """
    return F.transform_values(F.from_json(text, MAP), lambda _, v: unquote(v))


def unquote(value: Column) -> Column:
    return F.when(value.rlike(r"^[\[{]"), value).otherwise(F.regexp_replace(value, '"', ""))


def json_bag(text: Column) -> Column:
    """The elements of a JSON array as text; arrays inside it, however deep, are merged into the one bag."""

    def inner(item: Column) -> Column:
        # a string may begin like an array without being one
        return F.when(item.startswith("["), F.coalesce(F.from_json(item, "array<string>"), F.array(item))).otherwise(F.array(item))

    def level(items: Column, _: Column) -> Column:
        return F.when(F.exists(items, lambda x: x.startswith("[")), F.flatten(F.transform(items, inner))).otherwise(items)

    # no array is nested deeper than there are brackets
    depth = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))))
    return F.transform(F.aggregate(depth, F.from_json(text, "array<string>"), level), unquote)


def parse_json_lines(lines: DataFrame, col: str = "value", malformed: str = "raise") -> DataFrame:
    """Add ``json``, the line as a map; blank lines give no row.

    A malformed line is an error; with ``malformed="null"`` its map is null.
    """
    if malformed not in ("raise", "null"):
        raise ValueError("malformed must be raise or null")
    said = lines.filter(F.trim(col) != "")
    read = json_map(F.col(col))
    if malformed == "raise":
        bad = F.concat(F.lit("malformed JSON line: "), F.substring(F.col(col), 1, 200))
        read = F.when(F.from_json(F.col(col), MAP).isNull(), F.raise_error(bad).cast(MAP)).otherwise(read)
    return said.withColumn("json", read)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path))
