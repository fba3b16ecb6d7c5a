"""Costly row-by-row columns that are to be computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_column_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` through an ``explode`` of one element.

    Spark pushes filters, also those it infers, below a projection and repeats
    the projected expression in them. A generator's output stays above, so a
    costly expression is not evaluated once more per mention, nor below a
    shuffle that was to reduce the rows first.
    """
    return df.withColumn(name, F.explode(F.array(value)))
