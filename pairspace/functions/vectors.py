"""Column functions on dense and sparse vectors held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dense_to_sparse(dense: Column, float_precision: bool = False) -> Column:
    """Array of numbers to a sorted array of ``(idx, value)`` without zeros."""
    kind = "float" if float_precision else "double"
    indexed = F.transform(dense, lambda v, i: F.struct(i.alias("idx"), v.cast(kind).alias("value")))
    return F.filter(indexed, lambda e: e["value"] != 0)


def sparse_to_dense(entries: Column, cardinality: Column | int, float_precision: bool = False) -> Column:
    """Array of ``(idx, value)`` to ``cardinality`` numbers.

    Entries outside ``[0, cardinality)`` are skipped; of two entries with the
    same index the later one counts.
    """
    kind = "float" if float_precision else "double"
    n = (F.lit(cardinality) if isinstance(cardinality, int) else cardinality).cast("int")
    zero = F.lit(0).cast(kind)
    inside = F.filter(entries, lambda e: (e["idx"] >= 0) & (e["idx"] < n))
    ordered = F.array_sort(
        F.transform(inside, lambda e, i: F.struct(e["idx"].cast("int").alias("idx"), i.alias("at"), e["value"].cast(kind).alias("value")))
    )

    def last_of_each(s):
        return F.filter(s, lambda e, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["idx"] != e["idx"]))

    def spread(s):
        # zeros up to each entry, the entry itself, and zeros up to the end
        filled = F.flatten(
            F.transform(
                s,
                lambda e, i: F.concat(
                    F.array_repeat(zero, e["idx"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(s, i - 1)["idx"]) - 1),
                    F.array(e["value"]),
                ),
            )
        )
        return F.concat(filled, F.array_repeat(zero, n - F.coalesce(F.get(s, F.size(s) - 1)["idx"], F.lit(-1)) - 1))

    # transforming a one-element array binds its element to a name
    unique = F.transform(F.array(ordered), last_of_each)
    return F.transform(unique, spread)[0]


def dot(a: Column, b: Column) -> Column:
    """Dot product of two dense arrays of the same length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
