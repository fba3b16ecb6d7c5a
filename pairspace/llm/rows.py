"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def col(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns that a result is about to add; the result's columns win."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def pack(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that inner names cannot clash with them."""
    return F.struct(*[col(c).alias(c) for c in df.columns])


def unpack(df: DataFrame, row: str, fields: Sequence[str], **replaced: Column) -> list[Column]:
    """The columns of a packed row again, some of them replaced."""
    return [replaced[f] if f in replaced else F.col(row).getField(f).alias(f) for f in fields]


ROWS_AT_ONCE, BYTES_AT_ONCE = 1_000, 8_000_000


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that few bytes are worked on at once, however long the rows are."""
    for batch in batches:
        rows = min(most, max(1, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _give_back() -> None:
    """Return freed memory to the system: workers are reused, also by stages that need much less."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame,
    inputs: Sequence[str],
    added: T.StructType,
    start: Callable[[], Callable[..., Sequence[list]]],
    keep: Sequence[str] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Add columns that Python computes from ``inputs``, batch by batch, without a shuffle.

    ``start`` runs once per task and returns a function from lists of the inputs
    (strings as UTF-8 bytes) to lists of the added columns. A column of ``df``
    that has the name of an added one is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in added}]
    carried = df.select(*[col(c) for c in kept], *[col(c).alias(f"_in_{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([carried.schema[i] for i in range(len(kept))] + list(added))
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        types = to_arrow_schema(added)
        for batch in _slices(batches, rows_at_once):
            columns = batch.columns
            given = []
            for c in columns[width:]:
                given.append((c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist())
            made = work(*given)
            arrays = [v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, type=f.type) for v, f in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:width], *arrays], names=[f.name for f in schema])
        del work
        _give_back()

    return carried.mapInArrow(run, schema)
