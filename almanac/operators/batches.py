"""Functions of whole texts, in Arrow batches whose memory follows the bytes of the texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def fresh(columns: Iterable[str], base: str) -> str:
    """``base``, lengthened until it clashes with no column (names compare without case, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text (one row at least), so that memory follows bytes and not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def widen(docs: DataFrame, column: str, kind: str, factory, limit: int = 8 << 20, column_read: str = "text") -> DataFrame:
    """``docs`` (``column_read`` and any others) with one more column. ``factory()`` is called once in each task and gives a function
    from a list of texts (null as "") to an Arrow array or list of values of Spark type ``kind``; what it remembers lives as
    long as its task. Rows stay where they are: there is no shuffle, and a lost task is run again alone."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    out = _parse_datatype_string(kind)
    arrow = to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for batch in batches:
            for part in pieces(batch, column_read, limit):
                made = compute([t or "" for t in part.column(column_read).to_pylist()])
                made = made if isinstance(made, pa.Array) else pa.array(made, arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made.cast(arrow)], [*part.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, out)]))
