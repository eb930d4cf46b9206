"""Walking the rows of each key in order, where each result depends on the ones before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def walked(df: DataFrame, key: str, order: list[Column], reads: list[str], begin: Callable[[], Callable], column: str, kind: str) -> DataFrame:
    """``df`` with ``column`` of Spark type ``kind``: the rows of each ``key`` in ``order`` are given, by their columns ``reads``, to the
    function that ``begin()`` makes anew for each key. Rows are sorted by Spark, which spills, and pass in Arrow batches;
    only what the function remembers is held, so a key may have any number of rows."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    out = _parse_datatype_string(kind)
    arrow = to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for batch in batches:
            made = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *reads)), strict=True):
                if step is None or k != last:
                    last, step = k, begin()
                made.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], [*batch.schema.names, column])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, StructType([*df.schema.fields, StructField(column, out)]))
