"""Adding columns computed from whole texts, an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 1024


def with_text_columns(df: DataFrame, fields: list[T.StructField], start: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """df, which has a column text, with more columns.

    start() runs once in each task and returns a function from the texts of a batch (None for null) to one list of
    values for each new field. The other columns pass through unchanged as Arrow arrays. Tasks keep ROWS rows as Python
    values at a time.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        compute = start()
        for batch in (b.slice(n, ROWS) for b in batches for n in range(0, b.num_rows, ROWS)):
            new = compute(batch.column(at).to_pylist())
            arrays = [c.cast(f.type) if c.type != f.type else c for c, f in zip(batch.columns, arrow)]
            arrays += [pa.array(v, f.type) for v, f in zip(new, list(arrow)[len(arrays) :])]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
