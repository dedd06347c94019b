"""One helper for operators that need Python on a text: new columns beside a row's own, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows handed to a function at once, so that long texts do not add up.
STEP = 256


def add_columns(df: DataFrame, text_col: str, new: str, make: Callable[[list], list[tuple]], keep: list[str] | None = None, step: int | None = STEP) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) and the columns of the DDL ``new``; ``make`` maps texts to tuples of values.

    ``make`` gets ``step`` texts at once, or a whole Arrow batch. A new column replaces a kept one of the same name. Values pass in Arrow, so nulls and 64-bit integers stay exact.
    """
    added = T.StructType.fromDDL(new)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if (keep is None or f.name in keep) and f.name.lower() not in names]
    at = [df.schema.fieldNames().index(f.name) for f in kept]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *added])
    source = df.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in added]
        for whole in batches:
            size = step or max(1, whole.num_rows)
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                rows = make(batch.column(source).to_pylist())
                columns = [pa.array([row[i] for row in rows], type=kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *columns], names=schema.fieldNames())

    return df.mapInArrow(run, schema)
