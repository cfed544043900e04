"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A Python function sees so many rows at a time, however many a batch holds.
STEP = 256


def with_text_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable, drop: bool = False) -> DataFrame:
    """df with further columns that `make()(texts)` gives as Arrow arrays; null texts come as empty.

    make is called once in each task. With drop, the text itself is left out.
    """
    columns = [f.name for f in df.schema.fields]
    keep = [f for f in df.schema.fields if not (drop and f.name == text_col)]
    names = [f.name for f in keep + fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            at = columns.index(text_col)
            for begin in range(0, batch.num_rows, STEP):
                part = batch.slice(begin, STEP)
                own = [part.column(i) for i, name in enumerate(columns) if not (drop and name == text_col)]
                yield pa.RecordBatch.from_arrays(own + of([x or "" for x in part.column(at).to_pylist()]), names=names)

    # mapInArrow() looks its columns up by name, which fails for names with dots
    return df.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, T.StructType(keep + fields))
