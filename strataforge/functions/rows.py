"""Arrow plumbing: run a Python generator over rows without pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataforge.runtime import spread

#: Rows out of which one Arrow batch is made.
OUT_ROWS = 4096


def flat_map(df: DataFrame, columns: list[str], each: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, balance: bool = True) -> DataFrame:
    """``each`` gets all rows of a partition as tuples of ``columns`` and yields result tuples in the order of ``schema``.

    Only ``columns`` are read; names that clash elsewhere don't matter.
    """
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def pack(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

        held: list[tuple] = []
        for row in each(rows()):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    source = df.select(*[f"`{c}`" for c in columns])
    return (spread(source) if balance else source).mapInArrow(run, fields)
