"""Sequential state per key over ordered rows, streamed: a hot key takes one task's time but no more memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def fold_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Any, step: Step, ddl: str = "") -> DataFrame:
    """Walk each key's rows in ``order``; ``step`` takes the state and the order and other columns of a row, and
    gives the new state and what the row gets (``ddl``), or None to drop the row. ``start`` must not be changed
    in place."""
    source = df.select(*keys, *order, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    made = T.StructType([*source.schema.fields, *(T.StructType.fromDDL(ddl).fields if ddl else [])])
    schema, n = to_arrow_schema(made), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    key, state = row[:n], start
                state, more = step(state, row[n:])
                if more is not None:
                    out.append((*row, *more))
            columns_ = zip(*out) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_, schema)], schema=schema)

    return source.mapInArrow(run, made)
