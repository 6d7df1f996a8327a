"""Rows in Arrow batches through functions over lists, a bounded number of characters at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that one call of a batch function gets; a longer text is a call of its own, never cut.
CHUNK_CHARS = 1_000_000


def chunks(batches: Iterator[pa.RecordBatch], text_columns: list[str]) -> Iterator[dict[str, list]]:
    """The rows as dicts of lists, cut where the texts of a piece reach CHUNK_CHARS."""
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        n = batch.num_rows
        a = size = 0
        for i in range(n):
            size += sum(len(cols[c][i] or "") for c in text_columns)
            if size >= CHUNK_CHARS or i == n - 1:
                yield {k: v[a : i + 1] for k, v in cols.items()}
                a, size = i + 1, 0


def arrow_schema(ddl: str) -> pa.Schema:
    """For use on the driver: workers have no session to parse with."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def record_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def map_texts(df: DataFrame, text_columns: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` gets and gives dicts of equally long lists; its result has the columns of ``schema`` in that order."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_columns):
            out = fn(part)
            if len(out[target.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
