"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.plans.store import cut, table  # noqa: F401

#: Words are maximal runs of bytes other than space and the controls 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def is_small(df: DataFrame, rows: int = 10_000, size: int = 8 << 20) -> bool:
    """Whether a table has at most so many rows and bytes of strings that it may be broadcast; for tables that are written or cheap."""
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.sum(length)).first()
    return n <= rows and (total or 0) <= size


def in_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """df, with Arrow batches of at most `rows` rows in its session from now on, as texts and sketches are long.

    Spark reads that setting when a plan runs and not when it is made, so it cannot be set back here; the README says so.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def with_input(df: DataFrame, keep: Sequence[str], column: str, name: str) -> tuple[DataFrame, str]:
    """The columns `keep` and an input column, and what the latter is called: not twice if it is among them."""
    if column in keep:
        return in_batches(df).select(*keep), column
    return in_batches(df).select(*keep, F.col(column).alias(name)), name


def slices(batches: Iterator[pa.RecordBatch], sized: Sequence[str], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most `rows` rows and, unless one row is larger, `size` bytes in the columns `sized`."""
    for batch in batches:
        start = 0
        lengths = [batch.column(batch.schema.get_field_index(c)).nbytes / max(1, batch.num_rows) for c in sized]
        step = int(max(1, min(rows, size // max(1.0, sum(lengths)))))
        while start < batch.num_rows:
            yield batch.slice(start, step)
            start += step
        pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(kernel, schema)


def batch_of(like: pa.RecordBatch, keep: Sequence[str], **columns: pa.Array) -> pa.RecordBatch:
    """The columns `keep` of a batch beside new ones."""
    got = {c: like.column(like.schema.get_field_index(c)) for c in keep}
    return pa.RecordBatch.from_pydict(got | columns)


def fields(df: DataFrame, columns: Sequence[str]) -> str:
    """A DDL list of some of df's columns, to be followed by what a kernel adds."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)
