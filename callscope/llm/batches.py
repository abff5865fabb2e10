"""Helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 1000
#: Arrow batches between Spark and its Python workers, in rows and in bytes.
BATCH_ROWS = 1000
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """
    From now on the session's Arrow batches have BATCH_ROWS rows and about BATCH_BYTES at most.

    Each side holds a batch outside the heap, with room to grow, several times over; of whole documents Spark's usual 10,000 rows take more memory than all the work on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_rows(df: DataFrame, columns: list[str], row: Callable[..., tuple], schema: str, keep: list[str] | None = None) -> DataFrame:
    """
    One output row per input row: the columns of `keep`, then what `row(*values)` returns for the fields of `schema`.

    Values are taken out of the batch one row at a time and results handed on some rows at a time, so a task holds one batch and the
    results of ROWS of it.
    """
    kept = keep or []
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields] + [schema])
    target = to_arrow(fields)
    names = target.names[len(kept):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                values = [part.column(c) for c in columns]
                out = [row(*(v[i].as_py() for v in values)) for i in range(part.num_rows)]
                made = [pa.array([r[k] for r in out], target.field(name).type) for k, name in enumerate(names)]
                carried = [part.column(c).cast(target.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays(carried + made, schema=target)

    return df.select(*dict.fromkeys([*kept, *columns])).mapInArrow(run, fields)


def to_arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a schema in Spark's notation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
