"""Helpers shared by the Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker works on at a time; numpy arrays of some of the operators are 50 times as large.
CHUNK_CHARS = 500_000
#: Rows of an Arrow batch, unless the session sets fewer: with whole texts, ten thousand are too many for small executors.
BATCH_ROWS = 1_000


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column stays near CHUNK_CHARS bytes; one longer text is one slice."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > CHUNK_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. Spark reads the setting when a plan runs, not when it is made, so it can't be put back here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow of a function over bounded slices."""

    def run(batches):
        import pyarrow.compute  # noqa: F401  (binds pa.compute in the worker)

        for part in chunks(batches, text):
            yield fn(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
