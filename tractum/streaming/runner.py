"""Runs a streaming query over what is available and hands back its result.

Each micro-batch is written to its own folder of the shared directory, with
overwrite: a batch repeated after a failure replaces itself, so the result is
exactly-once.  Nothing passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tractum.session import shared_folder

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The events table as a stream.  ``max_files`` bounds a micro-batch; the
    results of the landing queries don't depend on it."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files)
    return stream.parquet(f"{folder.rstrip('/')}/events.parq*")


def run_available(stream: DataFrame, mode: str, route: Callable[[DataFrame], dict[str, DataFrame]] | None = None,
                  name: str = "stream") -> tuple[str, StreamingQuery]:
    """Processes all input present, writing batch ``b`` of each output to
    ``<base>/<output>/batch=b``.  Returns the base folder and the query."""
    base = f"{shared_folder(stream.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        outputs = {"out": batch} if route is None else route(batch)
        if len(outputs) > 1:
            batch.persist()
        for output, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{base}/{output}/batch={batch_id}")
        if len(outputs) > 1:
            batch.unpersist()

    q = (
        stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start()
    )
    q.awaitTermination()
    return base, q


def output(spark: SparkSession, base: str, schema: T.StructType, name: str = "out") -> DataFrame:
    batch = T.StructField("batch", T.LongType())
    return spark.read.schema(T.StructType([*schema.fields, batch])).parquet(f"{base}/{name}")


def appended(stream: DataFrame) -> DataFrame:
    base, _ = run_available(stream, "append")
    return output(stream.sparkSession, base, stream.schema).drop("batch")


def latest(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update-mode result: the row each key had last."""
    base, _ = run_available(stream, "update")
    rows = output(stream.sparkSession, base, stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")


def merged(stream: DataFrame, route: Callable[[DataFrame], dict[str, DataFrame]], keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Lands what ``route`` makes of each micro-batch and adds ``n`` up per key."""
    base, _ = run_available(stream, "append", route)
    return output(stream.sparkSession, base, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def first_of(stream: DataFrame, id_column: str) -> DataFrame:
    """Each id once, as it came in its first micro-batch.  Batches are reduced
    before they land; what repeats across batches meets in one aggregate, so
    no row is too late to be recognised."""
    base, _ = run_available(stream, "append", lambda batch: {"out": batch.dropDuplicates([id_column])})
    rest = [c for c in stream.columns if c != id_column]
    first = output(stream.sparkSession, base, stream.schema).groupBy(id_column).agg(F.min_by(F.struct(*rest), "batch").alias("_r"))
    return first.select(id_column, "_r.*")
