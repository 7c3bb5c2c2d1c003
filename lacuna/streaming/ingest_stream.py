"""File streams that feed the same batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lacuna.operators.ingest import record_key


def file_stream(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """New files under a folder as a stream with a declared schema."""
    reader = spark.readStream.schema(ddl).format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drop_repeats(stream: DataFrame, entity: str, event_time: str, delay: str) -> DataFrame:
    """Forget identities once they are older than the watermark, so the state stays bounded."""
    keyed = stream.withColumn("record_key", record_key(stream, entity))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["record_key"])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that is there now through ``foreachBatch`` and stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: a repeated batch replaces its own partition instead of adding to it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write
