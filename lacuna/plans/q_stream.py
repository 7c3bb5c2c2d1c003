"""Streaming queries: the event files as a stream, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.plans import import_job as J
from lacuna.plans.lens import AS_OF
from lacuna.plans.q_ingest import uid, uid_sql
from lacuna.plans.registry import query
from lacuna.plans.stages import scratch
from lacuna.schemas import SOURCE_DDL
from lacuna.session import use_utc
from lacuna.streaming import ingest_stream as IS


def _drain(spark, stream):
    root = scratch(spark, "stream")
    IS.run_available(stream, IS.batch_table_sink(f"{root}/table"), f"{root}/state")
    return spark.read.parquet(f"{root}/table").drop("batch_id")


def _events(spark, d):
    use_utc(spark)
    return IS.file_stream(spark, f"{d}/events.parquet*", SOURCE_DDL["events"])


@query("stream_ingest", "", "SELECT cast(event_id as varchar) AS id, 'AST-' || user_id AS asset_id, upper(event_type) AS category, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events")
def stream_ingest(spark, d):
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("AST-"), F.col("user_id").cast("string")).alias("asset_id"),
                                    F.upper("event_type").alias("category"), S.iso(F.col("ts").cast("timestamp")).alias("created_at"))
    return _drain(spark, rows)


@query("ingest_stream", "", f"SELECT {uid_sql('EVT', 'event_id')} AS id, {uid_sql('AST', 'user_id')} AS asset_id, upper(event_type) AS category FROM events")
def ingest_stream(spark, d):
    """The event files through the import code; the whole stream is then replayed from the start and must add nothing."""
    rows = _events(spark, d).select(uid("EVT", F.col("event_id")).alias("id"), uid("CSE", F.col("user_id") % 25).alias("cse_id"), uid("AST", F.col("user_id")).alias("asset_id"),
                                    F.upper("event_type").alias("category"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    root = scratch(spark, "stream")
    for state in ("first", "again"):
        IS.run_available(rows, J.stream_sink("alerts", ["id"], f"{root}/store", "stream", AS_OF), f"{root}/{state}")
    return spark.read.parquet(f"{root}/store/alerts").select("id", "asset_id", "category")


@query("stream_dedup", "", "SELECT DISTINCT 'alerts:' || user_id || '-' || event_type AS record_key FROM events")
def stream_dedup(spark, d):
    """One record per (user, type): the delay spans the whole month of events."""
    rows = _events(spark, d).select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("id"), F.col("ts").cast("timestamp").alias("seen_at"))
    return _drain(spark, IS.drop_repeats(rows, "alerts", "seen_at", "40 days")).select("record_key")
