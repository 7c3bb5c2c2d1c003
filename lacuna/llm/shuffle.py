"""Put a table into shards in random order: a two-pass external shuffle.

First pass: every record goes to one of many buckets by a seeded hash of its id and text, and the buckets are counted (only sizes and
hashes are read). Second pass: one Spark shuffle brings each bucket, which fits in memory, to a task; Fisher-Yates with a generator
seeded by the bucket puts it in order, and it is written at its global positions. Shards are equal cuts of the
positions, so their row counts differ by one at most (law ``rows``).

Buckets depend on ids, not on sources or texts, so neither a hot source nor a group of copies ends up in one of them. A rerun gives the same
order, as a bucket is sorted by (id, text) before it is shuffled.

Defined cases: a null text counts no bytes and has the CRC of the empty string; null ids are spread by their texts; rows equal in id and
text share a bucket and are interchangeable; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import stage, table

SHARDS = 24
BUCKET_BYTES = 16 << 20
SEED = 20240


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1 that depends on the seed and the bucket alone."""
    rng = np.random.Generator(np.random.Philox(key=[seed, bucket]))
    order = np.arange(n)
    swap = rng.integers(0, np.arange(n, 0, -1)) if n else order  # swap[k] picks one of the n - k places left
    for k in range(n - 1):
        j = k + swap[k]
        order[k], order[j] = order[j], order[k]
    return order


def _shuffled(seed: int, total: int, shards: int):
    def one(data: pa.Table) -> pa.Table:
        if not data.num_rows:
            return data.select([c for c in data.column_names if c not in ("__bucket", "__first", "__tie")])
        bucket, first = data["__bucket"][0].as_py(), data["__first"][0].as_py()
        by = data.select(["doc_id", "__tie"]).append_column("i", pa.array(np.arange(data.num_rows))).sort_by([("doc_id", "ascending"), ("__tie", "ascending")])
        order = by["i"].to_numpy()[fisher_yates(data.num_rows, seed, bucket)]
        place = first + np.arange(data.num_rows)
        shard = ((place + 1) * shards - 1) // total
        out = data.drop_columns(["__bucket", "__first", "__tie"]).take(pa.array(order))
        return out.append_column("__shard", pa.array(shard.astype(np.int32))).append_column("__slot", pa.array(place - shard * total // shards))
    return one


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows of ``docs`` as shards in random order and return them as read back, with __shard and __slot."""
    columns = docs.columns
    size = docs.agg(F.count(F.lit(1)), F.sum(row_size(F.col("text")))).first()
    total, n_buckets = size[0], max(1, -(-(size[1] or 0) // bucket_bytes))
    tie = F.xxhash64(F.lit(seed), "doc_id", "text")
    keyed = docs.withColumn("__tie", tie).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "__tie"), F.lit(n_buckets)))
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket of memory size, not per record
    firsts = stage(counts.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first")), "buckets")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __shard int, __slot long"
    written = stage(keyed.join(firsts, "__bucket").groupBy("__bucket").applyInArrow(_shuffled(seed, total, shards), schema), "shards")
    return written.select(*columns, "__shard", "__slot")


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = shuffled_shards(table(spark, folder, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", row_size(F.col("text")).alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                       F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
