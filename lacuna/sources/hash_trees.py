"""Manifests as hash trees: checksums of byte ranges of files, computed by many tasks, and the proof of which range changed.

Files are read as pieces between line feeds, which Spark splits at any byte, so no file is held in one cell or one task. A piece belongs to the range in
which it starts; a range's digest covers the digests of its pieces in order; above the ranges lies a tree of fixed height, so two
manifests always compare node by node. Digests depend on content and range size alone, not on how a session splits files. The file's own
digest also covers its length, which tells what the pieces leave out (a byte order mark at the start, a line feed at the end).

Verification compares files first and then only the children of nodes that differ, down to the ranges.

Defined cases: an empty file has no ranges and a digest; a file in the manifest alone is MISSING, one that is only there now is NEW; names must be unique. A file
without line feeds is one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_BYTES = 1 << 20
FANOUT, HEIGHT = 1024, 4


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _digested(range_bytes: int):
    """Pieces with the start of their run to ranges: the digest of ranges inside a run, the pieces' digests of those at its ends."""
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, offset, rng, at, held, edge = None, 0, None, 0, bytearray(), True
        rows: list[tuple] = []

        def close(last: bool) -> None:
            if rng is not None:
                open_ = edge or last
                rows.append((run[0], rng, at, open_, bytes(held) if open_ else hashlib.sha256(held).digest()))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["path", "k", "at", "edge", "data"])

        for batch in batches:
            for path, block, start, piece in zip(*(batch[c].to_pylist() for c in ("path", "block", "start", "piece")), strict=True):
                if run != (path, block):
                    close(True)
                    run, offset, rng, edge = (path, block), start, None, True
                if rng != offset // range_bytes:
                    close(False)
                    edge, rng, at, held = rng is None, offset // range_bytes, offset, bytearray()
                held += hashlib.sha256(piece).digest()
                offset += len(piece) + 1
            yield out()
        close(True)
        yield out()
    return digested


def range_digests(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (path, k, digest): the digest of every byte range of the files that holds the start of a piece."""
    pieces = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    sizes = pieces.groupBy("path", "block").agg(F.sum(F.octet_length("piece") + 1).alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of a file
    starts = sizes.select("path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    # One row of about 100 bytes per split of spark.sql.files.maxPartitionBytes; the join must keep the order of the scan.
    found = pieces.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "start", "piece").mapInArrow(_digested(range_bytes), "path string, k long, at long, edge boolean, data binary")
    whole = found.where("not edge").select("path", "k", F.lower(F.hex("data")).alias("digest"))
    parts = found.where("edge").groupBy("path", "k").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p"))  # the parts of one range
    joined = F.aggregate("p", F.lit(b""), lambda held, x: F.concat(held, x["data"]))
    return whole.union(parts.select("path", "k", F.sha2(joined, 256).alias("digest")))


def tree_manifest(spark: SparkSession, path: str, name=base_name, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Nodes (file_name, level, k, digest, file_size_bytes) of every file under ``path``: level 0 are ranges, level ``HEIGHT`` is the file, with its size.

    Write it before use; every level is computed from the one below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name(F.col("path")).alias("file_name"), F.col("length").alias("file_size_bytes"))
    level = range_digests(spark, path, range_bytes).select(name(F.col("path")).alias("file_name"), "k", "digest")
    out = level.withColumn("level", F.lit(0))
    for height in range(1, HEIGHT + 1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("k", "digest"))), lambda c: F.concat_ws(":", c["k"], c["digest"]))  # FANOUT at most
        level = level.groupBy("file_name", F.floor(F.col("k") / FANOUT).alias("k")).agg(F.sha2(F.array_join(children, ","), 256).alias("digest"))
        if height < HEIGHT:
            out = out.unionByName(level.withColumn("level", F.lit(height)))
    whole = F.sha2(F.concat_ws("|", F.coalesce("digest", F.lit("")), F.col("file_size_bytes")), 256)
    top = files.join(level, "file_name", "left").select("file_name", F.lit(0).cast("long").alias("k"), whole.alias("digest"), F.lit(HEIGHT).alias("level"), "file_size_bytes")
    return out.withColumn("file_size_bytes", F.lit(None).cast("long")).unionByName(top).select("file_name", "level", "k", "digest", "file_size_bytes")


def _differing(stored: DataFrame, now: DataFrame, level: int, parents: DataFrame | None) -> DataFrame:
    """Nodes (file_name, k, before, after) of a level that are not the same in both, below the given parents."""
    sides = []
    for nodes, side in ((stored, "before"), (now, "after")):
        own = nodes.where(F.col("level") == level).select("file_name", "k", F.col("digest").alias(side))
        if parents is not None:
            own = own.withColumn("parent", F.floor(F.col("k") / FANOUT)).join(parents.select("file_name", F.col("k").alias("parent")), ["file_name", "parent"], "left_semi").drop("parent")
        sides.append(own)
    return sides[0].join(sides[1], ["file_name", "k"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def verify_tree(stored: DataFrame, now: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per file of either manifest: file_name, status, changed_ranges and first_changed_byte (the start of the first range that differs)."""
    top = _differing(stored, now, HEIGHT, None)
    changed = top.where("before is not null and after is not null")
    for level in range(HEIGHT - 1, -1, -1):
        changed = _differing(stored, now, level, changed)
    ranges = changed.groupBy("file_name").agg(F.count(F.lit(1)).alias("changed_ranges"), (F.min("k") * range_bytes).alias("first_changed_byte"))
    names = stored.where(F.col("level") == HEIGHT).select("file_name").union(now.where(F.col("level") == HEIGHT).select("file_name")).distinct()
    status = (F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), "TAMPERED").when(F.col("before").isNotNull(), "MISSING")
              .when(F.col("after").isNotNull(), "NEW").otherwise("AUTHENTIC"))
    return (names.join(top.drop("k"), "file_name", "left").join(ranges, "file_name", "left")
            .select("file_name", status.alias("status"), F.coalesce("changed_ranges", F.lit(0)).alias("changed_ranges"), "first_changed_byte"))
