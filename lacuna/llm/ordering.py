"""Training order: give every token sequence a global slot and write the sequences in slot order as fixed-stride shards.

A document's token ids are cut into sequences of ``length``. A sequence is known by (doc_id, part), which is one number of a domain. A keyed
Feistel network permutes the next larger power of four; numbers that fall outside the domain walk on along their cycle until
they are inside. Sequences in the order of the permuted numbers are the training order. The domain has numbers that no sequence uses,
so slots are made gapless: the permuted numbers are cut into equal ranges, the ranges counted in a first pass, and the rank within a
range added to the range's first slot. The numbers are uniform, so ranges are even whatever the ids or sources are.

Each range is one shard: records of one fixed stride (a 24-byte header, then the ids, padded), so slot ``s`` lies at
``(s - first_slot) * stride``. A reader can start at any slot, and a lost task rewrites its shard bit for bit. Shards are
written as Parquet rows that each hold a run of records, so any store that Spark writes to will do.

Defined cases: a null or empty text has one sequence without ids; a null doc_id counts as the number below the smallest; rows with
equal doc_id are ordered by content within a slot's tie; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import stage, table

LENGTH = 2048
SHARD_BYTES = 8 << 20
RUN_BYTES = 1 << 20
KEYS = (0x3C6EF372, 0x1B873593, 0x7F4A7C15, 0x2545F491)
NULL_ID = -(1 << 63)
HEADER = np.dtype([("doc_id", "<i8"), ("part", "<i8"), ("n_ids", "<i4"), ("crc32", "<u4")])


def feistel(x: np.ndarray, domain: int, keys=KEYS) -> np.ndarray:
    """The keyed permutation of 0..domain-1, by cycle-walking over the next power of four."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            m = (right * np.uint64(0x9E3779B1) + np.uint64(k)) & np.uint64(0xFFFFFFFF)
            m ^= m >> np.uint64(15)
            m = (m * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
            m ^= m >> np.uint64(13)
            left, right = right, left ^ (m & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x).astype(np.uint64))
    while (outside := out >= np.uint64(domain)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _cut(length: int, low: int, parts: int, domain: int, ranges: int, payload: bool):
    """Batches of (doc_id, bytes of ids) to one row per sequence; the ids are slices of the incoming buffer."""
    def cut(it):
        for batch in it:
            ids, data = batch.column("doc_id"), batch.column("ids")
            offsets = np.frombuffer(data.buffers()[1], np.int32 if pa.types.is_binary(data.type) else np.int64)[data.offset:data.offset + len(data) + 1].astype(np.int64)
            n = np.maximum(1, -(-np.diff(offsets) // length))
            row = np.repeat(np.arange(len(ids)), n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = offsets[:-1][row] + part * length
            number = (ids.fill_null(low - 1).to_numpy(zero_copy_only=False)[row] - (low - 1)) * parts + part
            order = feistel(number, domain)
            columns = {"range": pa.array((order.astype(object) * ranges // domain).astype(np.int32) if domain * ranges >= 1 << 63 else (order * ranges // domain).astype(np.int32))}
            if payload:
                ends = np.append(start, offsets[-1]).astype(np.int32)
                sliced = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), data.buffers()[2]])
                columns |= {"number": pa.array(order), "doc_id": ids.take(pa.array(row)), "part": pa.array(part), "ids": sliced}
            yield pa.RecordBatch.from_pydict(columns)
    return cut


def _shard(length: int, run_bytes: int):
    """All sequences of a range to its records, in slot order, cut into runs."""
    stride = HEADER.itemsize + length

    def shard(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        order = data.select(["number", "ids"]).append_column("i", pa.array(np.arange(data.num_rows))).sort_by([("number", "ascending"), ("ids", "ascending")])["i"].to_numpy()
        ids, docs, parts = data["ids"].to_pylist(), data["doc_id"].to_pylist(), data["part"].to_numpy()
        first, shard_no, per = data["first_slot"][0].as_py(), data["range"][0].as_py(), max(1, run_bytes // stride)
        rows = {"shard": [], "first_slot": [], "n_records": [], "stride": [], "payload": []}
        for at in range(0, len(order), per):
            some = order[at:at + per]
            block = np.zeros((len(some), stride), np.uint8)
            for k, i in enumerate(some):
                head = np.array([(NULL_ID if docs[i] is None else docs[i], parts[i], len(ids[i]), zlib.crc32(ids[i]))], HEADER)
                block[k, :HEADER.itemsize] = head.view(np.uint8)
                block[k, HEADER.itemsize:HEADER.itemsize + len(ids[i])] = np.frombuffer(ids[i], np.uint8)
            for name, value in (("shard", shard_no), ("first_slot", first + at), ("n_records", len(some)), ("stride", stride), ("payload", block.tobytes())):
                rows[name].append(value)
        return pa.table({"shard": pa.array(rows["shard"], pa.int32()), "first_slot": pa.array(rows["first_slot"], pa.int64()), "n_records": pa.array(rows["n_records"], pa.int32()),
                         "stride": pa.array(rows["stride"], pa.int32()), "payload": pa.array(rows["payload"], pa.binary())})
    return shard


def materialise(tokens: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards of a table (doc_id, ids: little-endian token ids of fixed width as binary) and return them.

    Rows: shard, first_slot, n_records, stride, payload. ``length`` counts bytes of a sequence, so a multiple of the ids' width."""
    tokens = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))
    size = F.octet_length("ids")
    low, high, most, total = tokens.agg(F.min("doc_id"), F.max("doc_id"), F.max(size), F.sum(size + length)).first()
    low, high = low or 0, high or 0
    parts = max(1, -(-(most or 0) // length))
    domain = (high - low + 2) * parts
    if domain >= 1 << 60:
        raise ValueError("ids are too far apart: number the documents first")
    ranges = max(1, -(-(total or 0) // shard_bytes))
    counts = tokens.mapInArrow(_cut(length, low, parts, domain, ranges, False), "range int").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    firsts = stage(counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot")), "ranges")
    cut = tokens.mapInArrow(_cut(length, low, parts, domain, ranges, True), "range int, number long, doc_id long, part long, ids binary")
    written = cut.join(firsts, "range").groupBy("range").applyInArrow(_shard(length, RUN_BYTES), "shard int, first_slot long, n_records int, stride int, payload binary")
    return stage(written, "shards")


def _read(it):
    for batch in it:
        for row in batch.to_pylist():
            block = np.frombuffer(row["payload"], np.uint8).reshape(row["n_records"], row["stride"])
            head = block[:, :HEADER.itemsize].copy().view(HEADER)[:, 0]
            ids = [block[k, HEADER.itemsize:HEADER.itemsize + n].tobytes() for k, n in enumerate(head["n_ids"])]
            n = row["n_records"]
            yield pa.RecordBatch.from_pydict({
                "slot": pa.array(row["first_slot"] + np.arange(n)), "shard": pa.array(np.full(n, row["shard"], np.int32)), "doc_id": pa.array(head["doc_id"], mask=head["doc_id"] == NULL_ID), "part": pa.array(head["part"]),
                "n_ids": pa.array(head["n_ids"]), "ids": pa.array(ids, pa.binary()), "intact": pa.array([zlib.crc32(x) == c for x, c in zip(ids, head["crc32"], strict=True)])})


def read_sequences(shards: DataFrame) -> DataFrame:
    """Sequences of shards by slot: slot, shard, doc_id, part, n_ids, ids, and whether the checksum holds."""
    return shards.select("shard", "first_slot", "n_records", "stride", "payload").mapInArrow(_read, "slot long, shard int, doc_id long, part long, n_ids int, ids binary, intact boolean")


def byte_tokens(docs: DataFrame) -> DataFrame:
    """Byte-level token ids (0 to 255, one byte each) of whole texts."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("ids"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    shards = materialise(byte_tokens(table(spark, folder, "documents")))
    return read_sequences(shards).select("doc_id", "part", "slot", "shard", F.col("n_ids").cast("long").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"), "intact")
