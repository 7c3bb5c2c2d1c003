"""File manifests with checksums, and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A batch of chunks for Python workers is 10,000 rows by default, so this bounds what a task holds.
CHUNK_BYTES = 4096
#: The text reader would unpack files of these names.
PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|xz|lzo|Z)$"
_MARK = b"\xef\xbb\xbf"
_CHUNK = "path string, size long, block long, place long, data binary"


def _chunked(size: int):
    """Pieces in the order of the scan to chunks of ``size`` bytes; every piece is followed by a line feed."""
    def runs(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(path, size, block), first row and row after the last of every run of rows of one split."""
        paths, blocks, n = batch["path"], batch["block"], batch.num_rows
        same = lambda a, b: blocks[a] == blocks[b] and paths[a] == paths[b]
        cuts = [0, n] if n and same(0, n - 1) else [0, *[k for k in range(1, n) if not same(k - 1, k)], n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield (paths[a].as_py(), batch["size"][a].as_py(), blocks[a].as_py()), a, b

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, place = None, bytearray(), 0

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal place
            upto = len(held) if last else len(held) - len(held) % size
            data = [bytes(held[k:min(k + size, upto)]) for k in range(0, upto, size)]
            del held[:upto]
            place += len(data)
            columns = [[x] * len(data) for x in run] + [range(place - len(data), place), data]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                              names=["path", "size", "block", "place", "data"])

        for batch in batches:
            for now, a, b in runs(batch):
                if run != now:
                    if run is not None:
                        yield cut(True)
                    run, place = now, 0
                held += b"\n".join(batch["piece"].slice(a, b - a).to_pylist()) + b"\n"
                yield cut(False)
        if run is not None:
            yield cut(True)
    return chunked


def _hashed(mark: bytes):
    """Chunks, file by file and in order, to (path, sha256_checksum). A file's size tells whether a line feed ends it and whether the reader
    left out a byte order mark, which is known at the end only, so the digest with a mark is kept as well."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            missing = of[1] - total
            if missing not in (-1, 0, 2, 3):
                raise ValueError(f"{of[0]} has {of[1]} bytes, but {total} were read")
            digest = marked if missing > 0 else plain
            digest.update(last if missing in (0, 3) else last[:-1])
            return pa.RecordBatch.from_pydict({"path": [of[0]], "sha256_checksum": [digest.hexdigest()]})

        of = None
        for batch in batches:
            for path, size, data in zip(*(batch[c].to_pylist() for c in ("path", "size", "data")), strict=True):
                if of != (path, size):
                    if of is not None:
                        yield close()
                    of, plain, marked, last, total = (path, size), hashlib.sha256(), hashlib.sha256(mark), b"", 0
                plain.update(last)
                marked.update(last)
                last = data
                total += len(data)
        if of is not None:
            yield close()
    return hashed


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file under ``path``.

    A digest needs a file's bytes in order, but nowhere at once: files are read as pieces between line feeds by many tasks, dealt by file as small
    chunks and sorted, which spills, and one task per file hashes the stream. A piece between two line feeds, and a file of a name that readers unpack
    (``PACKED``), is held whole."""
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"))
    unread = F.when(F.col("file_size_bytes") > 0, F.lit(_MARK)).otherwise(F.lit(b""))  # files without a piece
    plain = ~F.col("_metadata.file_name").rlike(PACKED)
    pieces = spark.read.option("lineSep", "\n").text(path).where(plain).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"))
    chunks = pieces.mapInArrow(_chunked(CHUNK_BYTES), _CHUNK).repartition("path").sortWithinPartitions("path", "block", "place")
    streamed = chunks.select("path", "size", "data").mapInArrow(_hashed(_MARK), "path string, sha256_checksum string")
    packed = spark.read.format("binaryFile").load(path).where(~plain).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256_checksum"))
    # Not broadcast: a broadcast has a time limit, and this side reads all files.
    return (listed.join(streamed.union(packed).hint("merge"), "path", "left")
            .select("file_name", "file_size_bytes", F.coalesce("sha256_checksum", F.sha2(unread, 256)).alias("sha256_checksum")))


def verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare a stored manifest with what is there now."""
    now = actual.select("file_name", F.col("sha256_checksum").alias("found"))
    return manifest.join(now, "file_name", "left").select(
        "file_name", F.col("sha256_checksum").alias("expected"), "found",
        F.when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.col("sha256_checksum"), "AUTHENTIC").otherwise("TAMPERED").alias("status"))
