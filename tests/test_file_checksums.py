"""Checksums of files that are never held whole: equal to a plain digest, whatever lies at splits and ends."""

import gzip
import hashlib
import random

import pytest

from lacuna.sources import manifests as MF

LIMITS = {"spark.sql.sources.binaryFile.maxLength": "64"}


def files():
    rng = random.Random(3)
    data = {f"plain {k}.parquet": rng.randbytes(20_000 * k + 7) for k in range(1, 4)}
    data |= {"empty": b"", "feed": b"\n", "feeds": b"\n\n\n", "no_feed": b"x" * 9000, "ends": b"ab\n" * 4000, "returns": b"a\r\n\rb\r\n" * 900,
             "mark": b"\xef\xbb\xbf", "mark_a": b"\xef\xbb\xbfa\nb", "mark_feed": b"\xef\xbb\xbf" * 2 + b"a\n", "zeros": bytes(5000), "chunk": b"y" * (MF.CHUNK_BYTES - 1) + b"\n"}
    return data | {"small.gz": gzip.compress(b"a", mtime=0)}  # of a name that readers unpack, so read whole


@pytest.mark.parametrize("split", ["500b", "7000b", "128m"])
def test_streamed_digests_are_those_of_the_files(spark, tmp_path, split):
    for name, data in files().items():
        (tmp_path / name).write_bytes(data)
    conf = LIMITS | {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": split}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)  # reading more than 64 bytes of a file at once fails
        got = {r.file_name: (r.file_size_bytes, r.sha256_checksum) for r in MF.file_checksums(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files().items() if data}  # Spark lists no empty file
