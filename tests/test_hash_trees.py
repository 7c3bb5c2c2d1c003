"""Hash trees of files: independent of splits, and exact about what changed."""

import hashlib
import os

import pytest

from lacuna.plans.stages import scratch, written
from lacuna.sources import hash_trees as HT

SIZE = 64


def content(n, seed):
    out = b"".join(hashlib.sha256(b"%d %d" % (seed, k)).digest()[: 5 + k % 27].replace(b"\n", b"") + b"\r\n"[k % 2:] for k in range(n))
    return out + b"no line feed at the end"


def plain(data):
    ranges, at = {}, 0
    for piece in data.split(b"\n"):
        if at < len(data):
            ranges.setdefault(at // SIZE, []).append(hashlib.sha256(piece).digest())
        at += len(piece) + 1
    return {k: hashlib.sha256(b"".join(p)).hexdigest() for k, p in ranges.items()}


@pytest.mark.parametrize("split", ["100b", "1000b", "128m"])
def test_ranges_do_not_depend_on_splits(spark, tmp_path, split):
    files = {"a": content(90, 1), "b": content(3, 2), "c": b"", "d": b"\n\n\n", "e": b"x" * 500 + b"\n" + b"y" * 300}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, split)
        got = {(r.path.rsplit("/", 1)[1], r.k): r.digest for r in HT.range_digests(spark, str(tmp_path), SIZE).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(name, k): v for name, data in files.items() for k, v in plain(data).items()}


def test_what_changed(spark, tmp_path):
    root = scratch(spark, "test")
    for side in ("before", "after"):
        os.mkdir(tmp_path / side)
        for k in range(6):
            data = bytearray(content(60, k))
            if side == "after" and k == 1:
                data[300] ^= 1  # one byte in the middle
            if side == "after" and k == 2:
                data += b"\n"  # pieces are the same, the length tells
            if not (side == "after" and k == 3) and not (side == "before" and k == 4):
                (tmp_path / side / f"f{k}").write_bytes(bytes(data))
    stored, now = (written(HT.tree_manifest(spark, str(tmp_path / s), range_bytes=SIZE), s, root) for s in ("before", "after"))
    got = {r.file_name: (r.status, r.changed_ranges, r.first_changed_byte) for r in HT.verify_tree(stored, now, SIZE).collect()}
    a, b = (plain((tmp_path / s / "f1").read_bytes()) for s in ("before", "after"))
    changed = sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
    assert len(changed) == 1
    assert got == {"f0": ("AUTHENTIC", 0, None), "f1": ("TAMPERED", 1, changed[0] * SIZE), "f2": ("TAMPERED", 0, None),
                   "f3": ("MISSING", 0, None), "f4": ("NEW", 0, None), "f5": ("AUTHENTIC", 0, None)}
    assert {r.status for r in HT.verify_tree(stored, stored, SIZE).collect()} == {"AUTHENTIC"}
