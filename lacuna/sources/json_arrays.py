"""Records of one big JSON document, read in parallel: every task finds the records of its own byte range.

Spark splits a text file at a separator of our choice, here the closing brace, so each task reads a range of the file whatever its line
breaks are. Whether a brace is structure depends on all that comes before it, but only through two facts: are we inside a string, and how deep
are the brackets. A first pass tells for each range what it does to both, for either way it may start (quotes flip the first; brackets
count only outside of strings; no escape crosses a closing brace). Summing these over the ranges of a file, one small row each, gives every
range its true start, and a second pass cuts the records out. A record that crosses ranges leaves a piece in each of them, and only those
pieces are shuffled and joined.

Defined cases: records are the objects that open at bracket depth ``level`` (1: elements of a top-level array; 2: of arrays in a top-level object);
other elements are skipped; an empty file or array has no records; a byte order mark and any white space are ignored; a document that is cut off in
the middle loses its unfinished record. One record must fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUOTE, SLASH, OPEN, CLOSE = ord('"'), ord("\\"), (ord("{"), ord("[")), (ord("}"), ord("]"))


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """+1, -1 or 0 per byte (a bracket opens, closes, neither) and whether the end lies inside a string, for a start inside or outside of one."""
    quote = data == QUOTE
    at = np.flatnonzero(data == SLASH)
    if len(at):  # a quote behind an odd run of backslashes is part of its string
        run_start = np.r_[True, np.diff(at) > 1]
        first = at[np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))]
        odd = at[(at - first) % 2 == 0]
        quote[odd[odd + 1 < len(data)] + 1] = False
    flips = np.cumsum(quote) + inside
    outside = flips % 2 == 0
    step = np.isin(data, OPEN).astype(np.int8) - np.isin(data, CLOSE).astype(np.int8)
    return np.where(outside, step, 0), bool(len(data) and flips[-1] % 2) if len(data) else inside


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, bool]]:
    """(file, range, text, last): the text between closing braces put together again, in runs of a few MB. ``last`` marks the end of the
    range in this task; the brace behind its last piece is left to the caller, as a file's last piece has none."""
    held: list = []
    for batch in batches:
        for file, block, piece in zip(*(batch[c].to_pylist() for c in ("file", "block", "piece")), strict=True):
            if held and (held[0], held[1]) != (file, block):
                yield held[0], held[1], b"}".join(held[2]), True
                held = []
            if not held:
                held = [file, block, [], 0]
            held[2].append(piece)
            held[3] += len(piece)
            if held[3] > 4 << 20 and len(held[2]) > 1:
                last = held[2].pop()
                yield file, block, b"}".join(held[2]) + b"}", False
                held = [file, block, [last], len(last)]
    if held:
        yield held[0], held[1], b"}".join(held[2]), True


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does: whether it flips the state of being in a string, and its change of depth for both starts."""
    flip, change = False, [0, 0]
    for file, block, text, last in _ranges(batches):
        data = np.frombuffer(text + b"}" if last else text, np.uint8)
        ends = []
        for start in (0, 1):
            step, end = structure(data, bool(start) != flip)
            change[start] += int(step.sum())
            ends.append(end)
        flip = ends[0]
        if last:
            yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int64()), "flip": pa.array([int(flip)], pa.int64()),
                                              "outside": pa.array([change[0]], pa.int64()), "inside": pa.array([change[1]], pa.int64())})
            flip, change = False, [0, 0]


def _records(level: int):
    """Records of each range in order, whole, or in pieces: ``part`` 0 is whole, 1 begins a record, 2 carries one on, 3 ends it."""
    def cut(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[pa.RecordBatch]:
        begun, file_block, n = b"", None, 0
        inside, depth, is_last, opened = False, 0, False, False
        for file, block, text, last in _ranges(batches):
            if (file, block) != file_block:
                file_block, n, begun = (file, block), 0, b""
                inside, depth, is_last = starts[file, block]
                opened = depth > level  # a record of an earlier range goes on; its level says whether it is one of ours
                carried = opened
            if last and not is_last:
                text += b"}"
            data = np.frombuffer(text, np.uint8)
            step, inside = structure(data, inside)
            after = depth + np.cumsum(step, dtype=np.int64)
            depth = int(after[-1]) if len(after) else depth
            begins = np.flatnonzero((step == 1) & (data == OPEN[0]) & (after == level + 1))
            finishes = np.flatnonzero((step == -1) & (data == CLOSE[0]) & (after == level)) + 1
            rows, at = [], 0
            if opened:
                if len(finishes):
                    rows.append((3 if carried else 0, begun + text[:finishes[0]]))
                    finishes, opened, carried, begun = finishes[1:], False, False, b""
                else:
                    begun += text
            k = min(len(begins), len(finishes))
            rows += [(0, text[i:j]) for i, j in zip(begins[:k].tolist(), finishes[:k].tolist(), strict=True)]
            if len(begins) > k:
                opened, begun = True, text[int(begins[k]):]
            if last and opened:
                rows.append((2 if carried else 1, begun))
            at = np.arange(n, n + len(rows))
            n += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()), pa.array(at + block, pa.int64()),
                                              pa.array([p for p, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["file", "block", "place", "part", "record"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[tuple[str, int], tuple[bool, int, bool]] = {}

        def noted():
            for batch in batches:
                for key in {*zip(*(batch[c].to_pylist() for c in ("file", "block", "in_string", "depth", "is_last")), strict=True)}:
                    starts[key[:2]] = key[2:]
                yield batch
        yield from cut(noted(), starts)
    return records


def json_records(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """Rows (file, place, record): the records of JSON documents as text, and their order within a file."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    effects = pieces.mapInArrow(_effects, "file string, block long, flip long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a file
    ahead = Window.partitionBy("file").orderBy(F.desc("block"))
    states = effects.withColumn("in_string", F.coalesce(F.sum("flip").over(before) % 2, F.lit(0)) == 1)
    states = states.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    states = states.select("file", "block", "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), (F.row_number().over(ahead) == 1).alias("is_last"))
    # One row of about 100 bytes per range of spark.sql.files.maxPartitionBytes; the join must keep the order of the scan.
    found = pieces.join(F.broadcast(states), ["file", "block"]).mapInArrow(_records(level), "file string, block long, place long, part int, record binary")
    return _joined(found)


def _joined(found: DataFrame) -> DataFrame:
    """Whole records, and records put together from their pieces in neighbouring ranges."""
    whole = found.where("part = 0").select("file", "place", "record")
    order = Window.partitionBy("file").orderBy("place")  # at most two pieces per range
    pieces = found.where("part > 0").withColumn("k", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order))
    lists = pieces.groupBy("file", "k").agg(F.array_sort(F.collect_list(F.struct("place", "part", "record"))).alias("p"))  # the pieces of one record
    lists = lists.where(F.get(F.reverse("p"), F.lit(0))["part"] == 3)  # a document cut off ends in an unfinished record
    joined = lists.select("file", F.get("p", F.lit(0))["place"].alias("place"), F.array_join(F.transform("p", lambda x: x["record"].cast("string")), "").alias("record"))
    return whole.withColumn("record", F.col("record").cast("string")).union(joined)
