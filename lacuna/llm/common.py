"""Helpers shared by the corpus operators: stage tables, word codes, connected components."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import checkpoint_dir

#: The six ASCII white-space characters; words are what lies between them.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once under the shared checkpoint folder and return a scan of it.

    It cuts the lineage, survives lost executors, and lets the planner see the true size of what follows. The
    folder belongs to the run; whoever owns ``spark.checkpoint.dir`` clears it."""
    path = f"{checkpoint_dir(df.sparkSession)}/lacuna-llm-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written in this block goes to Python workers in batches of at most ``rows`` rows.

    By default a batch is 10,000 rows, which every core holds twice, in the JVM and in its worker; whole texts make that tens of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_text(doc_id: Column) -> Column:
    """A doc_id as text; null has a text of its own, so no row drops out of a hash."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``: the fold of a document."""
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(modulus)).cast("int")


def batches(it: Iterator, budget: int = 4_000_000) -> Iterator[list]:
    """Cut a stream of texts into lists of about ``budget`` characters, so long texts don't pile up in a worker."""
    held, size = [], 0
    for text in it:
        held.append(text or "")
        size += len(held[-1]) + 64
        if size >= budget:
            yield held
            held, size = [], 0
    if held:
        yield held


class WordCodes(dict):
    """Word bytes to a 64-bit hash, remembered for up to ``limit`` words; the hash never depends on what is remembered."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        code = word_hash(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = code
        return code


def word_hash(word: bytes) -> int:
    """A 63-bit hash of a word, the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node of each one's component, by pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low != high
        if not open_.any():
            break
        u, v, low, high = u[open_], v[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _contract(it):
    """Links of a partition to the spanning stars of its components, piece by piece, so memory stays bounded."""
    import pandas as pd

    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in it:
        a, b = np.concatenate([a, pdf["a"].to_numpy(np.int64)]), np.concatenate([b, pdf["b"].to_numpy(np.int64)])
        if len(a) > 2_000_000:
            nodes, roots = local_roots(a, b)
            a, b = nodes[nodes != roots], roots[nodes != roots]
            if len(a) > 1_000_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, roots = local_roots(a, b)
    yield pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Rows (node, root): every node of ``links`` (a, b: long) with the smallest node that links reach.

    Each partition first contracts its own links to stars. Then rounds on Spark: every node hooks to its smallest
    neighbour, links are renamed to the hooks, and what became a loop goes. Names of one round are composed with those of the
    next, so the number of rounds is logarithmic for the trees that near-copies make. A node with very many links is
    aggregated map side first, and its joins can be split. Raises if links remain after ``max_rounds``."""
    edges = stage(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
                  .mapInPandas(_contract, "a long, b long").dropDuplicates(), "links")
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    names = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "names")
    for _ in range(max_rounds):
        names = _jumped(names)
        left = (edges.join(names.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
                .join(names.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                .where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
                .mapInPandas(_contract, "a long, b long").dropDuplicates())
        left = stage(left, "links")
        if left.isEmpty():
            return names
        both = left.union(left.select(F.col("b"), F.col("a")))
        hooks = both.groupBy(F.col("a").alias("root")).agg(F.least(F.col("root"), F.min("b")).alias("up"))
        names = stage(names.join(hooks, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "names")
    raise RuntimeError("links remain after the last round")


def _jumped(names: DataFrame) -> DataFrame:
    """Follow names to their ends: a name always points to a smaller node, so this halves the depth each time."""
    while True:
        up = names.select(F.col("node").alias("root"), F.col("root").alias("up"))
        out = stage(names.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.coalesce(F.col("up") != F.col("root"), F.lit(False)).alias("moved")), "names")
        moved = not out.where("moved").isEmpty()
        names = out.select("node", "root")
        if not moved:
            return names


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype)
