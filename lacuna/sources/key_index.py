"""Index of the keys that a table already holds, so that an import need not read the table.

Keys are kept as digests in hash buckets, one folder each, with a filter beside every bucket: 64-bit words in which each key
has set four bits. An import hashes its own keys, reads the filters of the buckets they fall into, and then only the buckets in
which the filter lets a key pass. A bucket holds about ``capacity`` keys; the number of buckets doubles as the table grows, so what a
batch of a given size reads doesn't grow with the table.

A key is a tuple of columns. A table may be known by several kinds of keys; a row is known if any of its keys is. A null in a key
equals nothing. One importer at a time may extend an index. Its one-row state is closed while nothing is being written: if
an import died half-way, or the table is older than its index, the index is made anew from the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lacuna.session import checkpoint_dir

CAPACITY = 1 << 20
KEYS_A_WORD = 4
_STATE = "generation string, buckets int, capacity long, n_keys long, closed boolean"


def digest(keys: list[str], kind: int) -> Column:
    """Digest of the key columns of one kind, null if any of them is null."""
    some_null = F.lit(False)
    for name in keys:
        some_null = some_null | F.col(name).isNull()
    body = F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(name).cast("string").alias(f"k{i}") for i, name in enumerate(keys)]))
    return F.when(~some_null, F.unhex(F.sha2(body, 256)))


def digests(rows: DataFrame, kinds: list[list[str]]) -> DataFrame:
    """All keys of all rows as (digest)."""
    each = rows.select(F.explode(F.array(*[digest(keys, kind) for kind, keys in enumerate(kinds)])).alias("digest"))
    return each.where("digest IS NOT NULL")


def _placed(keys: DataFrame, buckets: int, capacity: int) -> DataFrame:
    """(digest, bucket, word, mask): where a key lies and which bits of its filter word it sets."""
    words = max(1, capacity // KEYS_A_WORD)
    h, g = F.xxhash64("digest"), F.xxhash64("digest", F.lit(1))
    out = keys.select("digest", h.alias("h"), g.alias("g"))
    bit = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(g, {6 * i}) & 63 AS int))" for i in range(4))
    return out.select("digest", F.expr(f"cast(h & {buckets - 1} AS int)").alias("bucket"), F.expr(f"cast(shiftrightunsigned(h, 32) % {words} AS int)").alias("word"), F.expr(bit).alias("mask"))


@dataclass(frozen=True)
class KeyIndex:
    """State of an index below ``path``; see :func:`opened` and :func:`built`."""

    path: str
    generation: str
    buckets: int
    capacity: int
    n_keys: int

    def _folder(self, part: str) -> str:
        return f"{self.path}/{self.generation}/{part}"

    def note(self, spark: SparkSession, closed: bool) -> None:
        row = [(self.generation, self.buckets, self.capacity, self.n_keys, closed)]
        spark.createDataFrame(row, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state")

    def read(self, spark: SparkSession, part: str, buckets: list[int]) -> DataFrame:
        """The ``keys`` or ``filters`` of some buckets; folders of others are not opened."""
        ddl = {"keys": "digest binary, bucket int", "filters": "word int, bits long, bucket int"}[part]
        try:
            return spark.read.schema(ddl).parquet(self._folder(part)).where(F.col("bucket").isin(buckets))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], ddl)

    def suspects(self, probes: DataFrame) -> DataFrame:
        """Placed keys that their filters let pass: all known ones and a small share of the others."""
        filters = self.read(probes.sparkSession, "filters", _numbers(probes))
        return probes.join(filters, ["bucket", "word"]).where("(bits & mask) = mask").select("bucket", "digest").distinct()

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (digest) that the index holds."""
        spark = keys.sparkSession
        checkpoint_dir(spark)
        probes = _placed(keys.distinct(), self.buckets, self.capacity).checkpoint()
        may = self.suspects(probes).checkpoint()
        return may.join(self.read(spark, "keys", _numbers(may)), ["bucket", "digest"], "left_semi").select("digest")

    def only_new(self, rows: DataFrame, kinds: list[list[str]]) -> DataFrame:
        """The rows none of whose keys is known."""
        if not kinds or not self.n_keys:
            return rows
        found = self.known(digests(rows, kinds)).select(F.col("digest").alias("__known")).checkpoint()
        for kind, keys in enumerate(kinds):
            rows = rows.join(found, digest(keys, kind) == F.col("__known"), "left_anti")
        return rows

    def write(self, keys: DataFrame) -> int:
        """Add keys to the buckets and filters, and tell how many; the caller keeps the state."""
        spark = keys.sparkSession
        checkpoint_dir(spark)
        placed = _placed(keys.distinct(), self.buckets, self.capacity).repartition("bucket").checkpoint()
        placed.select("digest", "bucket").write.mode("append").partitionBy("bucket").parquet(self._folder("keys"))
        filters = placed.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        filters.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._folder("filters"))
        return placed.count()

    def opened_for_writing(self, spark: SparkSession) -> None:
        """To be called before the table is extended: until :meth:`extended` the index counts as unfinished."""
        self.note(spark, False)

    def extended(self, keys: DataFrame) -> KeyIndex:
        """The index with more keys, in more buckets if it has outgrown its own."""
        spark = keys.sparkSession
        grown = replace(self, n_keys=self.n_keys + self.write(keys))
        if grown.n_keys > grown.buckets * grown.capacity:
            whole = spark.read.schema("digest binary").parquet(grown._folder("keys"))
            grown = _fresh(grown.path, grown.n_keys, grown.capacity)
            grown.write(whole)
        grown.note(spark, True)
        return grown


def _numbers(rows: DataFrame) -> list[int]:
    """Buckets that rows fall into: at most as many as there are buckets, a millionth of the keys."""
    return [r[0] for r in rows.select("bucket").distinct().collect()]


def _fresh(path: str, n_keys: int, capacity: int) -> KeyIndex:
    """An empty generation with room for twice the keys."""
    buckets = 1
    while buckets * capacity < 2 * n_keys:
        buckets *= 2
    return KeyIndex(path, uuid.uuid4().hex, buckets, capacity, n_keys)


def built(table: DataFrame, kinds: list[list[str]], path: str, capacity: int = CAPACITY) -> KeyIndex:
    """A new index of a table's keys."""
    spark = table.sparkSession
    keys = digests(table, kinds)
    index = _fresh(path, keys.count(), capacity)
    index = replace(index, n_keys=index.write(keys))
    index.note(spark, True)
    return index


def opened(spark: SparkSession, path: str) -> KeyIndex | None:
    """The index below ``path``, or none if there is none or an import left it unfinished."""
    try:
        states = spark.read.schema(_STATE).parquet(f"{path}/state").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if len(states) != 1 or not states[0]["closed"]:
        return None
    return KeyIndex(path, states[0]["generation"], states[0]["buckets"], states[0]["capacity"], states[0]["n_keys"])
