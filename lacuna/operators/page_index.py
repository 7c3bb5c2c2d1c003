"""Pages of a long table in a fixed order, by place or by key.

The table is cut into ranges of its order, once. Every row is stored with its place in its range, and an index holds, for each range, how
many rows lie before it, how many it has, and its first and last key. A page then reads the index, through filters, and the ranges that it
overlaps: page 1,000,000 costs what page 1 costs. Rows whose keys follow all stored keys can be appended; nothing stored is touched, and
of two writers that append at once one gets a ``commit_log.Conflict``.

Nulls come last within their key. Keys should tell rows apart, as (timestamp, number) do: rows with equal keys lie in one range, in an order
that is fixed when they are written. An empty table has no range and only empty pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lacuna.sources import commit_log as CL
from lacuna.sources import sinks as SK

ROWS_PER_RANGE = 1_000_000
_GROUP = 4096  # ranges whose counts are summed up together
_PLACE_BITS = 33  # of monotonically_increasing_id: place in the partition below, partition above


def later(names: Sequence[str], key: Sequence, prefix: str = "") -> Column:
    """Does a row come after ``key``?"""
    out = F.lit(False)
    for name, value in reversed(list(zip(names, key))):
        col = F.col(prefix + name)
        if value is None:
            out = col.isNull() & out
        else:
            out = col.isNull() | (col > F.lit(value)) | ((col == F.lit(value)) & out)
    return out


def equal(names: Sequence[str], key: Sequence, prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(prefix + n).eqNullSafe(F.lit(v)) for n, v in zip(names, key)])


def _with_before(ranges: DataFrame, start: int) -> DataFrame:
    """Adds the rows before each range: sums over groups of ranges, then within each group."""
    groups = ranges.withColumn("group", F.floor(F.col("range") / _GROUP))
    inside = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.groupBy("group").agg(F.sum("rows").alias("n"))
    # One row per 4,096 ranges, that is per four thousand million rows of the table.
    over = Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"))
    return (groups.join(starts, "group")
            .withColumn("before", F.lit(start) + F.col("ahead") + F.coalesce(F.sum("rows").over(inside), F.lit(0))).drop("group", "ahead"))


class PageIndex:
    """An ordered table under ``path``, ordered by ``keys`` ascending; pages may be asked for from either end."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _order(self) -> list[Column]:
        return [F.asc_nulls_last(k) for k in self.keys]

    def index(self) -> DataFrame:
        """One row per range: folder, range, rows, before, first, last."""
        return SK.read_runs(self.spark, f"{self.path}/index").drop("batch")

    def _is_empty(self) -> bool:
        return CL.head(self.spark, f"{self.path}/index") < 0

    def total(self) -> int:
        return 0 if self._is_empty() else self.index().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def append(self, rows: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> int:
        """Store ``rows``, all of whose keys follow those stored; returns the new number of rows."""
        seen = CL.head(self.spark, f"{self.path}/index")
        start, last = 0, None
        if seen >= 0:
            tail = self.index().agg(F.sum("rows").alias("n"), F.max_by("last", "before").alias("last")).first()
            start, last = tail["n"] or 0, tail["last"]
        if last is not None and not rows.where(~later(self.keys, list(last))).isEmpty():
            raise ValueError("rows to append must follow all stored rows")
        count = rows.count()
        if not count:
            return start
        folder = uuid.uuid4().hex
        cuts = -(-count // rows_per_range)
        number = F.monotonically_increasing_id()
        placed = (rows.repartitionByRange(cuts, *self._order()).sortWithinPartitions(*self._order()).withColumn("__number", number)
                  .withColumn("__place", F.col("__number").bitwiseAND((1 << _PLACE_BITS) - 1)).withColumn("range", F.shiftright("__number", _PLACE_BITS)))
        placed.drop("__number").write.partitionBy("range").parquet(f"{self.path}/rows/{folder}")
        stored = self.spark.read.schema(placed.drop("__number").schema).parquet(f"{self.path}/rows/{folder}")
        key = F.struct(*self.keys)
        ranges = stored.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.min_by(key, "__place").alias("first"), F.max_by(key, "__place").alias("last"))
        SK.replace_run(_with_before(ranges, start).withColumn("folder", F.lit(folder)), f"{self.path}/index", {"batch": f"b{seen + 1}"}, seen)
        return start + count

    def _slice(self, begin: int, end: int) -> DataFrame:
        """Rows ``begin`` to ``end`` (exclusive) of the order, with their place in the column ``place``."""
        # At most ``end - begin`` ranges, as each has a row.
        hit = [] if end <= begin or self._is_empty() else self.index().where((F.col("before") < end) & (F.col("before") + F.col("rows") > begin)).collect()
        parts = []
        for r in hit:
            rows = self.spark.read.parquet(f"{self.path}/rows/{r['folder']}/range={r['range']}")
            first, stop = max(begin - r["before"], 0), min(end - r["before"], r["rows"])
            parts.append(rows.where((F.col("__place") >= first) & (F.col("__place") < stop))
                         .withColumn("place", F.col("__place") + r["before"]).drop("__place"))
        if parts:
            return reduce(DataFrame.unionByName, parts)
        return self._empty()

    def _empty(self) -> DataFrame:
        if self._is_empty():
            raise ValueError("nothing has been stored yet, so the columns are not known")
        folder = self.index().select("folder").first()[0]
        return (self.spark.read.parquet(f"{self.path}/rows/{folder}").drop("range").where(F.lit(False))
                .withColumn("place", F.col("__place")).drop("__place"))

    def page(self, limit: int, offset: int = 0, newest_first: bool = False) -> DataFrame:
        """One page by place, in order."""
        if newest_first:
            total = self.total()
            return self._slice(max(total - offset - limit, 0), max(total - offset, 0)).orderBy(F.desc("place"))
        return self._slice(offset, offset + limit).orderBy("place")

    def _first(self, wanted) -> int:
        """The place of the first row that ``wanted`` (of a prefix for column names) holds for; the number of rows if there is none.
        Once it holds it must hold for all later rows."""
        if self._is_empty():
            return 0
        found = self.index().where(wanted("last.")).agg(F.min_by(F.struct("folder", "range", "before"), "before")).first()[0]
        if found is None:
            return self.total()
        rows = self.spark.read.parquet(f"{self.path}/rows/{found['folder']}/range={found['range']}")
        return found["before"] + rows.where(wanted("")).agg(F.min("__place")).first()[0]

    def page_after(self, key: Sequence, limit: int) -> DataFrame:
        """The rows that follow ``key``, which need not be stored; right also when rows were appended since the page before."""
        return self.page(limit, self._first(lambda prefix: later(self.keys, key, prefix)))

    def page_before(self, key: Sequence, limit: int) -> DataFrame:
        """The rows that precede ``key``, nearest first: the next page when the newest come first."""
        end = self._first(lambda prefix: later(self.keys, key, prefix) | equal(self.keys, key, prefix))
        return self._slice(max(end - limit, 0), end).orderBy(F.desc("place"))
