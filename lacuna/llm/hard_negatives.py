"""Hard-negative mining by slots: for every anchor and positive the best rows of other labels in a window of scores.

An anchor's positives are its best rows of the same label. Each positive opens a window of scores, from a lower to an upper share of
its own score, and the windows of one anchor overlap. Their upper limits, in falling order, cut the scores below them into disjoint
slots. Every candidate falls into one slot, so a task keeps the best k per slot and the tasks' lists are merged by (anchor, slot): a
row is sent at most once however many windows it lies in. As slots follow each other in falling order, the best k of a window are the
first k of the slots from its own on, and the lower limit only shortens that list.

Vectors are rounded to integers once and written as blocks of rows. Anchors, which are a fixed share of all rows, are dealt to blocks of
bounded size by a hash of their row number; a cell is one block of anchors against a bounded run of row blocks, and its scores
are one matrix product at a time. Cells are dealt over all tasks; nothing depends on labels or ids, so neither a hot label nor a repeated
vector ends up in one of them. Nothing is broadcast, and a task holds one cell and the best k per anchor and slot.

Defined cases: rows with a null label or vector or any null or non-finite component take no part; every row is a row of its own, so a
repeated row can be the positive of its twin; a null vec_id is no anchor and comes last among equal scores; vectors of different lengths
are compared over the shorter one; an empty vector scores 0 with all; positives of negative score open no window; components are held
within 2**62 and scores within a long; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import stage, table

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90

BLOCK_BITS = 10
BLOCK_BYTES = 1 << 20
ANCHORS, ANCHOR_BYTES = 1 << 14, 32 << 20
CELL_BYTES = 32 << 20
PRODUCT_CELLS = 1 << 21

NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
ROWS = "n int, dim int, vec binary, label binary, anchor binary, x binary"


def _tight(x: np.ndarray) -> bytes:
    """The matrix in the smallest integers that hold it; :func:`_loose` tells them by their size."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def _loose(blob: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(blob) // (n * dim)] if n * dim else np.int64
    return np.frombuffer(blob, kind).reshape(n, dim).astype(np.int64)


def _blocks(scale: int):
    """Rows to blocks of rows of one length."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            size = np.asarray(lists.value_lengths(), np.int64)
            start = np.cumsum(size) - size
            flat = np.asarray(lists.flatten(), np.float64)
            vec = batch["vec_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            label, anchor = (batch[c].to_numpy(zero_copy_only=False) for c in ("label", "anchor"))
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                step = min(1 << BLOCK_BITS, max(1, BLOCK_BYTES // (8 * dim + 8)))
                for k in range(0, len(at), step):
                    own = at[k:k + step]
                    x = np.floor(scale * flat[start[own][:, None] + np.arange(dim)])
                    x = np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
                    cells = [[len(own)], [dim], [vec[own].tobytes()], [label[own].tobytes()], [anchor[own].tobytes()], [_tight(x)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int32(), pa.int32()] + [pa.binary()] * 4, strict=True)],
                                                     names=["n", "dim", "vec", "label", "anchor", "x"])
    return blocks


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of blocks as rows: row number, vec_id, label and vector."""
    for batch in batches:
        for b in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(b["anchor"], bool))
            x = _loose(b["x"], b["n"], b["dim"])[at]
            row = (b["block"] << BLOCK_BITS) + at
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(np.frombuffer(b["vec"], np.int64)[at]), pa.array(np.frombuffer(b["label"], np.int64)[at]), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["row", "vec_id", "label", "x"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, over the shorter length, held within a long."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(dim, 1)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, NO_ID).astype(np.int64)


class Slots:
    """The best ``k`` rows per anchor and slot of what was fed so far: higher scores first, then smaller vec_id.

    ``limits`` (anchors x slots) are the slots' upper limits in falling order; scores below ``least`` matter to no window."""

    def __init__(self, rows, labels, x, limits, least, k: int, same_label: bool):
        self.rows, self.labels, self.x, self.limits, self.k, self.same = rows, labels, x, limits, k, same_label
        self.bar = np.repeat(least[:, None], limits.shape[1], axis=1)  # what a row must reach to enter a slot
        self.a = self.slot = np.empty(0, np.int64)
        self.score = self.vec = np.empty(0, np.int64)

    def feed(self, rows, vec, labels, x) -> None:
        step = max(1, PRODUCT_CELLS // max(1, len(self.rows)))
        for k in range(0, len(rows), step):
            self._feed(*(v[k:k + step] for v in (rows, vec, labels, x)))

    def _feed(self, rows, vec, labels, x) -> None:
        s = products(self.x, x)
        ok = (s <= self.limits[:, :1]) & (s >= self.bar.min(axis=1)[:, None])
        ok &= (self.labels[:, None] == labels) == self.same
        if self.same:
            ok &= self.rows[:, None] != rows
        a, r = np.nonzero(ok)
        score = s[a, r]
        slot = (score[:, None] <= self.limits[a]).sum(axis=1) - 1
        enters = score >= self.bar[a, slot]
        self._merge(a[enters], slot[enters], score[enters], vec[r[enters]])

    def _merge(self, a, slot, score, vec) -> None:
        if not len(a):
            return
        a, slot, score, vec = (np.concatenate(p) for p in ((self.a, a), (self.slot, slot), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, ~score, slot, a))
        a, slot, score, vec = a[order], slot[order], score[order], vec[order]
        key = a * self.limits.shape[1] + slot
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        last = place == self.k - 1
        self.bar[a[last], slot[last]] = score[last]
        kept = place < self.k
        self.a, self.slot, self.score, self.vec = a[kept], slot[kept], score[kept], vec[kept]


def _best(k: int, same_label: bool):
    """A cell (anchors and blocks of rows) to its best rows per anchor and slot."""
    def best(cell: pa.Table) -> pa.Table:
        parts = cell.to_pylist()
        own = [p for p in parts if p["limits"] is not None]
        out = []
        if own and len(own) < len(parts):
            dim, m = max(p["dim"] for p in own), max(len(p["limits"]) for p in own)
            x, limits = np.zeros((len(own), dim), np.int64), np.full((len(own), m), LEAST)
            for j, p in enumerate(own):
                x[j, :p["dim"]] = np.frombuffer(p["x"], np.int64)
                limits[j, :len(p["limits"])] = p["limits"]
            rows, labels, least = (np.array([p[c] for p in own], np.int64) for c in ("row", "anchor_label", "least"))
            slots = Slots(rows, labels, x, limits, least, k, same_label)
            for p in parts:
                if p["limits"] is None:
                    n = p["n"]
                    slots.feed((p["row"] << BLOCK_BITS) + np.arange(n), np.frombuffer(p["vec"], np.int64), np.frombuffer(p["label"], np.int64), _loose(p["x"], n, p["dim"]))
            out = [rows[slots.a], slots.slot.astype(np.int32), slots.score, slots.vec]
        names, kinds = ["row", "slot", "score", "vec_id"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, out or [[]] * 4, kinds, strict=True)})
    return best


def _best_rows(blocks: DataFrame, anchors: DataFrame, grid: tuple[int, int], k: int, same_label: bool) -> DataFrame:
    """The best ``k`` rows per anchor and slot over all rows: row, slot, place (from 1), score and vec_id.

    ``anchors`` has row, anchor_label, dim, x, limits and least."""
    across, along = grid
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sent = anchors.select(F.pmod(F.xxhash64("row"), F.lit(across)).alias("i"), spread(along).alias("j"), "row", "anchor_label", "dim", "x", "limits", "least")
    rows = blocks.select(spread(across).alias("i"), F.pmod(F.xxhash64("block"), F.lit(along)).alias("j"), F.col("block").alias("row"), "n", "dim", "vec", "label", "x")
    cells = rows.unionByName(sent, allowMissingColumns=True).repartition(min(across * along, 50_000), "i", "j")
    found = cells.groupBy("i", "j").applyInArrow(_best(k, same_label), "row long, slot int, score long, vec_id long")
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def share_up(score: str, percent: int) -> Column:
    """The least integer of at least ``percent`` hundredths of a score that isn't negative, without overflow."""
    return F.expr(f"{percent} * ({score} div 100) + ({percent} * ({score} % 100) + 99) div 100")


def share_down(score: str, percent: int) -> Column:
    """The greatest integer of at most ``percent`` hundredths of it."""
    return F.expr(f"{percent} * ({score} div 100) + ({percent} * ({score} % 100)) div 100")


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows marked by ``anchor``.

    ``vectors`` has vec_id and embedding; ``label`` is an integer column over it. Components x become floor(scale * x); a window goes from ``low`` to
    ``high`` hundredths of the positive's score."""
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.cast("long").alias("label"),
                            F.coalesce(anchor, F.lit(False)).alias("anchor")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    blocks = usable.select("vec_id", "label", "anchor", "embedding").mapInArrow(_blocks(scale), ROWS)
    blocks = stage(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    chosen = stage(blocks.select("block", "n", "dim", "vec", "label", "anchor", "x").mapInArrow(_anchors, "row long, vec_id long, label long, x binary"), "anchors")
    size = blocks.agg(F.sum(F.length("x") + F.length("vec")).alias("bytes"), F.max("dim").alias("dim")).first()
    n_anchors = chosen.count()
    per_block = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * (size.dim or 1) + 8)))
    across = max(1, -(-n_anchors // per_block))
    along = max(1, -(-(size.bytes or 0) // CELL_BYTES), -(-2 * spark.sparkContext.defaultParallelism // across))

    facts = chosen.select("row", F.col("label").alias("anchor_label"), F.floor(F.length("x") / 8).cast("int").alias("dim"), "x")
    first = facts.select("*", F.array(F.lit(int(NO_ID))).alias("limits"), F.lit(int(LEAST)).alias("least"))
    best = _best_rows(blocks, first, (across, along), positives, True).where("score >= 0")
    best = stage(best.select("row", "place", "score", "vec_id", share_up("score", low).alias("lower"), share_down("score", high).alias("upper")), "positives")

    limits = best.groupBy("row").agg(F.sort_array(F.collect_list("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))  # at most ``positives`` entries
    second = facts.join(limits, "row")
    held = _best_rows(blocks, second, (across, along), negatives, False)
    lists = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "score", "vec_id"))).alias("found"))  # at most positives * negatives

    windows = best.select("row", "place", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"), "lower").join(lists, "row")
    suffix = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("place") - 1), 1, negatives)
    inside = F.filter(suffix, lambda x: x["score"] >= F.col("lower"))
    out = windows.select("row", "positive_id", "positive_score", F.posexplode(inside).alias("k", "n"))
    ids = chosen.select("row", F.col("vec_id").alias("anchor_id"))
    known = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    return out.join(ids, "row").withColumn("negative_id", F.col("n.vec_id")).select(
        "anchor_id", known("positive_id").alias("positive_id"), (F.col("k") + 1).cast("int").alias("rank"), known("negative_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Over ``embeddings``: anchors are the ids divisible by 100, and ids divisible by 7 have the next label."""
    wrong = F.col("vec_id") % 7 == 0
    label = F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), F.col("vec_id") % EVERY == 0, label)


#: The rows of :func:`query` in DuckDB's SQL.
SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= {POSITIVES}),
n AS (SELECT p.r, p.anchor_id, p.k, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON p.r = s.r AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
