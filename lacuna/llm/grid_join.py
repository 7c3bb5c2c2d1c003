"""Near-duplicate vectors by cosine: the epsilon grid order join.

Unit vectors with a cosine of at least ``COSINE`` are no further apart than ``epsilon`` = sqrt(2 - 2 COSINE). Vectors are rotated to the
principal axes of all vectors and sorted by the cells, ``epsilon`` wide, of the leading ``LEADING`` axes (and by the first axis within a
cell). The sequence is cut into intervals. Two intervals are joined unless the boxes that hold them are more than ``epsilon``
apart; inside a task a pair of intervals is halved again and again, pairs of halves whose boxes (over all axes) are
too far apart are skipped, and what is left is compared as matrix products in double precision.

Equal vectors are one class from the start, so a group of copies costs one row. A pair of intervals returns counts of links
and the stars of components, never pairs. Interval pairs come from an equi-join on cells of the first axis, not from a cross join; a row per
interval takes part. The axes (dimension squared numbers) are the only thing broadcast.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of different
length don't link; a cosine of exactly the threshold links; rows with equal vectors link with each other; a null id stays null and is never
the smallest of others; an empty table gives no rows; other columns (labels) are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import components, local_roots, stage, table

COSINE = 0.9
LEADING = 6
INTERVAL = 4096
LEAF = 256
BUILDERS = 64
SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray | None:
    """A vector at length one in double precision, or None where it has no direction."""
    v = np.asarray(v, np.float64)
    most = np.abs(v).max() if v.size and np.isfinite(v).all() else 0.0
    if not most:
        return None
    v = v / most
    return v / math.sqrt(v @ v)


def _read(it):
    for pdf in it:
        rows = []
        for v in pdf["embedding"]:
            v = None if v is None else np.array([np.nan if x is None else x for x in v], np.float64) if getattr(v, "dtype", None) != np.float32 else v.astype(np.float64)
            if v is None or unit(v) is None:
                rows.append((0, 0, 0, None))
                continue
            raw = (v + 0.0).tobytes()  # -0.0 and 0.0 are one number
            d = hashlib.blake2b(raw, digest_size=16).digest()
            rows.append((len(v), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), raw))
        yield pd.concat([pdf[["vec_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["dim", "k1", "k2", "raw"])], axis=1)


def _units(raws, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the principal axes, as columns by falling variance, from all of them."""
    def moments(it):
        sums: dict[int, list] = {}
        for pdf in it:
            for dim, some in pdf.groupby("dim"):
                x = _units(some["raw"], dim)
                s = sums.setdefault(dim, [0, np.zeros(dim), np.zeros((dim, dim))])
                s[0], s[1], s[2] = s[0] + len(x), s[1] + x.sum(axis=0), s[2] + x.T @ x
        yield pd.DataFrame([(d, n, a.tobytes(), b.tobytes()) for d, (n, a, b) in sums.items()], columns=["dim", "n", "a", "b"])

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        a = sum(np.frombuffer(x, np.float64) for x in pdf["a"]) / pdf["n"].sum()
        b = sum(np.frombuffer(x, np.float64).reshape(dim, dim) for x in pdf["b"]) / pdf["n"].sum()
        return pd.DataFrame({"dim": [dim], "axes": [np.ascontiguousarray(np.linalg.eigh(b - np.outer(a, a))[1][:, ::-1]).tobytes()]})
    parts = classes.select("dim", "raw").coalesce(BUILDERS).mapInPandas(moments, "dim int, n long, a binary, b binary")
    return {r["dim"]: np.frombuffer(r["axes"], np.float64).reshape(r["dim"], -1) for r in parts.groupBy("dim").applyInPandas(axes, "dim int, axes binary").collect()}


def _placed(shared, epsilon: float):
    def placed(it):
        for pdf in it:
            y = np.zeros((len(pdf), LEADING))
            for dim, at in pdf.groupby("dim").indices.items():
                axes = shared.value[dim][:, :LEADING]
                y[at, :axes.shape[1]] = _units(pdf["raw"].iloc[at], dim) @ axes
            out = pdf.copy()
            for k in range(LEADING):
                out[f"y{k}"], out[f"c{k}"] = y[:, k], np.floor(y[:, k] / epsilon).astype(np.int32)
            yield out
    return placed


def _sequence(placed: DataFrame, interval: int) -> DataFrame:
    """Rows in grid order with the number of their interval."""
    order = ["dim", *[f"c{k}" for k in range(LEADING)], "y0", "cid"]

    def number(it):
        from pyspark import TaskContext

        pid, n = TaskContext.get().partitionId(), 0
        for batch in it:
            t = pa.Table.from_batches([batch]).append_column("pid", pa.array(np.full(batch.num_rows, pid, np.int32))).append_column("at", pa.array(n + np.arange(batch.num_rows)))
            n += batch.num_rows
            yield from t.to_batches()
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    rows = stage(placed.orderBy(*order).mapInArrow(number, f"{names}, pid int, at long"), "sequence")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    firsts = stage(rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    return stage(rows.join(firsts, "pid").withColumn("interval", F.floor((F.col("first") + F.col("at")) / interval).cast("long")).drop("pid", "at", "first"), "intervals")


def _pairs(rows: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b), a <= b, of intervals whose boxes on the leading axes come within ``epsilon``."""
    box = rows.groupBy("interval", "dim").agg(*[f(f"y{k}").alias(f"{n}{k}") for k in range(LEADING) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    box = stage(box, "boxes")
    low, high = F.floor(F.col("lo0") / epsilon), F.floor(F.col("hi0") / epsilon)
    a = box.select(*[F.col(c).alias(f"a_{c}") for c in box.columns], F.explode(F.sequence(low, high)).alias("cell"))
    b = box.select(*[F.col(c).alias(f"b_{c}") for c in box.columns], F.explode(F.sequence(low - 1, high + 1)).alias("cell"))
    gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(LEADING)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= epsilon ** 2 + SLACK
    both = a.join(b, (F.col("a_dim") == F.col("b_dim")) & (a["cell"] == b["cell"])).where(near)
    return both.select(F.least("a_interval", "b_interval").alias("a"), F.greatest("a_interval", "b_interval").alias("b")).distinct()


class Joiner:
    """Joins the two intervals of a task recursively; collects counts of links and stars of components."""

    def __init__(self, x: np.ndarray, y: np.ndarray, raw: np.ndarray, cid: np.ndarray, copies: np.ndarray, cosine: float):
        self.x, self.y, self.raw, self.cid, self.copies, self.cosine = x, y, raw, cid, copies, cosine
        self.most = 2 - 2 * cosine + SLACK
        self.links = np.zeros(len(x), np.int64)
        self.star_a, self.star_b, self.compared = [], [], 0

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        gap = np.maximum(0, np.maximum(self._low(a) - self._high(b), self._low(b) - self._high(a))) if a != b else 0
        if np.sum(np.square(gap)) > self.most:
            return
        n, m = a[1] - a[0], b[1] - b[0]
        if max(n, m) <= LEAF:
            self._compare(a, b)
        elif a == b:
            mid = (a[0] + a[1]) // 2
            left, right = (a[0], mid), (mid, a[1])
            self.join(left, left)
            self.join(left, right)
            self.join(right, right)
        else:
            for x in self._halves(a) if n >= m else (a,):
                for y in self._halves(b) if m > n else (b,):
                    self.join(x, y)

    @staticmethod
    def _halves(s: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        mid = (s[0] + s[1]) // 2
        return (s[0], mid), (mid, s[1])

    def _low(self, s):
        return self.y[s[0]:s[1]].min(axis=0)

    def _high(self, s):
        return self.y[s[0]:s[1]].max(axis=0)

    def _compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        self.compared += (a[1] - a[0]) * (b[1] - b[0])
        c = self.x[a[0]:a[1]] @ self.x[b[0]:b[1]].T
        near = c >= self.cosine
        for i, j in np.argwhere(np.abs(c - self.cosine) < 1e-12):  # products in another order could differ here
            u, v = self.raw[a[0] + i], self.raw[b[0] + j]
            near[i, j] = u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= self.cosine
        if a == b:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links[a[0]:a[1]] += near @ self.copies[b[0]:b[1]]
        if a != b:
            self.links[b[0]:b[1]] += near.T @ self.copies[a[0]:a[1]]
        i, j = np.nonzero(near)
        nodes, roots = local_roots(self.cid[a[0] + i], self.cid[b[0] + j])
        self.star_a.append(nodes)
        self.star_b.append(roots)


def _joined(shared, cosine: float):
    def joined(data: pa.Table) -> pa.Table:
        first = data["a"][0].as_py() if data.num_rows else 0
        order = np.lexsort((data["place"].to_numpy(), data["interval"].to_numpy() != first))
        data = data.take(pa.array(order)).combine_chunks()
        dim = data["dim"].to_numpy()
        cid, copies, links = data["cid"].to_numpy(), data["copies"].to_numpy(), np.zeros(data.num_rows, np.int64)
        stars = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        second = data["interval"].to_numpy() != first
        alone = data["a"][0].as_py() == data["b"][0].as_py()
        for d in np.unique(dim):  # an interval at the seam of two lengths holds both
            at = np.flatnonzero(dim == d)
            raw = np.frombuffer(b"".join(data["raw"].take(pa.array(at)).to_pylist()), np.float64).reshape(-1, d)
            x = _units([raw.tobytes()], d)
            j = Joiner(x, x @ shared.value[int(d)], raw, cid[at], copies[at], cosine)
            cut = int((~second[at]).sum())
            if alone:
                j.join((0, len(at)), (0, len(at)))
            elif 0 < cut < len(at):
                j.join((0, cut), (cut, len(at)))
            links[at] = j.links
            stars[0].extend(j.star_a)
            stars[1].extend(j.star_b)
        nodes, roots = local_roots(np.concatenate(stars[0]), np.concatenate(stars[1]))
        root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        rows = np.flatnonzero(links > 0)
        return pa.table({"cid": pa.array(cid[rows], pa.int64()), "links": pa.array(links[rows], pa.int64()), "root": pa.array([root[c] for c in cid[rows].tolist()], pa.int64())})
    return joined


def near_vectors(vectors: DataFrame, cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """A row per vector of (vec_id, embedding): vec_id, n_links, component_id and kept."""
    epsilon = math.sqrt(2 - 2 * cosine)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    read = stage(vectors.mapInPandas(_read, "vec_id long, dim int, k1 long, k2 long, raw binary"), "vectors")
    classes = read.where("dim > 0").groupBy("k1", "k2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    classes = stage(stage(classes, "classes").withColumn("cid", F.monotonically_increasing_id()), "classes")
    shared = vectors.sparkSession.sparkContext.broadcast(principal_axes(classes))
    names = "cid long, dim int, copies long, raw binary, " + ", ".join(f"y{k} double, c{k} int" for k in range(LEADING))
    placed = classes.select("cid", "dim", "copies", "raw").mapInPandas(_placed(shared, epsilon), names)
    rows = _sequence(stage(placed, "placed"), interval)
    pairs = _pairs(rows, epsilon)
    roles = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("interval"))
    place = F.struct(*[f"c{k}" for k in range(LEADING)], "y0", "cid")
    sent = rows.select("interval", "dim", "cid", "copies", "raw", F.row_number().over(Window.partitionBy("interval").orderBy(place)).alias("place"))
    tasks = sent.join(stage(roles, "pairs"), "interval")
    linked = stage(tasks.groupBy("a", "b").applyInArrow(_joined(shared, cosine), "cid long, links long, root long"), "linked")
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    labelled = classes.select("cid", "k1", "k2", "class_id", "copies").join(links, "cid", "left").join(groups, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    labelled = stage(labelled, "labelled")
    labelled = labelled.join(labelled.groupBy("root").agg(F.min("class_id").alias("component_id")), "root")
    labelled = stage(labelled.select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "labelled")
    out = read.select("vec_id", "dim", "k1", "k2").hint("merge").join(labelled, ["k1", "k2"], "left")
    found = F.col("component_id").isNotNull() & (F.col("dim") > 0)
    component = F.when(found, F.col("component_id")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("dim") > 0, F.col("copies") - 1 + F.col("links")).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


#: The rows of :func:`query` in DuckDB's SQL: every pair is compared there.
SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
cc(id, label) USING KEY (id) AS (SELECT vec_id, vec_id FROM embeddings
    UNION (SELECT l.b, min(c.label) FROM cc c JOIN links l ON c.id = l.a JOIN recurring.cc r ON r.id = l.b WHERE c.label < r.label GROUP BY l.b))
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, label AS component_id, id = label AS kept
FROM cc LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON d.a = cc.id
"""
