"""Near-duplicate join on word shingles: the chosen-path join.

A text's set is its distinct runs of ``SHINGLE`` words. Equal sets are one class, joined only once. Classes get a sketch of
``COORDINATES`` min-hash tokens. A run starts with all classes in one node. A node picks random coordinates, each with
probability ``BRANCHES`` / ``COORDINATES``, and its classes go on to one child per picked coordinate and token, so only classes that share
sampled tokens stay together. Small nodes are compared by brute force; a node that is still large splits again, until it no longer
shrinks or ``DEPTH`` is reached. Two sets of similarity s stay together in a child with probability s per coordinate, which gives the recall of
a run; runs are repeated until it reaches ``RECALL``.

Comparison has two passes. Sketches rule out pairs far below the threshold (``SLACK`` standard deviations); the sets of what is left
are built again from the texts and compared exactly. A pair that meets in several leaves counts in the first one only, which both
classes know, so no pair is ever written: a task returns counts of links and the stars of the components it sees. Leaves
that stay large (a group of copies, a passage in a third of all texts) are cut into blocks, and pairs of blocks are tasks of their own.

Defined cases: a text of fewer than five words has one shingle, all its words; a text without words (null, empty, blank) links with nothing
and is its own class; rows that repeat count as copies; null ids are documents too, and a class takes the smallest id that isn't null;
ties in similarity (exactly the threshold) link; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import WordCodes, batches, components, local_roots, mix, stage, table

SHINGLE = 5
THRESHOLD = (4, 5)
COORDINATES = 64
BRANCHES = 2.0
DEPTH = 3
LEAF = 1024
BLOCK = 1024
RECALL = 0.9999
SLACK = 4.2
_RNG = np.random.Generator(np.random.Philox(17))
XOR = _RNG.integers(0, 1 << 32, COORDINATES, np.uint32)[:, None]
ODD = (_RNG.integers(0, 1 << 32, COORDINATES, np.uint32) | np.uint32(1))[:, None]


def runs_needed(recall: float = RECALL, similarity: float = 0.8, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs after which two sets of the given similarity have met with probability ``recall``, even in the deepest leaf."""
    met = 1.0
    for _ in range(depth):
        met = 1 - math.exp(-branches * similarity * met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingles(text: str | None, codes: WordCodes) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text."""
    own = list(map(codes.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))
    if not own:
        return np.empty(0, np.uint64)
    c, k = np.array(own, np.int64).view(np.uint64), min(SHINGLE, len(own))
    h = np.full(len(own) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j:len(own) - k + 1 + j]
    return np.unique(mix(h))


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Per coordinate 16 bits of the element with the smallest hash."""
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        low = np.minimum(low, ((x[i:i + 4096] ^ XOR) * ODD).min(axis=1))
    return low.astype(np.uint16).tobytes()


def brief(tokens: bytes) -> bytes:
    """A byte per coordinate of a sketch, enough to compare: two different elements agree once in 256."""
    return np.frombuffer(tokens, np.uint16).astype(np.uint8).tobytes()


def _keyed(with_sketch: bool):
    def keyed(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for texts in series:
            rows = []
            for some in batches(texts):
                for text in some:
                    s = shingles(text, codes)
                    tokens = sketch(s) if with_sketch else None
                    rows.append((len(s), *set_key(s), tokens, tokens and brief(tokens)))
            yield pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "sketch", "brief"])
    return F.pandas_udf(keyed, "n_shingles long, k1 long, k2 long, sketch binary, brief binary")


def _picked(paths: np.ndarray) -> np.ndarray:
    """Which coordinates each node picks: rows of booleans."""
    h = mix(paths.view(np.uint64)[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h < np.uint64(int(BRANCHES / COORDINATES * 2 ** 64))


def _children(paths: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(paths.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (coordinate.astype(np.uint64) << np.uint64(17)) + token.astype(np.uint64) + np.uint64(1)).view(np.int64)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, COORDINATES)


def _roots(runs: int):
    """All classes to the children of the roots of all runs."""
    start = mix(np.arange(1, runs + 1, dtype=np.uint64)).view(np.int64)
    picked = [(r, i) for r, i in zip(*np.nonzero(_picked(start)), strict=True)]

    def split(it):
        for pdf in it:
            tokens, ids = _sketches(pdf["sketch"]), pdf["cid"].to_numpy()
            for r, i in picked:
                yield pd.DataFrame({"path": _children(np.full(len(ids), start[r]), np.full(len(ids), i), tokens[:, i]), "cid": ids})
    return split


def _split(it):
    """Rows of large nodes (path, cid, sketch, parent size) to those of their children."""
    for pdf in it:
        tokens, paths = _sketches(pdf["sketch"]), pdf["path"].to_numpy()
        for at in range(0, len(pdf), 20_000):
            row, i = np.nonzero(_picked(paths[at:at + 20_000]))
            row = row + at
            yield pd.DataFrame({"path": _children(paths[row], i, tokens[row, i]), "cid": pdf["cid"].to_numpy()[row], "parent": pdf["size"].to_numpy()[row]})


def _leaves(classes: DataFrame, runs: int, leaf: int, depth: int) -> DataFrame:
    """(path, cid, size) of all leaves that hold at least two classes."""
    rows = classes.select("cid", "sketch").mapInPandas(_roots(runs), "path long, cid long").withColumn("parent", F.lit(None).cast("long"))
    found = []
    for level in range(1, depth + 1):
        rows = stage(rows, f"level{level}")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = stage(rows.join(sizes, "path"), f"sized{level}")
        stop = F.lit(True) if level == depth else (F.col("size") <= leaf) | (F.coalesce(F.col("parent"), F.lit(1 << 62)) < 2 * F.col("size"))
        found.append(sized.where(stop).select("path", "cid", "size"))
        if level < depth:
            rows = sized.where(~stop).join(classes.select("cid", "sketch"), "cid").select("path", "cid", "sketch", "size").mapInPandas(_split, "path long, cid long, parent long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return stage(out, "leaves")


def _tasks(rows: DataFrame, block: int) -> DataFrame:
    """Rows of leaves to comparison tasks (path, i, j): a leaf of several blocks has a task for each two of them."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("cid", "path"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return (rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other"))


def _in_tasks(rows: DataFrame) -> DataFrame:
    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")


def _groups(it) -> Iterator[pa.Table]:
    """Complete tasks from batches that are sorted by (path, i, j)."""
    held: list[pa.RecordBatch] = []

    def key(batch, k):
        return tuple(batch.column(c)[k].as_py() for c in ("path", "i", "j"))

    def cut(t: pa.Table) -> Iterator[pa.Table]:
        keys = np.stack([t[c].to_numpy() for c in ("path", "i", "j")])
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(a, b - a)

    for batch in it:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) == key(batch, batch.num_rows - 1):
            held.append(batch)
            continue
        last, n = key(batch, batch.num_rows - 1), batch.num_rows
        path = batch.column("path").to_numpy()
        same = np.flatnonzero((path != last[0]) | (batch.column("i").to_numpy() != last[1]) | (batch.column("j").to_numpy() != last[2]))
        upto = same[-1] + 1 if len(same) else 0
        whole = pa.Table.from_batches([*held, batch.slice(0, upto)])
        if whole.num_rows:
            yield from cut(whole.combine_chunks())
        held = [batch.slice(upto, n - upto)]
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks())


def _met_before(path: int, lists: list[np.ndarray]) -> np.ndarray:
    """Which two members share a leaf with a smaller number than this one."""
    n = len(lists)
    owner = np.repeat(np.arange(n), [len(x) for x in lists])
    leaf = np.concatenate(lists)
    owner, leaf = owner[leaf < path], leaf[leaf < path]
    names, at, count = np.unique(leaf, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    owner, at = owner[shared], at[shared]
    if not len(at):
        return np.zeros((n, n), bool)
    _, at = np.unique(at, return_inverse=True)
    has = np.zeros((n, at.max() + 1), np.float32)
    has[owner, at] = 1
    return has @ has.T > 0


def _open_pairs(group: pa.Table) -> np.ndarray:
    """Pairs of a task that are its own to decide: the right sides, and not met in an earlier leaf."""
    side, i, j = group["side"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
    lists = group["leaves"].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    open_ = ~_met_before(group["path"][0].as_py(), [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    open_ &= ~np.eye(len(side), dtype=bool) if i == j else side[:, None] != side
    return open_


def _likely(least: int):
    def likely(it):
        for group in _groups(it):
            tokens = np.frombuffer(b"".join(group["brief"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
            n = len(tokens)
            near = np.zeros((n, n), bool)
            for k in range(n - 1):
                near[k, k + 1:] = (tokens[k + 1:] == tokens[k]).sum(axis=1) >= least
            near |= near.T
            if near.any():
                keep = np.flatnonzero((near & _open_pairs(group)).any(axis=1))
                if len(keep):
                    yield from group.select(["path", "i", "j", "side", "cid", "copies", "leaves"]).take(pa.array(keep)).combine_chunks().to_batches()
    return likely


def links_of(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Which sets have a Jaccard similarity of at least the threshold (a fraction), exactly."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]])
        both = np.vstack([both, both[:, ::-1]])
    else:
        owner = np.repeat(np.arange(n), size)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[at] > 1
        owner, at = owner[shared], at[shared]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        both, column = np.zeros((n, n), np.float32), np.concatenate([[0], np.cumsum(np.diff(at) > 0)]) if len(at) else at
        for a in range(0, int(column[-1]) + 1 if len(at) else 0, 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            has = np.zeros((n, 4096), np.float32)
            has[owner[lo:hi], column[lo:hi] - a] = 1
            both += has @ has.T
        both = both.astype(np.int64)
    p, q = threshold
    return both * (p + q) >= p * (size[:, None] + size)


def _linked(it):
    for group in _groups(it):
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        near = links_of(sets) & _open_pairs(group)
        if not near.any():
            continue
        cid, copies = group["cid"].to_numpy(), group["copies"].to_numpy()
        a, b = np.nonzero(near)
        nodes, roots = local_roots(cid[a], cid[b])
        root = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        rows = np.flatnonzero(near.any(axis=1))
        yield pa.RecordBatch.from_pydict({"cid": pa.array(cid[rows]), "links": pa.array((near[rows] * copies).sum(axis=1)), "root": pa.array([root[c] for c in cid[rows].tolist()], pa.int64())})


def _sets(it):
    codes = WordCodes()
    for pdf in it:
        sets = [shingles(t, codes) for t in pdf["text"]]
        keys = [set_key(s) for s in sets]
        right = np.array([k == (a, b) for k, a, b in zip(keys, pdf["k1"], pdf["k2"], strict=True)], bool)
        yield pd.DataFrame({"cid": pdf["cid"][right], "shingles": [s.tobytes() for s, ok in zip(sets, right, strict=True) if ok]})


_NO_ID = -(1 << 63)


def near_groups(docs: DataFrame, runs: int | None = None, leaf: int = LEAF, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """A row per document: doc_id, k1, k2 (its set's key), class_id, n_copies, n_links, component_id and root (the group's own number)."""
    docs = docs.select("doc_id", "text")
    keyed = stage(docs.select("doc_id", _keyed(True)("text").alias("s")).select("doc_id", "s.*"), "keyed")
    found = keyed.where("n_shingles > 0")
    classes = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"))
    classes = stage(stage(classes, "classes").withColumn("cid", F.monotonically_increasing_id()), "classes")
    leaves = _leaves(classes, runs or runs_needed(similarity=THRESHOLD[0] / THRESHOLD[1], depth=depth), leaf, depth)
    lists = leaves.groupBy("cid").agg(F.collect_list(F.struct("path", "size")).alias("at"))
    members = lists.join(classes.select("cid", "brief", "copies"), "cid")
    members = members.select("cid", "brief", "copies", F.col("at.path").alias("all"), F.explode("at").alias("own"))
    earlier = F.filter("all", lambda p: p < F.col("own.path"))  # all that a leaf needs to know of the others
    members = members.select("cid", "brief", "copies", earlier.alias("leaves"), "own.*")
    s = THRESHOLD[0] / THRESHOLD[1]
    least = math.floor(COORDINATES * s - SLACK * math.sqrt(COORDINATES * s * (1 - s)))
    kept = "path long, i int, j int, side int, cid long, copies long, leaves array<long>"
    likely = stage(_in_tasks(_tasks(members, block)).mapInArrow(_likely(least), kept), "likely")
    wanted = likely.select("cid").distinct().join(classes.select("cid", "k1", "k2", "class_id"), "cid")
    no_id = F.lit(_NO_ID)
    texts = docs.hint("merge").join(wanted.select(F.coalesce("class_id", no_id).alias("at_id"), "cid", "k1", "k2"), F.coalesce(F.col("doc_id"), no_id) == F.col("at_id"))
    sets = stage(texts.select("cid", "k1", "k2", "text").mapInPandas(_sets, "cid long, shingles binary"), "sets").dropDuplicates(["cid"])
    linked = stage(_in_tasks(likely.hint("merge").join(sets, "cid")).mapInArrow(_linked, "cid long, links long, root long"), "linked")
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("cid", "k1", "k2", "class_id", "copies").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = stage(labelled.withColumn("root", F.coalesce("root", "cid")), "labelled")
    least_id = labelled.groupBy("root").agg(F.min("class_id").alias("component_id"))
    labelled = stage(labelled.join(least_id, "root").select("k1", "k2", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "labelled")
    joined = keyed.select("doc_id", "n_shingles", "k1", "k2").hint("merge").join(labelled, ["k1", "k2"], "left")
    alone = F.col("n_shingles") == 0
    return joined.select("doc_id", "k1", "k2", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"), F.when(alone, 0).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
                         F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), alone.alias("alone"), "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id (null last), one row of it.

    Ids may be missing or repeated: groups are told apart by a number of their own, and ties of the id are broken by the key of the text."""
    linked = ~F.col("alone") & F.col("n_links").cast("boolean")
    verdict = stage(near_groups(docs).where(linked).select("root", "doc_id", "k1", "k2").dropDuplicates(), "groups")
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    winners = verdict.groupBy("root").agg(F.min(ranked).alias("first")).select("first.*").drop("none").withColumn("__stays", F.lit(True))
    same = F.col("v.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("v.k1") == F.col("w.k1")) & (F.col("v.k2") == F.col("w.k2"))
    kept = verdict.alias("v").join(winners.alias("w"), same, "left").select(
        F.col("v.doc_id").alias("__id"), F.col("v.k1").alias("__k1"), F.col("v.k2").alias("__k2"), F.coalesce("__stays", F.lit(False)).alias("__stays"))
    keyed = docs.withColumn("__s", _keyed(False)("text"))
    joined = keyed.hint("merge").join(stage(kept, "verdict"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__s.k1") == F.col("__k1")) & (F.col("__s.k2") == F.col("__k2")), "left")
    single = joined.where("__stays IS NULL").select(*[docs[c] for c in docs.columns])
    grouped = joined.where("__stays").dropDuplicates(["__id", "__k1", "__k2"]).select(*[docs[c] for c in docs.columns])
    return single.unionByName(grouped)


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = near_groups(table(spark, folder, "documents"))
    return out.select("doc_id", "class_id", "n_links", "component_id", (F.col("alone") | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


#: The rows of :func:`query` in DuckDB's SQL: every pair that shares a shingle is compared there.
SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
    list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS s FROM cut),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS shingle FROM sets),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, n = len(x.s) AND n = len(y.s) AS same FROM both_ JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 9 * n >= 4 * (len(x.s) + len(y.s))),
cc(id, label) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents
    UNION (SELECT l.b, min(c.label) FROM cc c JOIN links l ON c.id = l.a JOIN recurring.cc r ON r.id = l.b WHERE c.label < r.label GROUP BY l.b))
SELECT id AS doc_id, least(id, coalesce(first_same, id)) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, label AS component_id, id = label AS kept
FROM cc LEFT JOIN (SELECT a, count(*) AS n, min(b) FILTER (same) AS first_same FROM links GROUP BY a) d ON d.a = cc.id
"""
