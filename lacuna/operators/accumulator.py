"""Append-only accumulator of a log: a Merkle mountain range over leaves 0, 1, ..., n - 1.

Node (level, at) covers the 2^level leaves from at * 2^level on and exists once all of them do, so a node never changes. The
nodes that no larger node covers are the peaks, one per set bit of n; the root binds them and n. Whatever its length, a log grows by
adding nodes, and two proofs are short: that a leaf is under a root (:func:`inclusion`), and that the log of an earlier root is a
beginning of the log of a later one (:func:`consistency`).

Nodes are rows (level, at, digest). Eight levels are made per shuffle, in groups of 256 nodes, so 10^10 leaves take five; proofs join on
(level, at). Defined cases: an empty log has no nodes and the root of nothing; positions with gaps, repeats or nulls are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.session import checkpoint_dir

RADIX = 8
NODES = "level int, at long, digest string"


def leaf_digest(payload: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), payload), 256)


def node_digest(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), left, right), 256)


def peaks_of(n: int) -> list[tuple[int, int]]:
    """(level, at) of the peaks of ``n`` leaves, left to right."""
    out, start = [], 0
    for level in reversed(range(n.bit_length())):
        if n >> level & 1:
            out.append((level, start >> level))
            start += 1 << level
    return out


def _halved(digests: Column) -> Column:
    """The next level above a run of siblings that starts at an even place."""
    pair = lambda i: node_digest(F.element_at(digests, 2 * i - 1), F.element_at(digests, 2 * i))
    half = F.floor(F.size(digests) / 2).cast("int")
    return F.when(half < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), half), pair))


def _above(level: DataFrame, base: int) -> DataFrame:
    """All complete nodes of the ``RADIX`` levels above ``level`` (at, digest), whose groups are filled from their start."""
    group = F.shiftright("at", RADIX)
    packed = level.groupBy(group.alias("grp")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("items"))  # at most 256
    row = F.transform("items", lambda x: x["digest"])
    step = lambda acc, _: F.concat(acc, F.array(_halved(F.element_at(acc, -1))))
    levels = packed.select("grp", F.aggregate(F.sequence(F.lit(1), F.lit(RADIX)), F.array(row), step).alias("levels"))
    each = levels.select("grp", F.posexplode("levels").alias("up", "digests")).where("up > 0")
    nodes = each.select("grp", "up", F.posexplode("digests").alias("i", "digest"))
    return nodes.select((F.lit(base) + F.col("up")).alias("level"), (F.expr(f"grp * cast(power(2, {RADIX} - up) AS long)") + F.col("i")).alias("at"), "digest")


def size(nodes: DataFrame) -> int:
    """How many leaves there are."""
    last = nodes.where("level = 0").agg(F.max("at")).first()[0]
    return 0 if last is None else last + 1


def extended(leaves: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The nodes that ``leaves`` (at, digest) add. Of the old ``nodes`` at most 255 per eight levels are read, beside the length."""
    spark = leaves.sparkSession
    checkpoint_dir(spark)
    old = 0 if nodes is None else size(nodes)
    new = leaves.select(F.col("at").cast("long").alias("at"), "digest").checkpoint()
    n, distinct, low, high = new.agg(F.count(F.lit(1)), F.count_distinct("at"), F.min("at"), F.max("at")).first()
    if n == 0:
        return spark.createDataFrame([], NODES)
    if (n, low, high) != (distinct, old, old + n - 1):
        raise ValueError(f"leaves must be numbered without gaps from {old} on")
    out = new.select(F.lit(0).alias("level"), "at", "digest")
    base, level, total = 0, new, old + n
    while total >> base > 1:
        done = old >> base  # old nodes of this level
        start = done >> RADIX << RADIX
        if start < done:
            level = level.unionByName(nodes.where((F.col("level") == base) & (F.col("at") >= start) & (F.col("at") < done)).select("at", "digest"))
        made = _above(level, base)
        made = made.where(F.expr(f"at >= shiftright({old}L, level)")).checkpoint()
        out = out.unionByName(made)
        base += RADIX
        level = made.where(F.col("level") == base).select("at", "digest")
    return out


def peaks(nodes: DataFrame, n: int) -> DataFrame:
    """The peaks of the first ``n`` leaves, at most one per binary digit."""
    wanted = nodes.sparkSession.createDataFrame(peaks_of(n), "level int, at long")
    return nodes.join(F.broadcast(wanted), ["level", "at"])


def root(nodes: DataFrame, n: int) -> DataFrame:
    """One row: ``n`` and the root over the peaks, the highest one first."""
    held = peaks(nodes, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("rank"), "digest"))).alias("held"))  # at most 64
    return held.select(F.lit(n).cast("long").alias("n"), root_digest(F.lit(n), F.transform("held", lambda p: p["digest"])).alias("root"))


def root_digest(n: Column, peak_digests: Column) -> Column:
    return F.sha2(F.concat(F.lit("root:"), n.cast("string"), F.lit(":"), F.array_join(peak_digests, "")), 256)


def _paths(starts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Siblings from each start (level, at) up to the peak over it: (level, at, step, sibling), step 0 first."""
    spark = starts.sparkSession
    spans = spark.createDataFrame([(level, at << level, (at + 1) << level) for level, at in peaks_of(n)], "top int, lo long, hi long")
    first = F.expr("at * cast(power(2, level) AS long)")
    under = starts.join(F.broadcast(spans), (first >= F.col("lo")) & (first < F.col("hi")))
    steps = under.where("top > level").select("level", "at", F.explode(F.sequence(F.lit(0), F.col("top") - F.col("level") - 1)).alias("step"))
    sibling = steps.withColumn("of_level", (F.col("level") + F.col("step")).cast("int")).withColumn("of_at", F.expr("shiftright(at, step) ^ 1L"))
    named = nodes.select(F.col("level").alias("of_level"), F.col("at").alias("of_at"), F.col("digest").alias("sibling"))
    return sibling.join(named, ["of_level", "of_at"]).select("level", "at", "step", "sibling")


def inclusion(positions: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Proof rows (at, step, sibling) that the leaves at ``positions`` are among the first ``n``."""
    return _paths(positions.select(F.lit(0).alias("level"), F.col("at").cast("long").alias("at")), nodes, n).drop("level")


def all_paths(nodes: DataFrame, n: int) -> DataFrame:
    """(block, tree, above): what :func:`inclusion` says of all of the first ``n`` leaves, a row for each 256 of them.

    ``tree`` has the digests of the block by level and place; ``above`` the siblings from the root of the block up to its peak, which its
    leaves share. So the proofs of a whole log take two digests a leaf, not one for each of their steps."""
    fits = F.expr(f"(at + 1) * cast(power(2, level) AS long) <= {n}L")
    under = nodes.where((F.col("level") < RADIX) & fits).withColumn("block", F.expr(f"shiftright(at, {RADIX} - level)"))
    held = under.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("level", "at", "digest"))).alias("held"))  # at most 510
    of_level = lambda k: F.transform(F.filter("held", lambda x: x["level"] == k), lambda x: x["digest"])
    tops = nodes.where((F.col("level") == RADIX) & fits).select("level", "at")
    above = _paths(tops, nodes, n).groupBy(F.col("at").alias("block")).agg(F.array_sort(F.collect_list(F.struct("step", "sibling"))).alias("up"))  # at most 56
    return held.join(above, "block", "left").select("block", F.array(*[of_level(k) for k in range(RADIX)]).alias("tree"),
                                                    F.coalesce(F.transform("up", lambda x: x["sibling"]), F.array().cast("array<string>")).alias("above"))


def _path(at: Column, tree: Column, above: Column) -> Column:
    """The siblings from a leaf up to its peak, by the row of :func:`all_paths` of its block. A node has a sibling if the node above both exists."""
    place = F.pmod(at, F.lit(1 << RADIX)).cast("int")
    steps = []
    for k in range(RADIX):
        has = F.size(tree[0]) == 1 << RADIX if k == RADIX - 1 else F.shiftright(place, k + 1) < F.size(tree[k + 1])
        steps.append(F.when(has, F.get(tree[k], F.shiftright(place, k).bitwiseXOR(F.lit(1)))))
    return F.concat(F.filter(F.array(*steps), lambda x: x.isNotNull()), above)


def all_included(leaves: DataFrame, paths: DataFrame, claimed_peaks: DataFrame) -> DataFrame:
    """:func:`included` by the rows of :func:`all_paths`, with the ``path`` of each leaf. Leaves meet their proofs a block at a time."""
    own = leaves.select(F.col("at").cast("long").alias("at"), "digest")
    packed = own.groupBy(F.shiftright("at", RADIX).alias("block")).agg(F.collect_list(F.struct("at", "digest")).alias("leaves"))  # at most 256
    known = lambda x: F.coalesce(_path(x["at"], F.col("tree"), F.col("above")), F.array().cast("array<string>"))
    each = packed.join(paths, "block", "left").select(F.explode(F.transform("leaves", lambda x: F.struct(x["at"], x["digest"], known(x).alias("siblings")))).alias("x")).select("x.*")
    turned = F.transform("siblings", lambda x, i: F.struct(x.alias("sibling"), (F.get(F.split(F.reverse(F.bin("at")), ""), i) == "1").alias("right")))
    return _judged(_climb(each.withColumn("level", F.lit(0)).withColumn("path", turned)), claimed_peaks).select("at", F.col("siblings").alias("path"), "is_included")


def consistency(nodes: DataFrame, old: int, n: int) -> DataFrame:
    """Proof rows (level, at, step, sibling) that every peak of the first ``old`` leaves is under a peak of the first ``n``."""
    starts = nodes.sparkSession.createDataFrame(peaks_of(old), "level int, at long")
    return _paths(starts, nodes, n)


def _climbed(starts: DataFrame, proofs: DataFrame) -> DataFrame:
    """Starts (level, at, digest) with ``top`` and ``reached``: the peak that their proof leads to and its digest."""
    turned = proofs.withColumn("right", F.expr("shiftright(at, step) & 1L") == 1)  # a right child has its sibling on the left
    told = turned.groupBy("level", "at").agg(F.array_sort(F.collect_list(F.struct("step", "sibling", "right"))).alias("path"))  # at most 64
    both = starts.join(told, ["level", "at"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<step:int,sibling:string,right:boolean>>")))
    return _climb(both)


def _climb(rows: DataFrame) -> DataFrame:
    """Rows (level, digest, path of step, sibling and right) with ``top`` and ``reached``."""
    climb = lambda acc, x: F.when(x["right"], node_digest(x["sibling"], acc)).otherwise(node_digest(acc, x["sibling"]))
    return rows.withColumn("top", F.col("level") + F.size("path")).withColumn("reached", F.aggregate("path", F.col("digest"), climb))


def _judged(climbed: DataFrame, claimed_peaks: DataFrame) -> DataFrame:
    """Climbed leaves with ``is_included``: do they reach one of the claimed peaks?"""
    tops = F.broadcast(claimed_peaks.select(F.col("level").alias("top"), F.col("at").alias("top_at"), F.col("digest").alias("reached"), F.lit(True).alias("is_included")))
    return climbed.withColumn("top_at", F.expr("shiftright(at, top)")).join(tops, ["top", "top_at", "reached"], "left").withColumn("is_included", F.coalesce("is_included", F.lit(False)))


def included(leaves: DataFrame, proofs: DataFrame, claimed_peaks: DataFrame) -> DataFrame:
    """Leaves (at, digest) with ``is_included``: does the proof lead to a peak of the claimed ones (level, at, digest)?"""
    climbed = _climbed(leaves.select(F.lit(0).alias("level"), F.col("at").cast("long").alias("at"), "digest"), proofs.withColumn("level", F.lit(0)))
    return _judged(climbed, claimed_peaks).select("at", F.size("path").alias("n_steps"), "is_included")


def is_consistent(old: int, old_peaks: DataFrame, proofs: DataFrame, n: int, new_peaks: DataFrame) -> bool:
    """Do the proofs lead from all peaks of the old log to peaks of the new one? Peaks are (level, at, digest), at most 64 rows."""
    if sorted((r["level"], r["at"]) for r in old_peaks.collect()) != sorted(peaks_of(old)):
        return False
    if sorted((r["level"], r["at"]) for r in new_peaks.collect()) != sorted(peaks_of(n)):
        return False
    tops = {(r["level"], r["at"], r["digest"]) for r in new_peaks.collect()}
    return all((r["top"], r["at"] >> (r["top"] - r["level"]), r["reached"]) in tops for r in _climbed(old_peaks, proofs).collect())
