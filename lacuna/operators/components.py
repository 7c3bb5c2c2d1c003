"""Connected components by contraction, and their growth by new edges.

Nodes are numbered once, so that rounds compare and count longs. In a round every node moves to the smallest node that it knows, and the
edges are read between the places moved to: what was connected stays so, and only nodes that some neighbour prefers go on. Numbers are
dealt anew every second round: chains shrink by about half a round, and a hub takes all its leaves within two. Only nodes that still have edges
enter the next round, so all rounds together cost little more than the first, and no node ever meets all others of a
large component in one join: names go up and labels come down the rounds.

Stored labels grow by :func:`merge`: the ends of new edges are read as the labels of their components, so the graph that is solved has at
most as many edges as are new, however many nodes and edges are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.session import scratch, written


def _dealt(node: Column, level: int) -> Column:
    """Another long for every long, in an order that does not follow theirs: both halves are flipped by a hash of the other, so no two become one."""
    half = F.lit(0xFFFFFFFF)
    low = node.bitwiseAND(half)
    high = F.shiftrightunsigned(node, 32).bitwiseXOR(F.hash(low, F.lit(level)).cast("long").bitwiseAND(half))
    low = low.bitwiseXOR(F.hash(high, F.lit(level)).cast("long").bitwiseAND(half))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _settled(names: DataFrame, links: DataFrame, place: str, level: int = 0) -> DataFrame:
    """(node, name, label) for every row of ``names`` (node, name): the smallest name of the component. ``links`` holds pairs a < b of nodes."""
    if links.isEmpty():
        return names.withColumn("label", F.col("name"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    moves = both.groupBy("node").agg(F.least("node", F.min("other")).alias("place"))
    if level % 2:
        moves = moves.withColumn("place", _dealt(F.col("place"), level))
    moves = written(moves, f"moves_{level}", place)
    moved = (links.join(moves.select(F.col("node").alias("a"), F.col("place").alias("c")), "a")
             .join(moves.select(F.col("node").alias("b"), F.col("place").alias("d")), "b").where("c <> d").select(*_pairs("c", "d")).distinct())
    moved = written(moved, f"links_{level + 1}", place)
    placed = written(names.join(moves, "node", "left"), f"placed_{level}", place)
    held = placed.where("place is not null")
    above = written(held.groupBy(F.col("place").alias("node")).agg(F.min("name").alias("name")), f"names_{level + 1}", place)
    above = _settled(above, moved, place, level + 1).select(F.col("node").alias("place"), "label")
    if level:
        above = written(above, f"labels_{level + 1}", place)
    alone = placed.where("place is null").select("node", "name", F.col("name").alias("label"))
    return alone.unionByName(held.join(above, "place").select("node", "name", "label"))


def _solved(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, label) for distinct ``ids``; edges with an end that is none of them link nothing."""
    place = scratch(edges.sparkSession, "contraction")
    named = written(ids.select(F.col("id").alias("name"), _dealt(F.monotonically_increasing_id(), 0).alias("node")), "names_0", place)
    links = (edges.select("src", "dst").where("src <> dst").join(named.select(F.col("name").alias("src"), F.col("node").alias("a0")), "src")
             .join(named.select(F.col("name").alias("dst"), F.col("node").alias("b0")), "dst").select(*_pairs("a0", "b0")).distinct())
    return _settled(named.select("node", "name"), written(links, "links_0", place), place).select("name", "label")


def stars(edges: DataFrame) -> DataFrame:
    """(node, centre) for every end of an edge (src, dst) that is not the smallest of its component; null ends and loops link nothing."""
    known = edges.where("src <> dst").select("src", "dst")
    ids = known.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return _solved(ids, known).where("name <> label").select(F.col("name").alias("node"), F.col("label").alias("centre"))


def labels(node_ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): every node with the smallest node of its component. Edges with an end that is no node link nothing; repeated
    ids keep all their rows, a null id has no label."""
    found = _solved(node_ids.where("id is not null").select("id").distinct(), edges)
    return node_ids.select("id").join(found, F.col("id") == F.col("name"), "left").select("id", "label")


def relabels(stored: DataFrame, new_ids: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(node, centre): components, named by their labels, that new edges join to a smaller one; new nodes are components of their own.

    Of the stored labels only those of the new edges' ends are looked up."""
    named = stored.select("id", "label").unionByName(new_ids.select("id", F.col("id").alias("label")))
    ends = new_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    wanted = named.join(ends, "id", "left_semi").distinct()
    contracted = (new_edges.select("src", "dst").join(wanted.select(F.col("id").alias("src"), F.col("label").alias("a")), "src")
                  .join(wanted.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst"))
    return stars(contracted.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def merge(stored: DataFrame, new_ids: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The labels of the grown graph, equal to :func:`labels` of all nodes and edges. ``new_ids`` must not be stored yet."""
    moved = relabels(stored, new_ids, new_edges)
    named = stored.select("id", "label").unionByName(new_ids.select("id", F.col("id").alias("label")))
    return named.join(moved, F.col("label") == F.col("node"), "left").select("id", F.coalesce("centre", "label").alias("label"))
