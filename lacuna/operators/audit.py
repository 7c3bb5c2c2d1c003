"""Tamper-evident audit trail.

Events carry a unique, non-negative integer ``seq``. Inside one block of consecutive numbers
every entry is chained to the entry before it, from the genesis value at the very start. The
first entry of a later block is chained to an anchor: a digest over the payloads of *all*
earlier blocks. Anchors are built level by level, so no task ever holds more than one block
of rows or one block of digests, and a change to any past entry still breaks every later anchor.
An anchor depends on earlier blocks alone, never on how long the log is: what was signed stays valid as the log grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lacuna.functions import scalar as S
from lacuna.operators import accumulator as AC
from lacuna.operators.page_index import PageIndex
from lacuna.params import GENESIS_HASH
from lacuna.session import checkpoint_dir

BLOCK = 128
PAYLOAD = ["action", "actor_role", "before_after", "correlation_id", "entity_id", "entity_type", "metadata", "status", "ts", "user_id"]


def payload() -> Column:
    """Canonical JSON of one event without its chain position."""
    values = {name: F.col(name) for name in PAYLOAD}
    values["ts"] = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values["before_after"] = F.coalesce("before_after", F.lit("{}"))
    values["metadata"] = F.coalesce("metadata", F.lit("{}"))
    return S.canonical_json(F.struct(*[values[name].alias(name) for name in PAYLOAD]))


def _prefix_digests(level: DataFrame, block: int) -> DataFrame:
    """(pos, digest) -> (pos, before): digest of everything to the left within the parent, '' if first."""
    up = level.groupBy(F.floor(F.col("pos") / block).alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("items"))
    pieces = F.posexplode("items").alias("i", "item")
    return (up.select("parent", "items", pieces)
            .select("parent", F.col("item.pos").alias("pos"),
                    F.when(F.col("i") > 0, F.sha2(F.array_join(F.transform(F.slice("items", 1, F.col("i")), lambda x: x["digest"]), ""), 256))
                    .otherwise(F.lit("")).alias("before")))


def _parents(level: DataFrame, block: int) -> DataFrame:
    """Digest of each full group of ``block`` siblings."""
    return level.groupBy(F.floor(F.col("pos") / block).alias("pos")).agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))


def levels_for(blocks: DataFrame, block: int = BLOCK) -> int:
    """Levels of digests that a log needs: the fewest whose groups cover the last block."""
    last, levels = blocks.agg(F.max("pos")).first()[0] or 0, 1
    while block ** levels <= last:
        levels += 1
    return levels


def anchors(blocks: DataFrame, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """Value that the first entry of each block is chained to.

    ``blocks`` is (pos, digest). A group holds at most ``block`` digests on every level. Levels that have nothing to the left
    of a block leave no trace in its trail, so more levels, or a longer log, change no anchor. Without ``levels`` there are as many as it takes.
    """
    checkpoint_dir(blocks.sparkSession)
    blocks = blocks.checkpoint()  # one short row per block, so no level hashes payloads again
    levels = levels_for(blocks, block) if levels is None else levels
    out = blocks.select("pos", F.lit("").alias("trail"), F.col("pos").alias("up"))
    level = blocks
    for _ in range(levels):
        before = _prefix_digests(level, block).select(F.col("pos").alias("up"), "before", "parent")
        out = (out.join(before, "up").select("pos", F.concat("trail", F.lit("/"), "before").alias("trail"), F.col("parent").alias("up")))
        level = _parents(level, block)
    trail = F.rtrim("trail", F.lit("/"))
    anchor = F.when(trail == "", F.lit(GENESIS_HASH)).otherwise(F.sha2(trail, 256))
    too_far = F.raise_error(F.lit("sequence number beyond the digest levels")).cast("string")
    return out.select("pos", F.when(F.col("pos") >= block ** levels, too_far).otherwise(anchor).alias("anchor"))


def _hashed(events: DataFrame, block: int) -> DataFrame:
    return events.withColumn("payload", payload()).withColumn("pos", F.floor(F.col("seq") / block))


def block_digests(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pos, digest) of every block; kept beside a log, they spare an append from reading old events."""
    body = F.array_sort(F.collect_list(F.struct("seq", F.sha2("payload", 256).alias("h"))))
    joined = F.array_join(F.transform(body, lambda x: x["h"]), "")
    return _hashed(events, block).groupBy("pos").agg(F.sha2(joined, 256).alias("digest"))  # at most ``block`` rows: seq is unique


def chain(events: DataFrame, block: int = BLOCK, earlier: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """Events with ``previous_hash`` and ``integrity_hash``; ``earlier`` holds the digests of complete blocks before them."""
    rows = _hashed(events, block)
    packed = rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("body"))  # one block
    digests = packed.select("pos", F.sha2(F.array_join(F.transform("body", lambda x: F.sha2(x["payload"], 256)), ""), 256).alias("digest"))
    anchored = packed.join(anchors(digests if earlier is None else earlier.unionByName(digests), block, levels), "pos")
    # Fold along the block; each step hashes the previous hash with the next payload.
    link = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x["payload"]), 256)))
    folded = anchored.withColumn("hashes", F.aggregate("body", F.array(F.col("anchor")), link))
    out = folded.select(F.posexplode("body").alias("i", "entry"), "hashes").select(
        F.col("entry.seq").alias("seq"), F.element_at("hashes", F.col("i") + 1).alias("previous_hash"),
        F.element_at("hashes", F.col("i") + 2).alias("integrity_hash"))
    return events.join(out, "seq")


def append(log: DataFrame, events: DataFrame, block: int = BLOCK, digests: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """New rows of the log for ``events``, whose numbers follow those of ``log``.

    Of the old log only the last number and its unfinished block are read when ``digests`` (see :func:`block_digests`) of the
    finished blocks are at hand; otherwise they are made from the log. An empty log starts a chain."""
    last = log.agg(F.max("seq")).first()[0]
    if last is None:
        return chain(events, block, levels=levels)
    start = last // block * block
    if not events.where(F.col("seq") <= last).isEmpty():
        raise ValueError(f"events must follow number {last}")
    finished = block_digests(log.where(F.col("seq") < start), block) if digests is None else digests.where(F.col("pos") < start // block)
    tail = log.where(F.col("seq") >= start).select(*events.columns)
    return chain(tail.unionByName(events), block, finished, levels).where(F.col("seq") > last)


def verify(log: DataFrame, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """One row: is the log intact, how long is the verified prefix, where is the first break.

    Every entry's own hash is recomputed from its payload and stored predecessor, every link inside a
    block is compared with the entry before it, and every block start with its recomputed
    anchor. All checks are per block; the verdict is a plain minimum.
    """
    log = log.where("integrity_hash is not null")
    hashed = _hashed(log, block)
    starts = anchors(block_digests(log, block), block, levels)
    by_block = Window.partitionBy("pos").orderBy("seq")
    rows = (hashed.select("seq", "pos", "payload", "previous_hash", "integrity_hash")
            .withColumn("before", F.lag("integrity_hash").over(by_block)).join(starts, "pos"))
    expected = F.coalesce("before", "anchor")
    bad_link = F.col("previous_hash").isNotNull() & (F.col("previous_hash") != expected)
    bad_hash = F.sha2(F.concat(F.coalesce("previous_hash", F.lit("")), F.col("payload")), 256) != F.col("integrity_hash")
    checked = rows.select("seq", F.when(bad_link, "BROKEN_LINK").when(bad_hash, "TAMPERED_PAYLOAD").alias("problem"))
    first = checked.where("problem is not null").agg(F.min(F.struct("seq", "problem")).alias("b"))
    first_seq = first.select("b.seq").scalar()
    return (checked.agg(F.count(F.lit(1)).alias("total_events"),
                        S.count_where(F.col("problem").isNotNull()).alias("problem_count"),
                        S.count_where(first_seq.isNull() | (F.col("seq") < first_seq)).alias("verified_count"))
            .withColumn("first_broken_seq", first_seq).withColumn("first_problem", first.select("b.problem").scalar())
            .withColumn("is_intact", F.col("problem_count") == 0)
            .fillna(0, ["problem_count", "verified_count"]))


def search(log: DataFrame, *, date_from=None, date_to=None, **equals) -> DataFrame:
    """Optional time bounds plus equality on user_id, actor_role, action, entity_type, entity_id, status, correlation_id."""
    out = log
    if date_from is not None:
        out = out.where(F.col("timestamp") >= F.to_timestamp(F.lit(date_from)))
    if date_to is not None:
        out = out.where(F.col("timestamp") <= F.to_timestamp(F.lit(date_to)))
    for name, value in equals.items():
        if value:
            out = out.where(F.col(name) == value)
    return out


def leaves(events: DataFrame) -> DataFrame:
    """Leaves (at, digest) of the accumulator over a log; numbers start where the log does."""
    first = events.agg(F.min("seq")).scalar()
    return events.select((F.col("seq") - first).cast("long").alias("at"), AC.leaf_digest(payload()).alias("digest"))


def pages(spark: SparkSession, path: str) -> PageIndex:
    """The log as pages, newest first by ``page(..., newest_first=True)`` and ``page_before``; grows with the log."""
    return PageIndex(spark, path, ["timestamp", "seq"])
