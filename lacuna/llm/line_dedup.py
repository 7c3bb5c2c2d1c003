"""Drop lines that many documents share, by two Bloom filters and an exact confirmation.

1. Every document's distinct long line keys are hashed to 128 bits and written once, an array of longs per document.
2. Two Bloom filters over the first half of the hash: seen once, seen twice. A few builders read the hashes; where two builders
   have both seen a key once, the merged filter has it twice. The filters are cut into segments and each segment is merged by itself.
3. Only keys in the seen-twice filter are shuffled: exact counts of documents per 128-bit key, and the largest doc_id.
4. Documents meet the keys they lose by doc_id, in one merge join at every size (a hot id can be split); only texts that lose lines pass
   through Python again.

The filter has about ``BITS_PER_KEY`` bits per key up to ``MAX_FILTER_BYTES``, the bound of what is sent to every worker.
Beyond it more keys are suspected and shuffled; results don't change.

Defined cases: a null or empty text has one empty line; a null doc_id is one document more, never the largest unless it is
alone; rows that repeat a doc_id are one document for the count and all keep or lose alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import SPACE, packed, stage, table, unpacked

MIN_CHARS, MIN_DOCS = 40, 5
BITS_PER_KEY, PROBES = 12, 4
SEGMENT_BITS = 19
MAX_FILTER_BYTES = 64 << 20
BUILDERS = 64


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    line = line.strip(SPACE)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_chars else None  # bytes lower A-Z alone


def key_hash(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _hashes(min_chars: int):
    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            keys = {k for line in (text or "").split("\n") if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None}
            out.append([h for k in sorted(keys) for h in key_hash(k)])
        return pd.Series(out, dtype=object)
    return hashes


class Blooms:
    """The two filters of one builder, as bytes of bits; a key's probes all lie in one segment."""

    def __init__(self, segments: int):
        self.segments = segments
        self.once = np.zeros(segments << (SEGMENT_BITS - 3), np.uint8)
        self.twice = np.zeros_like(self.once)

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, segments: int) -> np.ndarray:
        """Bit numbers of each key, one row per probe."""
        segment = (h1.view(np.uint64) >> np.uint64(33)) % np.uint64(segments)
        step = h2.view(np.uint64) | np.uint64(1)
        probes = np.arange(PROBES, dtype=np.uint64)[:, None]
        inner = (h1.view(np.uint64) + probes * step + probes * probes) & np.uint64((1 << SEGMENT_BITS) - 1)
        return ((segment << np.uint64(SEGMENT_BITS)) | inner).astype(np.int64)

    @staticmethod
    def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)

    @staticmethod
    def put(bits: np.ndarray, places: np.ndarray) -> None:
        places = np.unique(places)
        byte, start = np.unique(places >> 3, return_index=True)
        if len(byte):
            bits[byte] |= np.bitwise_or.reduceat((1 << (places & 7)).astype(np.uint8), start)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        same = np.zeros(len(h1), bool)
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        again = np.append(same[1:], False)[~same]
        places = self.places(h1[~same], h2[~same], self.segments)
        self.put(self.twice, places[:, again | self.has(self.once, places)])
        self.put(self.once, places)


def flat(arrays) -> tuple[np.ndarray, np.ndarray]:
    """First and second halves of all hashes in a column of arrays."""
    parts = [np.asarray(a, np.int64) for a in arrays if a is not None and len(a)]
    both = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return both[::2].copy(), both[1::2].copy()


def repeated_filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """The seen-twice filter of all keys and its number of segments."""
    n = keys.agg(F.sum(F.size("hashes") / 2)).first()[0] or 0
    most = MAX_FILTER_BYTES >> (SEGMENT_BITS - 3)
    segments = min(most, max(1, -(-int(n * BITS_PER_KEY) >> SEGMENT_BITS)))

    def build(it):
        blooms = Blooms(segments)
        for pdf in it:
            blooms.add(*flat(pdf["hashes"]))
        width = 1 << (SEGMENT_BITS - 3)
        rows = [(s, packed(blooms.once[s * width:(s + 1) * width]), packed(blooms.twice[s * width:(s + 1) * width])) for s in range(segments)]
        yield pd.DataFrame(rows, columns=["segment", "once", "twice"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.zeros(1 << (SEGMENT_BITS - 3), np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = unpacked(a, np.uint8), unpacked(b, np.uint8)
            twice, once = twice | b | (once & a), once | a
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "twice": [packed(twice)]})

    built = keys.select("hashes").coalesce(BUILDERS).mapInPandas(build, "segment int, once binary, twice binary")
    merged = built.groupBy("segment").applyInPandas(merge, "segment int, twice binary").collect()  # at most MAX_FILTER_BYTES
    bits = np.zeros(segments << (SEGMENT_BITS - 3), np.uint8)
    for row in merged:
        width = 1 << (SEGMENT_BITS - 3)
        bits[row["segment"] * width:(row["segment"] + 1) * width] = unpacked(row["twice"], np.uint8)
    return bits, segments


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document that loses lines: drop_id and the hashes of the keys it loses."""
    keys = stage(docs.select("doc_id", _hashes(min_chars)("text").alias("hashes")), "keys").where(F.size("hashes") > 0)
    bits, segments = repeated_filter(keys)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def suspects(it):
        for pdf in it:
            n = np.array([len(a) // 2 for a in pdf["hashes"]], np.int64)
            h1, h2 = flat(pdf["hashes"])
            hit = Blooms.has(shared.value, Blooms.places(h1, h2, segments))
            at = np.repeat(np.arange(len(pdf)), n)[hit]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at].reset_index(drop=True), "h1": h1[hit], "h2": h2[hit]})

    rows = stage(keys.mapInPandas(suspects, "doc_id long, h1 long, h2 long"), "suspects").dropDuplicates(["h1", "h2", "doc_id"])
    many = (rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs).drop("n_docs"))
    lost = rows.join(many, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))


def _rewrite(min_chars: int):
    @F.pandas_udf("text string, n_dropped long")
    def rewrite(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        kept, dropped = [], []
        for text, keys in zip(texts, lost, strict=True):
            if keys is None or text is None:
                kept.append(None)
                dropped.append(0)
                continue
            gone = {(k["h1"], k["h2"]) for k in keys}
            lines = text.split("\n")
            stay = [x for x in lines if (k := line_key(x, min_chars)) is None or key_hash(k) not in gone]
            kept.append("\n".join(stay))
            dropped.append(len(lines) - len(stay))
        return pd.DataFrame({"text": pd.Series(kept, dtype=object), "n_dropped": dropped})
    return rewrite


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` with the kept text, and the columns __n_lines and __n_dropped.

    A null text counts as empty and comes back empty. ``n_chars``, where it is a column, follows the text."""
    drops = stage(dropped_keys(docs, min_chars, min_docs), "drops")
    joined = docs.hint("merge").join(drops.select(F.col("drop_id").alias("__drop_id"), F.col("lost").alias("__lost")), F.col("doc_id").eqNullSafe(F.col("__drop_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = joined.withColumn("__new", _rewrite(min_chars)(F.when(F.col("__lost").isNotNull(), text), F.col("__lost")))
    kept = F.coalesce(F.col("__new.text"), text)
    columns = {"text": kept} | ({"n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns],
                         lines.cast("long").alias("__n_lines"), F.coalesce(F.col("__new.n_dropped"), F.lit(0)).cast("long").alias("__n_dropped"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: The rows of :func:`query` in DuckDB's SQL.
SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM split),
trimmed AS (SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS core FROM lines),
keyed AS (SELECT *, CASE WHEN length(core) >= 40 THEN translate(core, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS key FROM trimmed),
many AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE key IS NOT NULL) GROUP BY key HAVING count(*) >= 5),
marked AS (SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.keeper AS lost FROM keyed k LEFT JOIN many m ON k.key = m.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r
"""
