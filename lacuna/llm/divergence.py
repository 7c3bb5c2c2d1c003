"""Source divergence audit: how far the word use of each source is from the other sources of its language, in exact integers.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that enough of its
documents hold. The kept terms of a language are sorted and numbered: the ordinal of a term is its place among them. Minimal
acyclic transducers hold them: equal suffixes share states, and the numbers on the arcs add up to a term's place. The texts are
then read again and their terms stream through the transducers, which drop what isn't kept and give the rest as ordinals. From there on terms
are numbers: counts, sums over all kept terms and ties need no strings, and only terms that are reported are spelled out again.

The vocabulary is held in two tiers. The terms of most documents, at most ``HEAD_TERMS`` of them with at most ``HEAD_BYTES`` bytes, make one transducer per
language that every reading task has; nearly all of a text's words end there and leave the task as packed arrays of counts. The rest of
a text's words, few and mostly unkept, flow in sorted ranges together with the kept terms of the same ranges, and each range has
a transducer of its own. Both tiers count exactly, so where the line between them lies changes no result.

Sums over all terms of a language are made in chunks of ordinals, each a small matrix of sources by terms, so a term that no text
of a source holds counts with its smoothed share as the definition wants. The report of a group's leading terms is cut in each chunk first.

Only the first tier, whose size is a parameter, is sent to all workers. A hot source or word is summed in the reading tasks.

Defined cases: null text, lang and source are ''; a text without terms still makes its group occur; a language without kept terms has value 0 for
all pairs and no term rows; a language with one source has no pairs; repeated rows are documents of their own; equal values go by the
order of UTF-8 bytes; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import stage, table

LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP = 200

HEAD_TERMS, HEAD_BYTES = 400_000, 8 << 20
RANGE_TERMS = 200_000
HELD = 400_000
CHUNK_CELLS = 1 << 17

#: Bytes of terms, upper case to lower; all others separate.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order. Characters beyond ASCII consist of bytes beyond ASCII, so bytes suffice."""
    return text.translate(LETTERS).split() if text else []


class Transducer:
    """A minimal acyclic transducer from sorted byte strings to their ordinals, as arrays of arcs ordered by (state, byte).

    State 0 is the start. An arc adds the number of strings that end before those behind it; the sum along a string's path is its
    place, and ``ordinals`` has the ordinal of each place."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray, ordinals: np.ndarray):
        self.keys, self.targets, self.adds, self.final, self.of_place = keys, targets, adds, final, ordinals

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 for strings that aren't in the vocabulary; all words walk a byte at a time together."""
        size = np.array([len(w) for w in words], np.int64)
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, out, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        depth = 0
        while len(at):
            ends = size[at] == depth
            done = at[ends]
            out[done[~self.final[state[done]]]] = -1
            at = at[~ends]
            key = state[at] << 8 | flat[start[at] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            found = self.keys[arc] == key if len(self.keys) else np.zeros(len(at), bool)
            out[at[~found]] = -1
            at, arc = at[found], arc[found]
            state[at] = self.targets[arc]
            out[at] += self.adds[arc]
            depth += 1
        return np.where(out < 0, -1, self.of_place[out]) if len(self.of_place) else out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.keys), len(self.of_place)], np.int64)
        return b"".join(a.tobytes() for a in (sizes, self.keys, self.targets, self.adds, self.of_place, self.final))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        arcs, places = np.frombuffer(blob, np.int64, 2).tolist()
        numbers = np.frombuffer(blob, np.int64, 3 * arcs + places, 16)
        return cls(*np.split(numbers[:3 * arcs], 3), np.frombuffer(blob, bool, -1, 16 + 8 * len(numbers)), numbers[3 * arcs:])


class Builder:
    """Builds a transducer from strings that come in sorted order, each once.

    Only the states on the path of the last string are open. A state is closed when no later string can change it; if a closed
    state with the same arcs and finality exists, it takes its place. States behind arcs are therefore closed first."""

    def __init__(self):
        self.closed: dict[tuple, int] = {}
        self.counts: list[int] = []
        self.open: list[list] = [[False]]  # finality, then arcs
        self.last, self.ordinals = b"", []

    def add(self, word: bytes, ordinal: int) -> None:
        same = 0
        for x, y in zip(word, self.last, strict=False):
            if x != y:
                break
            same += 1
        self._close(same)
        self.open.extend([False] for _ in range(len(word) - same))
        self.open[-1][0] = True
        self.last = word
        self.ordinals.append(ordinal)

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            number = self._number(tuple(self.open.pop()))
            self.open[-1].append((self.last[len(self.open) - 1], number))

    def _number(self, state: tuple) -> int:
        number = self.closed.get(state)
        if number is None:
            number = self.closed[state] = len(self.counts)
            self.counts.append(state[0] + sum(self.counts[to] for _, to in state[1:]))
        return number

    def finish(self) -> Transducer:
        """The transducer; the start is closed last and renumbered to 0."""
        self._close(0)
        start = self._number(tuple(self.open[0]))
        last = len(self.counts) - 1
        keys, targets, adds, final = [], [], [], np.zeros(last + 1, bool)
        for state, number in self.closed.items():
            final[last - number] = state[0]
            before = int(state[0])
            for byte, to in state[1:]:
                keys.append((last - number) << 8 | byte)
                targets.append(last - to)
                adds.append(before)
                before += self.counts[to]
        assert start == last, "the start has the most strings behind it"
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        return Transducer(*(np.array(a, np.int64)[order] for a in (keys, targets, adds)), final, np.array(self.ordinals, np.int64))


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (lang, term, docs), summed within a task: the documents that hold a term."""
    names, kinds = ["lang", "term", "docs"], [pa.string(), pa.binary(), pa.int64()]
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        return _batch(names, kinds, [[lang for lang, c in held.items() for _ in c], [t for c in held.values() for t in c], [n for c in held.values() for n in c.values()]])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            held[lang].update(set(terms_of(text.as_py())))
        if sum(map(len, held.values())) >= HELD:
            yield out()
            held.clear()
    yield out()


COUNTED = "lang string, source string, chunk long, width long, at binary, n binary, total long, term binary"
NAMES = [c.split()[0] for c in COUNTED.split(", ")]
KINDS = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in COUNTED.split(", ")]


def _packed(lang: str, source: str, width: int, ordinals: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of one source's terms as one row per chunk of ``width`` ordinals."""
    order = np.argsort(ordinals)
    ordinals, n = ordinals[order], n[order]
    chunks, first = np.unique(ordinals // width, return_index=True)
    ends = np.append(first[1:], len(n))
    at = (ordinals % width).astype(np.int32)
    k = len(chunks)
    return _batch(NAMES, KINDS, [[lang] * k, [source] * k, chunks, [width] * k, [at[i:j].tobytes() for i, j in zip(first, ends, strict=True)],
                                 [n[i:j].tobytes() for i, j in zip(first, ends, strict=True)], np.add.reduceat(n, first) if k else [], [None] * k])


def _streamed(shared):
    """Texts to counts: packed by ordinal for terms of the first tier, (lang, source, term, total) for all others."""
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {lang: (Transducer.from_bytes(blob), width) for lang, blob, width in shared.value}
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in {lang for lang, _ in held}:
                own = {source: c for (x, source), c in held.items() if x == lang}
                walk, width = walks.get(lang, (None, 0))
                words = list(set().union(*own.values()))
                known = dict(zip(words, walk.ordinals(words).tolist(), strict=True)) if walk else {}
                for source, c in own.items():
                    ordinals = np.fromiter((known.get(t, -1) for t in c), np.int64, len(c))
                    n = np.fromiter(c.values(), np.int64, len(c))
                    found = ordinals >= 0
                    if found.any():
                        yield _packed(lang, source, width, ordinals[found], n[found])
                    others = [t for t, f in zip(c, found.tolist(), strict=True) if not f]
                    k = len(others)
                    yield _batch(NAMES, KINDS, [[lang] * k, [source] * k, [None] * k, [None] * k, [None] * k, [None] * k, n[~found], others])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
                held[lang, source].update(terms_of(text.as_py()))
            if sum(map(len, held.values())) >= HELD:
                yield from out()
        yield from out()
    return streamed


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of kept terms (lang, term, ordinal, width), then the texts' terms of the same range (lang, source, term, total): packed counts."""
    builders: dict[str, Builder] = defaultdict(Builder)
    widths: dict[str, int] = {}
    walks: dict[str, Transducer] = {}
    held: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in held.items():
            yield _packed(lang, source, widths[lang], np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c)))
        held.clear()

    for batch in batches:
        kept = batch["total"].null_count  # kept terms come first
        for lang, term, ordinal, width in zip(*(batch[c][:kept].to_pylist() for c in ("lang", "term", "ordinal", "width")), strict=True):
            builders[lang].add(term, ordinal)
            widths[lang] = width
        if kept == batch.num_rows:
            continue
        if not walks:
            walks = {lang: b.finish() for lang, b in builders.items()}
        langs, sources, terms, total = (batch[c][kept:].to_pylist() for c in ("lang", "source", "term", "total"))
        for lang in set(langs) & walks.keys():
            at = [k for k, x in enumerate(langs) if x == lang]
            for k, ordinal in zip(at, walks[lang].ordinals([terms[k] for k in at]).tolist(), strict=True):
                if ordinal >= 0:
                    held[lang, sources[k]][ordinal] += total[k]
        if sum(map(len, held.values())) >= HELD:
            yield from out()
    yield from out()


def _built(terms: pa.Table) -> pa.Table:
    """The first-tier terms of a language to their transducer."""
    b = Builder()
    for term, ordinal in sorted(zip(terms["term"].to_pylist(), terms["ordinal"].to_pylist(), strict=True)):
        b.add(term, ordinal)
    return pa.table({"lang": pa.array([terms["lang"][0].as_py()], pa.string()), "blob": pa.array([b.finish().to_bytes()], pa.binary()), "width": pa.array([terms["width"][0].as_py()], pa.int64())})


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + kept)), exact at any size."""
    if int(count.max(initial=0)) < (1 << 62) // UNIT:
        return 1 + UNIT * (count + 1) // (total + kept)
    return (1 + UNIT * (count.astype(object) + 1) // (total + kept)).astype(np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


MEASURED = "lang string, source string, other string, ordinal long, value long"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of a chunk of ordinals and one header row (kept, terms, first, sources, totals): part sums of all pairs and leading terms."""
    head, held = None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["sources"] is not None:
                head = r
            else:
                mine = held.setdefault(r["source"], np.zeros(r["width"], np.int64))
                mine[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int64)  # a row has an ordinal once
    sources, totals, kept, terms, first = head["sources"], head["totals"], head["kept"], head["terms"], head["first"]
    counts = np.stack([held[s][:terms] if s in held else np.zeros(terms, np.int64) for s in sources])
    p = np.stack([share(c, t, kept) for c, t in zip(counts, totals, strict=True)]) if kept else np.ones((len(sources), 0), np.int64)
    q = share(counts.sum(axis=0), sum(totals), kept) if kept else np.ones(0, np.int64)
    out: dict[str, list] = {c: [] for c in ("source", "other", "ordinal", "value")}

    def put(source, other, ordinal, value):
        for c, v in zip(out, ([source] * len(value), other, ordinal, value), strict=True):
            out[c].extend(v)

    for k, source in enumerate(sources):
        others = [j for j in range(len(sources)) if j != k]
        if others:
            put(source, [sources[j] for j in others], [None] * len(others), [int(gap(p[k], p[j]).sum()) for j in others])
        leads = np.flatnonzero((counts[k] > 0) & (p[k] > q))
        value = gap(p[k][leads], q[leads])
        best = np.lexsort((leads, -value))[:TOP]
        leads = leads[best]
        put(source, [None] * len(leads), (leads + first).tolist(), value[best].tolist())
    kinds = {"source": pa.string(), "other": pa.string()}
    n = len(out["value"])
    yield pa.RecordBatch.from_pydict({"lang": pa.array([head["lang"]] * n, pa.string()), **{c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()}})


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, term, docs) of ``docs`` (lang, text as bytes): terms in at least so many documents of the language."""
    held = docs.select("lang", "text").mapInArrow(_holders, "lang string, term binary, docs long")
    return held.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)


def numbered(kept: DataFrame, range_terms: int = RANGE_TERMS) -> DataFrame:
    """The kept terms with their ordinal in the language and ``head``, whether they belong to the first tier.

    Terms are sorted by ranges; the numbers of a range's rows are consecutive, so few counts per range give all ordinals. The first tier takes whole
    classes of document counts (powers of two) from the top, as many as its bounds allow."""
    kept = stage(kept, "kept")
    ranges = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // range_terms))
    rows = stage(kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term").withColumn("row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("row", 33).alias("part")  # rows of a partition are numbered from part * 2**33
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))
    bases = bases.select("lang", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    level = F.floor(F.log2("docs"))
    classes = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("bytes")).orderBy(F.desc("level")).collect()  # 63 at most
    n = size = 0
    line = 64
    for c in classes:
        n, size = n + c.n, size + c.bytes
        if n > HEAD_TERMS or size > HEAD_BYTES:
            break
        line = c.level
    out = rows.withColumn("part", part).join(bases, ["lang", "part"])
    return stage(out.select("lang", "term", (F.col("row") + F.col("shift")).alias("ordinal"), (level >= line).alias("head")), "numbered")


def recount(docs: DataFrame, terms: DataFrame, widths: DataFrame, range_terms: int = RANGE_TERMS) -> DataFrame:
    """Counts of the texts' kept terms, packed by chunks of ``width`` ordinals: lang, source, chunk, width, at, n and their total.

    ``terms`` are numbered; ``widths`` has lang and width."""
    spark = docs.sparkSession
    terms = terms.join(widths, "lang")
    head = terms.where("head").groupBy("lang").applyInArrow(_built, "lang string, blob binary, width long")
    shared = spark.sparkContext.broadcast([(r.lang, bytes(r.blob), r.width) for r in head.collect()])  # bounded by HEAD_TERMS and HEAD_BYTES
    read = stage(docs.mapInArrow(_streamed(shared), COUNTED), "streamed")
    rest = stage(terms.where("not head").select("lang", "term", "ordinal", "width"), "rest")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rest.count() // range_terms))
    flow = rest.unionByName(read.where("term is not null").select("lang", "source", "term", "total"), allowMissingColumns=True)
    flow = flow.repartitionByRange(ranges, "lang", "term").sortWithinPartitions(F.col("total").isNotNull(), "lang", "term")
    ranged = stage(flow.mapInArrow(_ranged, COUNTED), "ranged")
    return read.where("term is null").union(ranged).drop("term")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of ``docs`` (text, lang, source): part `pair` measures each other source of the language, part
    `term` the terms that the source uses more than its language."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), F.col("text").cast("binary").alias("text"))
    terms = numbered(kept_terms(docs, least_docs))
    groups = stage(docs.groupBy("lang", "source").count(), "groups")
    width = F.greatest(F.lit(1), F.floor(F.lit(chunk_cells) / F.count(F.lit(1)))).cast("long")
    widths = stage(groups.groupBy("lang").agg(width.alias("width")), "widths")
    counts = recount(docs, terms, widths)
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("g"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("g")).alias("groups")).join(widths, "lang")  # the sources of a language
    langs = langs.join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))

    chunks = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr("(kept - 1) div width"), F.lit(0)))
    heads = langs.select("lang", F.explode(chunks).alias("chunk"), "kept", "width", F.col("groups.source").alias("sources"), F.col("groups.total").alias("totals"))
    heads = heads.withColumn("first", F.col("chunk") * F.col("width")).withColumn("terms", F.least("width", F.col("kept") - F.col("first")))
    cells = counts.select("lang", "chunk", "source", "width", "at", "n").unionByName(heads, allowMissingColumns=True).groupBy("lang", "chunk")
    measured = stage(cells.applyInArrow(_measured, MEASURED), "measured")

    group = Window.partitionBy("lang", "source")
    pairs = measured.where("other is not null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    leads = measured.where("other is null").withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    spelled = leads.join(terms.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")
    return part(pairs, "pair").union(part(spelled, "term"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


#: The rows of :func:`query` in DuckDB's SQL.
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
k AS MATERIALIZED (SELECT lang, w FROM d GROUP BY lang, w HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS MATERIALIZED (SELECT lang, source, w, count(*) AS n FROM d JOIN k USING (lang, w) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.w, coalesce(n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0)::HUGEINT + v) AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, w)),
q AS (SELECT lang, w, 1 + ({UNIT}::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v))::HUGEINT AS q FROM c JOIN v USING (lang) GROUP BY lang, w),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.w = x.w GROUP BY ALL),
terms AS (SELECT lang, source, w AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, w) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms QUALIFY rank <= {TOP}
"""
