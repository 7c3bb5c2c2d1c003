"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are matches of a few patterns in whole texts. The hash of each candidate's value is counted over the corpus by distinct
repositories and distinct owners. A value that many owners or many repositories hold is a widely copied example; one that a single
owner holds and that looks live (letters and digits, many different characters, no placeholder word) is a live credential; all
others stay unsure. Base kinds are always reported; the two kinds of the method itself (keys with a provider's prefix and
opaque strings, outside of base spans) are reported only where they are judged live.

Places come from the lengths of the pieces between matches, summed in order, so no text is searched a second time for a place. One
scan reads the texts; what follows works on candidates. A value pasted into a third of all documents is counted by (value, owner,
repository) first, and its verdict goes back over salted keys.

Defined cases: a null text is empty; texts without spans give counts of 0, the digest of the empty string and empty ``spans``; a null owner
is the owner ''; a document without an id is the repository of its text; repeated rows are rows of their own but one
repository; rows equal in everything give equal rows; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import stage, table


def either_case(words: str) -> str:
    """A pattern whose ASCII letters match in either case, in any regular-expression engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


class Kind(NamedTuple):
    """A kind of candidate: ``value`` is the group that is hashed, ``least`` the fewest characters of it (of the match for group 0)."""

    name: str
    pattern: str
    value: int
    least: int
    base: bool


NAMED = either_case("password|passwd|secret|token|api_?key")
#: Prefixes that public providers give to their keys.
PREFIXED = (r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}"
            r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
OPAQUE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
KINDS = [
    Kind("assign", rf"""({NAMED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, True),  # the runs of [0-9a-f]+ that are long enough
    Kind("key", PREFIXED, 0, 1, False),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])" + OPAQUE, 0, 24, False),
]
#: Words of values that stand for a secret without being one.
PLACEHOLDER = either_case("example|sample|dummy|changeme|placeholder|redacted|your|xxxx")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 8
DISTINCT = 8
SALTS = 32


def _matches(text: Column, kind: Kind, order: int) -> Column:
    """The kind's matches and the lengths of what lies before each of them."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.when(F.size(found) > 0, F.transform(F.split(text, kind.pattern, -1), F.char_length))
    return F.struct(F.lit(order).alias("kind"), found.alias("found"), gaps.alias("gaps"))


def looks_live(value: Column) -> Column:
    """Letters and digits, at least ``DISTINCT`` different characters, no placeholder word."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT))


def scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: __row, doc_id, owner, repository and the matches of every kind. Written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", owner.alias("owner"), repository.alias("repository"),
                       F.array(*[_matches(text, kind, k) for k, kind in enumerate(KINDS)]).alias("kinds"))
    return stage(base.withColumn("kinds", F.filter("kinds", lambda k: F.size(k["found"]) > 0)), "scanned")


def candidates(scan: DataFrame) -> DataFrame:
    """One row per candidate: __row, owner, repository, kind, start, end (code points), value hash and shape.

    A kind's match must be long enough; a candidate of the method's own kinds must lie outside all base spans of its text."""
    each = scan.select("__row", "owner", "repository", F.explode("kinds").alias("k"))
    each = each.select("__row", "owner", "repository", F.col("k.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("k.found"), F.col("k.gaps"))).alias("place", "m"))
    each = each.where(F.col("m.found").isNotNull())  # the last piece follows the last match
    length = F.char_length("m.found")
    upto = Window.partitionBy("__row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("m.gaps") + length).over(upto)).withColumn("start", F.col("end") - length)
    value = F.col("m.found")
    long_enough = F.lit(False)
    for k, kind in enumerate(KINDS):
        own = F.regexp_extract(F.col("m.found"), kind.pattern, kind.value) if kind.value else F.col("m.found")
        value = F.when(F.col("kind") == k, own).otherwise(value) if kind.value else value
        long_enough = F.when(F.col("kind") == k, F.char_length(own) >= kind.least).otherwise(long_enough)
    each = each.where(long_enough).withColumn("value", value)
    base = F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.base])
    by_start = Window.partitionBy("__row").orderBy("start")
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(base, F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    covered = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    each = each.withColumn("covered", covered).where(base | ~F.col("covered"))
    return stage(each.select("__row", "owner", "repository", "kind", "start", "end", F.sha2("value", 256).alias("hash"), looks_live(F.col("value")).alias("shape")), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: owners and repositories (of an owner) that hold it, and its verdict."""
    held = found.groupBy("hash", "owner", "repository").agg(F.max("shape").alias("shape"))
    held = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("shape").alias("shape"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("shape").alias("shape"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    verdict = F.when(copied, "example").when((F.col("owners") == 1) & F.col("shape"), "live").otherwise("unsure")
    return held.select("hash", "owners", "repositories", verdict.alias("verdict"))


def judged(found: DataFrame) -> DataFrame:
    """Every candidate with the verdict of its value; copies of one value are spread over ``SALTS`` join keys.

    Merged on purpose: the planner sees neither the ``SALTS`` copies of a verdict nor how wide candidates are out of their files, and would
    gather either side in the driver to broadcast it."""
    salt = F.pmod(F.xxhash64("__row", "start"), F.lit(SALTS)).cast("int")
    verdicts = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", salt).join(verdicts.hint("merge"), ["hash", "salt"])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts, n_live and n_example.

    ``verdicts`` has one word for each of ``spans``."""
    scan = scanned(docs, owner, repository)
    spans = judged(candidates(scan)).where(F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.base]) | (F.col("verdict") == "live"))
    per_row = spans.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("spans"))  # one text's own spans
    none = F.from_json(F.lit("[]"), "array<struct<start:long,kind:int,end:long,verdict:string>>")
    out = scan.select("__row", "doc_id").join(per_row, "__row", "left").withColumn("spans", F.coalesce("spans", none))
    n_base = sum(kind.base for kind in KINDS)
    base = F.filter("spans", lambda s: s["kind"] < n_base)

    def count(field: str, value) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    of_kind = [count("kind", k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS) if kind.base]
    return out.select("doc_id", *of_kind, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                      F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"), count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_example"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Over ``documents``: a source is an owner, a document a repository."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    repository = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    return secret_spans(docs, F.coalesce("source", F.lit("")), repository)


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    plain = [kind._replace(pattern=kind.pattern.replace(r"(?<![A-Za-z0-9+/_-])", "")) for kind in KINDS]  # runs are whole either way
    kinds = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, unnest(list_zip(generate_series(1, len(f)), f, p[1:len(f)])) AS m FROM (SELECT r, regexp_extract_all(t, {quoted(kind.pattern)}) AS f, string_split_regex(t, {quoted(kind.pattern)}) AS p FROM d)"
        for k, kind in enumerate(plain))
    value = f"CASE WHEN kind = 0 THEN regexp_extract(w, {quoted(KINDS[0].pattern)}, 2) ELSE w END"
    least = " ".join(f"WHEN {k} THEN {kind.least}" for k, kind in enumerate(KINDS))
    name = " ".join(f"WHEN {k} THEN '{kind.name}'" for k, kind in enumerate(KINDS))
    n_base = sum(kind.base for kind in KINDS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t,
    coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS repository FROM documents),
m AS ({kinds}),
p AS (SELECT r, kind, m[2] AS w, CAST(sum(length(m[3]) + length(m[2])) OVER (PARTITION BY r, kind ORDER BY m[1]) AS BIGINT) AS e FROM m),
v AS (SELECT r, kind, e - length(w) AS s, e, {value} AS v FROM p),
c AS MATERIALIZED (SELECT * FROM v WHERE length(v) >= CASE kind {least} END),
f AS MATERIALIZED (SELECT r, kind, s, e, sha256(v) AS h, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, {quoted(PLACEHOLDER)})
        AND len(list_distinct(string_split(v, ''))) >= {DISTINCT} AS shape
    FROM c WHERE kind < {n_base} OR NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.kind < {n_base} AND b.s < c.e AND c.s < b.e)),
o AS (SELECT h, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories, bool_or(shape) AS shape FROM f JOIN d USING (r) GROUP BY h),
j AS (SELECT r, kind, s, e, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 'example' WHEN owners = 1 AND o.shape THEN 'live' ELSE 'unsure' END AS verdict,
        CASE kind {name} END || ':' || s || ':' || e AS span FROM f JOIN o USING (h)),
k AS (SELECT * FROM j WHERE kind < {n_base} OR verdict = 'live'),
g AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {n_base}) AS base,
        string_agg(span, ',' ORDER BY s, kind) AS spans, string_agg(verdict, ',' ORDER BY s, kind) AS verdicts, count(*) FILTER (verdict = 'live') AS live, count(*) FILTER (verdict = 'example') AS ex
    FROM k GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(verdicts, '') AS verdicts, coalesce(live, 0) AS n_live, coalesce(ex, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""


#: The rows of :func:`query` in DuckDB's SQL.
SQL = _sql()
