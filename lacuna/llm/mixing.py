"""Mix sources to target weights: repetition rates per source, then whole copies of documents.

The words of a mix are a share of all words. Sources take them by weight; a source stops at ``cap`` times its own words and the
rest is shared again by weight. That is a water level: the target of a source is min(cap * size, level * weight), and the level
follows from the sources ordered by cap * size / weight, without a loop. Each document is then emitted floor(rate)
times, and once more if a hash of its id, its text and its number among equal rows falls below the fraction of the rate.

Only one row per source is ever gathered; a source that holds a third of all rows is summed map side and never joined by a shuffle as
long as the table of sources is small (Spark knows its size, as it is written first).

Defined cases: a null source is a source of its own, last in order; a null or blank text has size 0 and adds nothing; a source
without words has target 0 and its documents are not taken; repeated rows are documents of their own with a draw of their own, as are
rows without an id; an empty table gives no rows; other columns are passed through by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import WORD, id_text, stage, table

SEED = "mix-1"
RUN = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A digest of a text that tells a null text from an empty one."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def draw(doc_id: Column, key: Column, nth: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id, the text, which of the rows equal in both it is, and the seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_text(doc_id), key, nth.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its words, its target and its repetition rate. ``sizes`` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("k", F.row_number().over(order)).withColumn("weight", weight.cast("double"))
    per = per.withColumn("most", F.lit(cap) * F.col("source_size"))
    per = per.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "k")
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("here", (F.lit(share) * F.sum("source_size").over(everything) - full) / rest)
    level = F.max(F.when(F.col("here") <= F.col("ratio"), F.col("here"))).over(everything)
    per = per.withColumn("target", F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(drawn < rate - whole, 1).otherwise(0)).cast("long")


def numbered(sizes: DataFrame, run: int = RUN) -> DataFrame:
    """One row per document with ``nth``, its number among the rows equal in id, source and text. Equal rows are counted map side and
    dealt out again in runs of ``run`` numbers, so a row repeated any number of times is spread over the tasks."""
    counted = sizes.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / run)))).repartition("doc_id", "key", "run")
    last = F.least(F.col("rows"), (F.col("run") + 1) * run) - 1
    return runs.withColumn("nth", F.explode(F.sequence(F.col("run") * run, last))).drop("rows", "run")


def repetition(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate and n_copies."""
    sizes = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_key(F.col("text")).alias("key")), "sizes")
    targets = stage(source_targets(sizes).withColumnRenamed("source", "of_source"), "targets")
    drawn = draw(F.col("doc_id"), F.col("key"), F.col("nth"))
    return (numbered(sizes, run).join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left")
            .withColumn("n_copies", copies(F.col("rate"), drawn)).drop("of_source", "key", "nth"))


def mixed(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as its source's rate and its draw say.

    Only rows that repeat another one in id, source and text are numbered; of one that has more than ``run`` copies they are dealt to runs by hash."""
    sizes = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_key(F.col("text")).alias("key")), "sizes")
    targets = stage(source_targets(sizes).select(F.col("source").alias("__source"), F.col("rate").alias("__rate")), "targets")
    again = sizes.groupBy("doc_id", "source", "key").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    again = stage(again.select(F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("key").alias("__twin"), "__rows"), "again")
    keyed = docs.withColumn("__key", text_key(F.col("text"))).join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__twin"))
    joined = keyed.join(again, same, "left")
    once = joined.where("__rows IS NULL").withColumn("__nth", F.lit(0).cast("long"))
    dealt = joined.where("__rows IS NOT NULL").withColumn("__run", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("__rows") / run)))
    place = F.row_number().over(Window.partitionBy("__key", "doc_id", "source", "__run").orderBy(F.lit(0)))
    many = dealt.withColumn("__nth", F.col("__run") * run + place - 1).drop("__run")
    both = once.unionByName(many)
    n = copies(F.col("__rate"), draw(F.col("doc_id"), F.col("__key"), F.col("__nth")))
    return (both.withColumn("__n", n).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
            .select(*docs.columns))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return (repetition(table(spark, folder, "documents"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken")))


#: The rows of :func:`query` in DuckDB's SQL.
SQL = r"""
WITH sizes AS (SELECT doc_id, source, coalesce(md5(text), 'null') AS key, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM per),
weighted AS (SELECT *, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(2 AS DOUBLE) * source_size AS most FROM ranked),
filled AS (SELECT *, most / weight AS ratio,
    (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM weighted),
levelled AS (SELECT *, max(CASE WHEN here <= ratio THEN here END) OVER () AS lvl FROM filled),
targets AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN most ELSE least(most, lvl * weight) END AS target FROM levelled),
rated AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT *, CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || key || ':' || nth), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM rated)
SELECT doc_id, size, source_size, target,
    CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
