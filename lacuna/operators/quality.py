"""Import quality, data-set profiles and the six-dimension quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions import scalar as S
from lacuna.functions.digest import row_hash


def _pct(part: Column, total: Column) -> Column:
    return S.rounded(part / total * 100.0, 2)


def import_quality(counters: DataFrame, unmapped_assets: int = 0) -> DataFrame:
    """Percentages and the weighted overall score of one import's counters."""
    n = F.col("total")
    rows = counters.where("total > 0").select(
        "total", "accepted", "quarantined", "duplicates", _pct(F.col("accepted"), n).alias("completeness_pct"),
        _pct(n - F.col("invalid_timestamps"), n).alias("timestamp_validity_pct"), _pct(n - F.lit(unmapped_assets), n).alias("asset_mapping_pct"),
        _pct(n - F.col("unmapped_cses"), n).alias("cse_mapping_pct"), _pct(F.col("duplicates"), n).alias("duplicate_rate_pct"),
        _pct(F.col("quarantined"), n).alias("invalid_rate_pct"))
    score = (F.col("completeness_pct") * 0.35 + F.col("timestamp_validity_pct") * 0.25
             + F.col("asset_mapping_pct") * 0.20 + F.col("cse_mapping_pct") * 0.20)
    return (rows.withColumn("overall_quality_score", S.rounded(S.clamp(score), 2))
            .withColumn("confidence_modifier", S.confidence_modifier(F.col("completeness_pct"))))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Blank count and share of every column, all counted in one pass."""
    blank = lambda c: S.count_where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    wide = rows.agg(F.count(F.lit(1)).alias("total"), *[blank(c).alias(f"n_{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("null_count")) for i, c in enumerate(columns)])
    return wide.select("total", F.explode(pairs).alias("p")).select(
        "p.column_name", "p.null_count", F.when(F.col("total") > 0, _pct(F.col("p.null_count"), F.col("total"))).otherwise(0.0).alias("null_pct"))


def table_profile(rows: DataFrame, columns: list[str], time_column: str) -> DataFrame:
    """Row count, exact duplicate rows, and the smallest and largest time *as text*."""
    ts = S.text_or_default(F.col(time_column), None)
    base = rows.select(ts.alias("ts"), row_hash(*[F.col(c) for c in columns]).alias("h"))
    out = base.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct("h").alias("kept"), F.min("ts").alias("timestamp_min"), F.max("ts").alias("timestamp_max"))
    dup = F.col("total_records") - F.col("kept")
    return out.select("total_records", F.lit(len(columns)).cast("long").alias("total_columns"), dup.alias("duplicate_records"),
                      F.when(F.col("total_records") > 0, _pct(dup, F.col("total_records"))).otherwise(0.0).alias("duplicate_pct"), "timestamp_min", "timestamp_max")


def distributions(rows: DataFrame, severity: str = "severity", category: str = "category", entity: str = "cse_id") -> DataFrame:
    """Value counts of severity, category and entity from one scan and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in (
        ("severity", F.upper(severity)), ("category", F.col(category)), ("entity", F.col(entity)))])
    return (rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null AND value <> ''")
            .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))


def top_entities(dist: DataFrame, limit: int = 10) -> DataFrame:
    return dist.where("kind = 'entity'").orderBy(F.desc("n"), F.asc("value")).limit(limit)


# --- fixed values: mandatory fields, weights and grades of the quality score -----------------
REQUIRED_FIELDS = ["timestamp", "created_at", "severity", "category", "cse_id", "asset_id"]
DIMENSIONS = [("Completeness", 0.25), ("Validity", 0.20), ("Consistency", 0.15), ("Uniqueness", 0.15), ("Timeliness", 0.10), ("Schema Conformity", 0.15)]
VALID_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CONSISTENCY_SCORE = 98.0


def quality_score(columns: DataFrame, table: DataFrame, dist: DataFrame, header: list[str]) -> DataFrame:
    """Six dimension scores, the weighted total, a grade and recommendation flags, from profile tables."""
    blanks = columns.where(F.col("column_name").isin(REQUIRED_FIELDS)).agg(F.coalesce(F.avg("null_pct"), F.lit(0.0))).scalar()
    sev = dist.where("kind = 'severity'").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("value").isin(VALID_SEVERITIES), F.col("n"))), F.lit(0)).alias("bad"))
    validity = sev.select(F.when(F.col("n") > 0, 100.0 - F.col("bad") / F.col("n") * 100.0).otherwise(100.0)).scalar()
    lacking = len([c for c in ("cse_id", "severity") if c not in header])
    dated = F.col("timestamp_min").isNotNull() & F.col("timestamp_max").isNotNull()
    rows = table.withColumn("avg_null_pct", blanks).withColumn("validity_raw", validity)
    values = [S.rounded(F.greatest(F.lit(0.0), 100.0 - F.col("avg_null_pct")), 1), S.rounded(F.col("validity_raw"), 1), F.lit(CONSISTENCY_SCORE),
              S.rounded(F.greatest(F.lit(0.0), 100.0 - F.col("duplicate_pct")), 1), F.when(dated, 100.0).otherwise(80.0),
              F.lit({0: 100.0, 1: 50.0}.get(lacking, 0.0))]
    rows = rows.select("*", *[v.alias(f"d{i}") for i, v in enumerate(values)])
    total = sum((F.col(f"d{i}") * w for i, (_, w) in enumerate(DIMENSIONS[1:], 1)), F.col("d0") * DIMENSIONS[0][1])
    rows = rows.withColumn("overall_score", S.rounded(total, 1))
    score = F.col("overall_score")
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return rows.select(*[F.col(f"d{i}").alias(name.lower().replace(" ", "_")) for i, (name, _) in enumerate(DIMENSIONS)], "overall_score", grade.alias("grade"),
                       (F.col("avg_null_pct") > 5.0).alias("advise_missing_fields"), (F.col("duplicate_pct") > 2.0).alias("advise_deduplication"))
