"""Dashboard, profile and single-record views over the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lacuna.functions import scalar as S
from lacuna.plans.lens import Estate


def dashboard(est: Estate, findings: DataFrame, risk: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of headline numbers. Each number is one aggregate of its own table."""
    band = F.col("risk_band").isin("CRITICAL", "HIGH") | (F.col("normalized_score") >= 50.0)
    high = (F.col("priority_score") >= 50.0) | F.col("priority_band").isin("CRITICAL", "HIGH")
    found = findings.agg(F.count(F.lit(1)).alias("total_findings"),
                         S.count_where(F.col("severity") == "CRITICAL").alias("critical_findings"),
                         F.coalesce(S.rounded(S.exact_mean(F.col("evidence_completeness"), 2), 1), F.lit(100.0)).alias("avg_evidence_completeness"))
    return (found.withColumn("total_cses", est.entities.agg(F.count(F.lit(1))).scalar())
            .withColumn("critical_cses", risk.agg(S.count_where(band)).scalar())
            .withColumn("open_cases", est.cases.agg(S.count_where(F.col("status") == "OPEN")).scalar())
            .withColumn("high_priority_reviews", queue.agg(F.coalesce(S.count_where(high), F.lit(0))).scalar()))


def entity_profiles(est: Estate, findings: DataFrame, risk: DataFrame) -> DataFrame:
    """Every entity with its asset count, finding count and latest risk."""
    n_assets = est.assets.groupBy("cse_id").agg(F.count(F.lit(1)).alias("asset_count"))
    n_found = findings.groupBy("cse_id").agg(F.count(F.lit(1)).alias("finding_count"))
    scores = risk.select("cse_id", F.col("normalized_score").alias("risk_score"), "risk_band")
    return (est.entities.select(F.col("id").alias("cse_id"), "name", "sector", "entity_type", "size_tier")
            .join(n_assets, "cse_id", "left").join(n_found, "cse_id", "left").join(scores, "cse_id", "left")
            .fillna({"asset_count": 0, "finding_count": 0, "risk_score": 0.0, "risk_band": "LOW"}))


def search_profiles(profiles: DataFrame, term: str = "", band: str = "ALL", sort_by: str = "risk") -> DataFrame:
    """Substring search over name, sector and type, band filter, and one of three orders."""
    out = profiles
    if term:
        t = term.lower()
        out = out.where(F.lower("name").contains(t) | F.lower("sector").contains(t) | F.lower("entity_type").contains(t))
    if band != "ALL":
        out = out.where(F.upper("risk_band") == band)
    order = {"risk": F.desc("risk_score"), "findings": F.desc("finding_count")}.get(sort_by, F.asc("name"))
    return out.orderBy(order, F.asc("cse_id"))


def band_histogram(profiles: DataFrame) -> DataFrame:
    """Entities per risk band; anything unknown counts as LOW."""
    b = F.upper(F.coalesce("risk_band", F.lit("LOW")))
    return (profiles.select(F.when(b.isin("CRITICAL", "HIGH", "MODERATE"), b).otherwise("LOW").alias("risk_band"))
            .groupBy("risk_band").agg(F.count(F.lit(1)).alias("n")))


def latest_risk(history: DataFrame) -> DataFrame:
    """The most recent score per entity out of several runs."""
    newest = history.groupBy("cse_id").agg(F.max_by(F.struct("analysis_run_id", "normalized_score", "risk_band"),
                                                    F.struct("computed_at", "analysis_run_id")).alias("r"))
    return newest.select("cse_id", "r.*")


def by_key(table: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values; the lookup behind every single-record view."""
    out = table
    for name, value in keys.items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out


def queue_history(queue: DataFrame, audit: DataFrame) -> DataFrame:
    """Queue items with the audit events about them, in time order."""
    events = audit.where("entity_type = 'ReviewQueueItem'")
    return (queue.select("queue_item_id", "finding_id", "rank")
            .join(events.withColumnRenamed("entity_id", "queue_item_id").drop("finding_id", "cse_id"), "queue_item_id", "left"))
