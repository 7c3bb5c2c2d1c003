"""Decomposable risk score per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.functions import scalar as S
from lacuna.params import RISK, RiskParams
from lacuna.plans.lens import Estate

COMPONENTS = ["execution_gap", "negative_space", "peer_deviation", "investigation_anomaly", "asset_criticality"]


def is_active() -> Column:
    """Neither withdrawn by status nor described as suppressed."""
    quiet = F.upper(F.coalesce("reason", F.lit(""))).contains("SUPPRESSED") | \
        F.upper(F.coalesce("observed_behaviour", F.lit(""))).contains("SUPPRESSED")
    return ~F.col("status").isin("SUPPRESSED", "DISMISSED") & ~quiet


def _by_severity(critical: float, high: float, medium: float, other: float) -> Column:
    s = F.col("severity")
    return (F.when(s == "CRITICAL", critical).when(s == "HIGH", high).when(s == "MEDIUM", medium).otherwise(other))


def component() -> Column:
    rule = F.col("rule_id")
    return (F.when(rule.isin("GAP-02", "GAP-04", "GAP-05"), "investigation_anomaly")
            .when(rule.startswith("GAP"), "execution_gap").when(rule == "NEG-04", "peer_deviation")
            .when(rule.startswith("NEG"), "negative_space"))


def base_contribution() -> Column:
    part = F.col("component")
    return (F.when(part == "investigation_anomaly", 15.0)
            .when(part == "execution_gap", _by_severity(30.0, 25.0, 18.0, 10.0))
            .when(part == "peer_deviation", 20.0)
            .when(part == "negative_space", _by_severity(25.0, 20.0, 15.0, 8.0)))


def contributions(findings: DataFrame, params: RiskParams = RISK) -> DataFrame:
    """Component and confidence-adjusted contribution of every finding that counts."""
    conf = S.clamp(F.col("confidence"), 0.0, 1.0)
    weak = F.col("clamped_confidence") < params.low_confidence
    return (findings.where(is_active()).withColumn("component", component()).where("component is not null")
            .withColumn("base_contribution", base_contribution()).withColumn("clamped_confidence", conf)
            .withColumn("effective_contribution", F.when(weak, S.rounded(
                F.col("base_contribution") * F.greatest(F.lit(params.confidence_floor), F.col("clamped_confidence")), 2))
                .otherwise(F.col("base_contribution")))
            .withColumn("is_qualified", weak)
            .select("analysis_run_id", "cse_id", "finding_id", "rule_id", "severity", "reason", "component",
                    "base_contribution", "effective_contribution", F.col("clamped_confidence").alias("confidence"),
                    "is_qualified", "evidence_refs"))


def asset_component(assets: DataFrame, params: RiskParams = RISK) -> DataFrame:
    active = assets.where("status = 'ACTIVE'")
    return active.groupBy("cse_id").agg(
        F.bool_or(F.col("criticality") == "CRITICAL").alias("has_critical"),
        F.bool_or(F.col("criticality") == "HIGH").alias("has_high"))


def entity_risk(est: Estate, findings: DataFrame, params: RiskParams = RISK) -> DataFrame:
    """One score per entity: the maximum per component, capped, then summed."""
    parts = contributions(findings, params)
    scored = parts.groupBy("cse_id").agg(
        *[F.max(F.when(F.col("component") == c, F.col("effective_contribution"))).alias(f"raw_{c}") for c in COMPONENTS[:4]],
        F.count(F.lit(1)).alias("contributing_findings"), S.count_where(F.col("is_qualified")).alias("qualified_findings"),
        S.exact_mean(F.col("confidence"), 4).alias("mean_confidence"))
    crit = asset_component(est.assets, params)
    rows = (est.entities.select(F.col("id").alias("cse_id"), F.col("name").alias("cse_name"))
            .join(scored, "cse_id", "left").join(crit, "cse_id", "left"))
    level = F.when(F.col("has_critical"), 10.0).when(F.col("has_high"), 6.0).otherwise(0.0)
    points = {c: F.coalesce(F.col(f"raw_{c}"), F.lit(0.0)) for c in COMPONENTS[:4]} | {"asset_criticality": level}
    rows = rows.withColumns({c: F.least(F.lit(params.caps[c]), F.greatest(F.lit(0.0), v)) for c, v in points.items()})
    raw = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    score = S.rounded(S.clamp(raw), 2)
    rows = rows.withColumns({"raw_score": raw, "normalized_score": score, "risk_band": S.risk_band(score),
                             "overall_confidence": F.coalesce(S.rounded(F.col("mean_confidence"), 4), F.lit(1.0))})
    return rows.select(
        S.key_hash(F.lit(est.run_id), F.col("cse_id")).alias("risk_score_id"), F.lit(est.run_id).alias("analysis_run_id"),
        "cse_id", "cse_name", *COMPONENTS, "raw_score", "normalized_score", "risk_band", "overall_confidence",
        F.coalesce("contributing_findings", F.lit(0)).cast("long").alias("contributing_findings"),
        F.coalesce("qualified_findings", F.lit(0)).cast("long").alias("qualified_findings"))


def explanation_refs(parts: DataFrame, params: RiskParams = RISK) -> DataFrame:
    """The first references behind each score.

    The rank filter is a literal, so every task drops all but its own first rows before the shuffle.
    """
    refs = parts.select("cse_id", "finding_id", F.posexplode("evidence_refs").alias("position", "ref"))
    order = Window.partitionBy("cse_id").orderBy("finding_id", "position")
    return (refs.withColumn("ref_rank", F.row_number().over(order)).where(F.col("ref_rank") <= params.explanation_refs)
            .select("cse_id", "ref_rank", "finding_id", "ref.source_table", "ref.source_record_id"))


def explanations(risk: DataFrame) -> DataFrame:
    """Title, caps and breakdown as one document per entity. Contributors stay a table of their own."""
    breakdown = F.struct(*[F.col(c) for c in sorted(COMPONENTS)])
    return risk.select("cse_id", F.concat(
        F.lit("Supervisory risk of "), F.col("cse_name"), F.lit(": "), S.one_decimal(F.col("normalized_score")),
        F.lit(" / 100, "), F.col("risk_band")).alias("title"),
        S.canonical_json(F.struct(breakdown.alias("component_breakdown"),
                                  F.col("contributing_findings").alias("contributing_findings_count"),
                                  "normalized_score", "overall_confidence", "raw_score", "risk_band")).alias("explanation_json"))


def highest_component(risk: DataFrame) -> DataFrame:
    """First maximum in declared order."""
    ranked = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("back"), F.lit(c).alias("name"))
                                   for i, c in enumerate(COMPONENTS)]))
    return risk.withColumn("highest_risk_component", ranked["name"])
