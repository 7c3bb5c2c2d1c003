"""Shape shared by all rules: one verdict struct per rule and subject, then findings.

A rule is a function returning a struct column. Rules that look at the same rows are put in
one array and exploded, so each input is scanned once however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions import scalar as S
from lacuna.params import FINDING_STATES

VERDICT_FIELDS = ["rule_id", "target_type", "target_id", "qualifier", "status", "severity", "confidence",
                  "risk_contribution", "expected_behaviour", "observed_behaviour", "reason", "recommendation"]


def text(*parts) -> Column:
    """Concatenate literals and columns; a null column is written as empty text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def verdict(rule_id: str, target_type: str, target_id: Column, status: Column, *, severity: str, confidence: float,
            risk: float, expected: Column | str, observed: Column | str, reason: Column | str, recommendation: str,
            qualifier: Column | str = "", calm_severity: str | None = None) -> Column:
    """Struct with the outcome of one rule. Severity, confidence and risk follow the status."""
    hit = status.isin(FINDING_STATES)
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    unknown = status == "UNKNOWN"
    suppressed = status == "SUPPRESSED"
    sev = F.when(suppressed, "LOW").otherwise(severity) if calm_severity is None else (
        F.when(suppressed | (status == calm_severity), "LOW").otherwise(severity))
    conf = (F.when(hit, F.lit(confidence)).when(unknown, F.lit(0.40)).when(status == "INSUFFICIENT_DATA", F.lit(0.50))
            .when(suppressed, F.lit(0.95)).otherwise(F.lit(1.0)))
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(target_type).alias("target_type"),
        target_id.cast("string").alias("target_id"), as_col(qualifier).alias("qualifier"),
        status.alias("status"), sev.alias("severity"), conf.alias("confidence"),
        F.when(hit, F.lit(risk)).otherwise(F.lit(0.0)).alias("risk_contribution"),
        as_col(expected).alias("expected_behaviour"),
        F.when(hit, as_col(observed)).otherwise(F.concat(F.lit("Outcome "), status)).alias("observed_behaviour"),
        F.when(hit, as_col(reason)).otherwise(F.concat(F.lit("Rule outcome "), status)).alias("reason"),
        F.when(hit, F.lit(recommendation)).otherwise(F.lit("")).alias("recommendation"))


def evaluate(rows: DataFrame, verdicts: list[Column]) -> DataFrame:
    """All verdicts for all rows; the row's own columns stay available as context."""
    return (rows.withColumn("verdict", F.explode(F.array(*verdicts)))
            .select(*[F.col(f"verdict.{f}").alias(f) for f in VERDICT_FIELDS],
                    *[c for c in rows.columns if c not in VERDICT_FIELDS]))


def to_findings(evaluations: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Keep failed or confirmed evaluations and give them identity, priority and status."""
    hits = evaluations.where(F.col("status").isin(FINDING_STATES))
    return hits.withColumns({
        "rule_status": F.col("status"), "status": F.lit("NEW"), "analysis_run_id": F.lit(run_id), "rule_version": F.lit("1.0.0"),
        "finding_id": S.key_hash(run_id, F.col("rule_id"), F.col("target_type"), F.col("target_id"), F.col("qualifier")),
        "anomaly_score": F.lit(0.0), "risk_score": F.col("risk_contribution"), "found_at": F.to_timestamp(F.lit(as_of)),
        "supervisory_priority": S.rounded(F.col("risk_contribution") * F.col("confidence"), 2)})
