"""Peer groups, their baselines, and the peer-relative rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lacuna.functions import scalar as S
from lacuna.operators.evaluations import evaluate, text, verdict
from lacuna.operators.order_statistics import with_percentiles
from lacuna.params import RULES, RuleParams
from lacuna.plans.lens import Estate


def escalation_rates(est: Estate) -> DataFrame:
    """Investigations, escalations and their ratio per entity."""
    inv = est.investigations.select(F.col("id").alias("investigation_id"), "alert_id")
    esc = est.escalations.select("investigation_id", F.lit(1).alias("escalated"))
    owned = est.alerts.select(F.col("id").alias("alert_id"), "cse_id")
    per = (inv.join(owned, "alert_id").join(esc, "investigation_id", "left")
           .groupBy("cse_id").agg(F.count(F.lit(1)).alias("investigation_count"),
                                  F.sum(F.coalesce("escalated", F.lit(0))).alias("escalation_count")))
    return (est.entities.select(F.col("id").alias("cse_id"), F.col("name").alias("cse_name"), "sector", "size_tier")
            .join(per, "cse_id", "left")
            .withColumn("escalation_rate", F.col("escalation_count") / F.col("investigation_count")))


def baseline(values: DataFrame, group: list[str], metric: str, value: str) -> DataFrame:
    """Quartiles, deviation and size of one metric per peer group."""
    v = F.col(value)
    known = values.where(v.isNotNull())
    grouped = known.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.stddev_pop(v).alias("std_dev"))
    return with_percentiles(grouped, known, group, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumn("metric", F.lit(metric))


def peer01_evaluations(est: Estate, group: list[str], params: RuleParams = RULES) -> DataFrame:
    """Entities that escalate far less often than their peer group."""
    rates = escalation_rates(est)
    base = baseline(rates, group, "escalation_rate", "escalation_rate").select(*group, "members", "p25", "std_dev")
    rows = rates.join(base, group, "left")
    floor = F.col("p25") - params.escalation_rate_sigmas * F.col("std_dev")
    status = (F.when(F.col("escalation_rate").isNull(), "INSUFFICIENT_DATA")
              .when(F.col("escalation_rate") < floor, "FAIL").otherwise("PASS"))
    rule = verdict("PEER-01", "CSE", F.col("cse_id"), status, severity="HIGH",
                   confidence=round(0.95 * S.confidence_modifier_value(est.completeness), 2), risk=20.0,
                   expected="Escalation rate near the peer baseline.",
                   observed=text("Escalation rate ", S.rounded(F.col("escalation_rate"), 4), "."),
                   reason="Escalation rate far below peers.", recommendation="Review the escalation policy.")
    return evaluate(rows, [rule])
