"""Execution-gap rules over reconstructed workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna import params as P
from lacuna.functions import scalar as S
from lacuna.operators.evaluations import evaluate, text, verdict
from lacuna.params import RULES, RuleParams

_DAY_MICROS = 86_400_000_000


def _c(name: str) -> Column:
    return F.col(name)


def _fail_else_pass(applicable: Column, failed: Column) -> Column:
    return (F.when(~F.coalesce(applicable, F.lit(False)), "NOT_APPLICABLE")
            .when(F.coalesce(failed, F.lit(False)), "FAIL").otherwise("PASS"))


def gap01(completeness: float, params: RuleParams = RULES) -> Column:
    """A critical alert handled without the mandatory escalation."""
    closed = F.coalesce(_c("outcome") == "CLOSED", F.lit(False))
    applicable = (_c("alert_severity") == "CRITICAL") & (
        F.coalesce(_c("asset_criticality") == "CRITICAL", F.lit(False)) | closed)
    retired = F.coalesce((_c("asset_status") == "DECOMMISSIONED") | _c("decommissioned_at").isNotNull(), F.lit(False))
    mandatory = _c("alert_category").isin(P.MANDATORY_ESCALATION_CATEGORIES)
    status = (F.when(~applicable, "NOT_APPLICABLE")
              .when(F.lit(completeness < params.min_completeness), "UNKNOWN")
              .when(retired, "PASS")
              .when((mandatory | closed) & ~_c("has_escalation"), "FAIL").otherwise("PASS"))
    modifier = S.confidence_modifier_value(completeness)
    return verdict("GAP-01", "Alert", _c("alert_id"), status, severity="CRITICAL",
                   confidence=round(0.95 * modifier, 2), risk=30.0,
                   expected="Critical alerts reach a second-line lead before they are closed.",
                   observed=text("Critical alert ", _c("alert_category"), " ended with no escalation record."),
                   reason="Critical alert closed without supervisory escalation.",
                   recommendation="Reopen the alert for second-line review and audit the closure.")


def gap03(completeness: float, params: RuleParams = RULES) -> Column:
    """An investigation finished implausibly fast."""
    applicable = _c("has_investigation") & _c("duration_seconds").isNotNull()
    status = _fail_else_pass(applicable, _c("duration_seconds") < params.hasty_seconds)
    modifier = S.confidence_modifier_value(completeness)
    return verdict("GAP-03", "Alert", _c("alert_id"), status, severity="MEDIUM",
                   confidence=round(0.90 * modifier, 2), risk=15.0,
                   expected=f"Investigations last about as long as at peers (median {params.peer_median_seconds} s).",
                   observed=text("Investigation finished in ", _c("duration_seconds"), " seconds."),
                   reason="Investigation duration far below the operational baseline.",
                   recommendation="Check analyst notes for templated closing.")


def gap02(completeness: float) -> Column:
    """A high or critical alert nobody investigated."""
    status = _fail_else_pass(_c("alert_severity").isin("CRITICAL", "HIGH"), ~_c("has_investigation"))
    return verdict("GAP-02", "Alert", _c("alert_id"), status, severity="HIGH",
                   confidence=round(0.95 * S.confidence_modifier_value(completeness), 2), risk=25.0,
                   expected="High and critical alerts are investigated.",
                   observed=text(_c("alert_severity"), " alert has no investigation record."),
                   reason="High-severity alert without investigation.",
                   recommendation="Assign the alert and record the investigation.")


def gap04(completeness: float, params: RuleParams = RULES) -> Column:
    """Too many alerts of one category on one asset within the window."""
    status = _fail_else_pass(F.lit(True), _c("recent_repeats") > params.repeat_limit)
    return verdict("GAP-04", "Alert", _c("alert_id"), status, severity="HIGH",
                   confidence=round(0.95 * S.confidence_modifier_value(completeness), 2), risk=20.0,
                   expected="Repeated alerts on one asset lead to remediation.",
                   observed=text(_c("recent_repeats"), " alerts of category ", _c("alert_category"), " within the window."),
                   reason="Recurring alerts on the same asset without remediation.",
                   recommendation="Open a remediation task for the asset.")


def gap05(completeness: float) -> Column:
    """A critical alert closed as false positive with no justification."""
    failed = (_c("disposition_type") == "FALSE_POSITIVE") & _c("justification").isNull()
    status = _fail_else_pass((_c("alert_severity") == "CRITICAL") & _c("has_closure"), failed)
    return verdict("GAP-05", "Alert", _c("alert_id"), status, severity="HIGH",
                   confidence=round(0.95 * S.confidence_modifier_value(completeness), 2), risk=20.0,
                   expected="False-positive closures of critical alerts are justified.",
                   observed="Closed as false positive without justification.",
                   reason="Closure disposition inconsistent with severity.",
                   recommendation="Obtain a written justification for the closure.")


def gap06(completeness: float) -> Column:
    """A closed case about ransomware or exfiltration that was never escalated."""
    applicable = (_c("case_status") == "CLOSED") & _c("alert_category").isin(P.RANSOM_CATEGORIES)
    status = _fail_else_pass(applicable, ~_c("has_escalation"))
    return verdict("GAP-06", "Alert", _c("alert_id"), status, severity="CRITICAL",
                   confidence=round(0.95 * S.confidence_modifier_value(completeness), 2), risk=30.0,
                   expected="High-impact cases are escalated before they are closed.",
                   observed=text("Case ", _c("case_id"), " closed with no escalation."),
                   reason="High-impact case closed without escalation.",
                   recommendation="Reopen the case and escalate it.")


def gap_hit(completeness: float, params: RuleParams = RULES) -> Column:
    """Whether a rule of the standard run makes a finding of a workflow; needs no case or closure."""
    return gap01(completeness, params)["status"].isin(P.FINDING_STATES) | gap03(completeness, params)["status"].isin(P.FINDING_STATES)


def gap_may(params: RuleParams = RULES) -> tuple[Column, Column]:
    """What :func:`gap_hit` asks of an alert alone (GAP-01) or of an investigation alone (GAP-03): a workflow with neither is no hit."""
    return F.coalesce(_c("alert_severity") == "CRITICAL", F.lit(False)), F.coalesce(_c("duration_seconds") < params.hasty_seconds, F.lit(False))


def gap_evaluations(flow: DataFrame, completeness: float, params: RuleParams = RULES) -> DataFrame:
    """The two rules of the standard run; both verdicts come from one pass over the workflows."""
    return evaluate(flow, [gap01(completeness, params), gap03(completeness, params)])


def declared_gap_evaluations(flow: DataFrame, repeats: DataFrame, cases: DataFrame, completeness: float,
                             params: RuleParams = RULES) -> DataFrame:
    """The further registered rules. ``repeats`` is (asset_id, category, created_at, recent_repeats)."""
    status = cases.select(F.col("id").alias("case_id"), F.col("status").alias("case_status"))
    counted = repeats.withColumnRenamed("category", "alert_category")
    rows = (flow.join(status, "case_id", "left")
            .join(counted, ["asset_id", "alert_category", "created_at"], "left"))
    return evaluate(rows, [gap02(completeness), gap04(completeness, params), gap05(completeness), gap06(completeness)])


def repeat_counts(alerts: DataFrame, window_seconds: int) -> DataFrame:
    """Alerts of the same asset and category in the trailing window, per distinct alert time.

    Every distinct time is an arrival and, one window later, a departure; the count is the sum of all moves so far.
    Sums run in two grains, so one busy asset is spread over its days: whole days are summed up once, and inside a
    day the moves so far are added. The work of a row does not depend on the length of the window.
    """
    key = ["asset_id", "category"]
    span = window_seconds * 1_000_000
    ticks = alerts.groupBy(*key, "created_at").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.unix_micros("created_at"))
    # A tick exactly one window old still counts, hence arrivals sort before departures.
    arrive = ticks.select(*key, "created_at", "t", "n", F.lit(1).alias("kind"))
    leave = ticks.select(*key, F.lit(None).cast("timestamp").alias("created_at"), (F.col("t") + span).alias("t"), (-F.col("n")).alias("n"), F.lit(2).alias("kind"))
    moves = arrive.unionByName(leave).withColumn("day", F.floor(F.col("t") / F.lit(_DAY_MICROS)))
    days = moves.groupBy(*key, "day").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = days.select(*key, "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    running = Window.partitionBy(*key, "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = moves.withColumn("change", F.sum("n").over(running)).where("kind = 1")
    return inside.join(base, [*key, "day"]).select(*key, "created_at", (F.col("base") + F.col("change")).cast("long").alias("recent_repeats"))
