"""Workflow reconstruction: one row per alert with everything that followed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.params import EXPECTED_WORKFLOW, RULES, RuleParams
from lacuna.plans.lens import Estate

_MINUTE = 60
_DAY = 86400


def first_case_per_tick(probes: DataFrame, cases: DataFrame, window_seconds: int) -> DataFrame:
    """For every (cse_id, created_at) the first case opened within +/- ``window_seconds``.

    ``probes`` holds distinct (cse_id, created_at); ``cases`` holds (cse_id, opened_at, id).
    "First" is the smallest (opened_at, id). That is a successor search from the lower
    edge of the interval, done on three grains so that no window group grows with
    the size of an entity: ticks inside one minute, minutes inside one day, whole days.
    """
    opened = cases.groupBy("cse_id", "opened_at").agg(F.min("id").alias("case_id"))
    opened = opened.select("cse_id", F.unix_micros("opened_at").alias("t"), "case_id")
    low = probes.select("cse_id", "created_at",
                        (F.unix_micros("created_at") - F.lit(window_seconds * 1_000_000)).alias("t"))
    minute = F.floor(F.col("t") / F.lit(_MINUTE * 1_000_000))
    hit = F.struct("t", "case_id")

    marks = (low.select("cse_id", "created_at", "t", F.lit(None).cast("string").alias("case_id"), F.lit(0).alias("kind"))
             .unionByName(opened.select("cse_id", F.lit(None).cast("timestamp").alias("created_at"), "t",
                                        "case_id", F.lit(1).alias("kind")))
             .withColumn("m", minute).withColumn("d", F.floor(F.col("m") / 1440)))
    # Descending order with a running frame: the last case seen is the next one in time.
    # At equal ticks the probe comes first, so a case exactly on the edge is not taken.
    nearest = Window.partitionBy("cse_id", "m").orderBy(F.desc("t"), F.asc("kind"))
    in_minute = (marks.withColumn("same_minute", F.last(F.when(F.col("kind") == 1, hit), ignorenulls=True).over(nearest))
                 .where("kind = 0").select("cse_id", "created_at", "m", "d", "same_minute"))

    by_minute = (opened.withColumn("m", minute).groupBy("cse_id", "m").agg(F.min(hit).alias("first_hit"))
                 .withColumn("d", F.floor(F.col("m") / 1440)))
    grid = (in_minute.select("cse_id", "d", "m").distinct().withColumn("first_hit", F.lit(None).cast(by_minute.schema["first_hit"].dataType))
            .withColumn("kind", F.lit(0))
            .unionByName(by_minute.select("cse_id", "d", "m", "first_hit", F.lit(1).alias("kind"))))
    later = Window.partitionBy("cse_id", "d").orderBy(F.desc("m"), F.asc("kind"))
    in_day = (grid.withColumn("same_day", F.last("first_hit", ignorenulls=True).over(later))
              .where("kind = 0").select("cse_id", "m", "same_day"))

    out = in_minute.join(in_day, ["cse_id", "m"], "left")
    by_day = by_minute.groupBy("cse_id", "d").agg(F.min("first_hit").alias("first_hit"))
    found = [F.col("same_minute"), F.col("same_day")]
    for ahead in range(1, -(-2 * window_seconds // _DAY) + 1):
        step = by_day.select("cse_id", (F.col("d") - ahead).alias("d"), F.col("first_hit").alias(f"ahead_{ahead}"))
        out = out.join(step, ["cse_id", "d"], "left")
        found.append(F.col(f"ahead_{ahead}"))
    best = F.coalesce(*found)
    inside = best["t"] < F.unix_micros("created_at") + F.lit(window_seconds * 1_000_000)
    return (out.select("cse_id", "created_at", F.when(inside, best).alias("best"))
            .where("best is not null")
            .select("cse_id", "created_at", F.col("best.case_id").alias("case_id"),
                    F.timestamp_micros(F.col("best.t")).alias("case_opened_at")))


def nearest_case(est: Estate, params: RuleParams = RULES) -> DataFrame:
    """alert_id with the first case of the same entity inside the interval (nulls when none)."""
    ticks = est.alerts.select("cse_id", "created_at").distinct()
    cases = first_case_per_tick(ticks, est.cases, params.case_window_seconds)
    return (est.alerts.select(F.col("id").alias("alert_id"), "cse_id", "created_at")
            .join(cases, ["cse_id", "created_at"], "left"))


def workflow(est: Estate, params: RuleParams = RULES, keep: Column | None = None, may: tuple[Column, Column] | None = None) -> DataFrame:
    """Alerts joined to asset, investigation, escalation, case and closure.

    ``keep`` is a condition on all but case and closure; rows that fail it are dropped before these are joined. ``may`` are two conditions
    that are never null, on an alert alone and on an investigation alone, of which every row that ``keep`` keeps meets one: of the alerts that
    fail the first only investigations that meet the second are looked for, before anything else is joined.
    Without ``may``, investigations meet their escalations first, while both are narrow."""
    alerts = est.alerts.select(
        F.col("id").alias("alert_id"), "cse_id", "asset_id", "source_system", F.col("category").alias("alert_category"),
        F.col("severity").alias("alert_severity"), F.col("status").alias("alert_status"), "created_at")
    assets = est.assets.select(
        F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), "asset_type",
        F.col("criticality").alias("asset_criticality"), F.col("status").alias("asset_status"), "decommissioned_at")
    inv = est.investigations.select(
        "alert_id", F.col("id").alias("investigation_id"), "analyst_id", "started_at", "duration_seconds", "outcome")
    esc = est.escalations.select("investigation_id", F.col("id").alias("escalation_id"), "escalated_to")
    clo = est.closures.select("case_id", F.col("id").alias("closure_id"), "disposition_type", "justification")
    cases = first_case_per_tick(est.alerts.select("cse_id", "created_at").distinct(), est.cases,
                                params.case_window_seconds)
    has = lambda *names: [F.col(f"{n}_id").isNotNull().alias(f"has_{n}") for n in names]
    if may is None:
        joined = alerts.join(inv.join(esc, "investigation_id", "left"), "alert_id", "left")
    else:
        may_alert, may_inv = may
        found = alerts.join(inv.withColumn("may_inv", may_inv), "alert_id", "left")
        joined = found.where(may_alert | F.col("may_inv")).drop("may_inv").join(esc, "investigation_id", "left")
    joined = joined.join(assets, "asset_id", "left").select("*", *has("investigation", "escalation"))
    if keep is not None:
        joined = joined.where(keep)
    joined = joined.join(cases.join(clo, "case_id", "left"), ["cse_id", "created_at"], "left").select("*", *has("case", "closure"))
    return joined.withColumn("evidence_refs", evidence_refs()).withColumn("observed_sequence", observed_sequence())


def _ref(table: str, id_col: str, text):
    return F.when(F.col(id_col).isNotNull(), F.struct(
        F.lit(table).alias("source_table"), F.col(id_col).alias("source_record_id"), text.alias("description")))


def evidence_refs():
    """References to every record found for an alert, absent ones left out."""
    refs = F.array(
        _ref("alerts", "alert_id", F.concat(F.lit("Alert "), F.col("alert_category"), F.lit(" ("), F.col("alert_severity"), F.lit(")"))),
        F.when(F.col("asset_name").isNotNull(), _ref("assets", "asset_id", F.concat(
            F.lit("Asset "), F.col("asset_name"), F.lit(" ("), F.col("asset_criticality"), F.lit(")")))),
        _ref("investigations", "investigation_id", F.concat(
            F.lit("Investigation of "), F.coalesce(F.col("duration_seconds").cast("string"), F.lit("?")), F.lit(" s"))),
        _ref("escalations", "escalation_id", F.concat(F.lit("Escalation to "), F.col("escalated_to"))),
        _ref("cases", "case_id", F.concat(F.lit("Case "), F.col("case_id"))),
        _ref("closures", "closure_id", F.concat(F.lit("Closure as "), F.col("disposition_type"))))
    return F.filter(refs, lambda x: x.isNotNull())


def observed_sequence():
    steps = F.array(F.lit(EXPECTED_WORKFLOW[0]), *[
        F.when(F.col(f"has_{step.lower()}"), F.lit(step)) for step in EXPECTED_WORKFLOW[1:]])
    return F.filter(steps, lambda x: x.isNotNull())


def missing_transitions():
    """Expected hand-overs that did not happen, as an array of from/to/reason."""
    gaps = F.array(
        F.when(~F.col("has_investigation"), F.struct(
            F.lit("Alert").alias("from"), F.lit("Investigation").alias("to"), F.lit("Alert uninvestigated").alias("reason"))),
        F.when(~F.col("has_escalation") & F.col("has_case"), F.struct(
            F.lit("Investigation").alias("from"), F.lit("Escalation").alias("to"), F.lit("Unescalated case closure").alias("reason"))))
    return F.filter(gaps, lambda x: x.isNotNull())


def sequences(flow: DataFrame) -> DataFrame:
    """Expected and observed sequence with the missing transitions, per alert."""
    return flow.select("alert_id", F.array(*[F.lit(s) for s in EXPECTED_WORKFLOW]).alias("expected_sequence"),
                       "observed_sequence", missing_transitions().alias("missing_transitions"))
