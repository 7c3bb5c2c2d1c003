"""Workflow, rule and evidence queries."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.operators import evidence as E
from lacuna.operators import findings as FD
from lacuna.operators import gap_rules as G
from lacuna.operators import negative_space as N
from lacuna.operators import peers as PE
from lacuna.operators import workflow as W
from lacuna.params import RULES
from lacuna.plans.ctes import AS_OF_SQL, IMPORT_SQL, RUN_SQL, cte, key, one, r
from lacuna.plans.lens import asset_entities, estate
from lacuna.plans.registry import query
from lacuna.plans.stages import analysis

VERDICTS = ["target_id", "status", "severity", "confidence", "risk_contribution"]

# --- workflow ------------------------------------------------------------------------
cte("near", "alerts cases", """SELECT a.id AS alert_id, arg_min(c.id, struct_pack(o := c.opened_at, i := c.id)) AS case_id, min(c.opened_at) AS case_opened_at
 FROM alerts a JOIN cases c ON c.cse_id = a.cse_id AND c.opened_at > a.created_at - INTERVAL 1 DAY AND c.opened_at < a.created_at + INTERVAL 1 DAY GROUP BY a.id""")
cte("flow", "alerts assets investigations escalations near closures", """SELECT a.id AS alert_id, a.cse_id, a.asset_id, a.source_system, a.category AS alert_category, a.severity AS alert_severity,
 a.status AS alert_status, a.created_at, s.name AS asset_name, s.asset_type, s.criticality AS asset_criticality, s.status AS asset_status,
 i.id AS investigation_id, i.analyst_id, i.started_at, i.duration_seconds, i.outcome, e.id AS escalation_id, e.escalated_to,
 n.case_id, c.id AS closure_id, c.disposition_type, c.justification
 FROM alerts a LEFT JOIN assets s ON s.id = a.asset_id LEFT JOIN investigations i ON i.alert_id = a.id
 LEFT JOIN escalations e ON e.investigation_id = i.id LEFT JOIN near n ON n.alert_id = a.id LEFT JOIN closures c ON c.case_id = n.case_id""")


@query("alert_chain", "flow", """SELECT alert_id, cse_id, asset_name, asset_criticality, investigation_id, analyst_id, escalation_id FROM flow""")
def alert_chain(spark, d):
    return W.workflow(estate(spark, d)).select("alert_id", "cse_id", "asset_name", "asset_criticality",
                                               "investigation_id", "analyst_id", "escalation_id")


@query("nearest_case", "alerts near", """SELECT a.id AS alert_id, case_id, strftime(case_opened_at, '%Y-%m-%dT%H:%M:%S') AS opened_at
 FROM alerts a LEFT JOIN near n ON n.alert_id = a.id""")
def nearest_case(spark, d):
    return W.nearest_case(estate(spark, d)).select("alert_id", "case_id", S.iso(F.col("case_opened_at")).alias("opened_at"))


@query("workflow", "flow", """SELECT alert_id, investigation_id IS NOT NULL AS has_investigation, escalation_id IS NOT NULL AS has_escalation,
 case_id IS NOT NULL AS has_case, closure_id IS NOT NULL AS has_closure, case_id, disposition_type,
 concat_ws(';', 'alerts=' || alert_id, 'assets=' || asset_id, 'investigations=' || investigation_id, 'escalations=' || escalation_id,
  'cases=' || case_id, 'closures=' || closure_id) AS refs FROM flow""")
def workflow(spark, d):
    refs = F.array_join(F.transform("evidence_refs", lambda x: F.concat(x["source_table"], F.lit("="), x["source_record_id"])), ";")
    return W.workflow(estate(spark, d)).select("alert_id", "has_investigation", "has_escalation", "has_case", "has_closure",
                                               "case_id", "disposition_type", refs.alias("refs"))


@query("workflow_sequences", "flow", """SELECT alert_id, 'Alert>Investigation>Escalation>Case>Closure' AS expected,
 concat_ws('>', 'Alert', CASE WHEN investigation_id IS NOT NULL THEN 'Investigation' END, CASE WHEN escalation_id IS NOT NULL THEN 'Escalation' END,
 CASE WHEN case_id IS NOT NULL THEN 'Case' END, CASE WHEN closure_id IS NOT NULL THEN 'Closure' END) AS observed,
 concat_ws(';', CASE WHEN investigation_id IS NULL THEN 'Alert>Investigation' END,
 CASE WHEN escalation_id IS NULL AND case_id IS NOT NULL THEN 'Investigation>Escalation' END) AS missing FROM flow""")
def workflow_sequences(spark, d):
    q = W.sequences(W.workflow(estate(spark, d)))
    return q.select("alert_id", F.array_join("expected_sequence", ">").alias("expected"),
                    F.array_join("observed_sequence", ">").alias("observed"),
                    F.array_join(F.transform("missing_transitions", lambda m: F.concat(m["from"], F.lit(">"), m["to"])), ";").alias("missing"))


# --- gap rules -----------------------------------------------------------------------
def _verdict_sql(status: str, severity: str, conf: float, risk: float, target: str, src: str, extra: str = "", suppressed_low: bool = True) -> str:
    return f"""SELECT target_id, status, CASE WHEN status = 'SUPPRESSED' THEN 'LOW' ELSE '{severity}' END AS severity,
 CASE WHEN status IN ('FAIL','CONFIRMED') THEN {conf}::double WHEN status = 'UNKNOWN' THEN 0.4::double WHEN status = 'INSUFFICIENT_DATA' THEN 0.5::double
 WHEN status = 'SUPPRESSED' THEN 0.95::double ELSE 1.0::double END AS confidence,
 CASE WHEN status IN ('FAIL','CONFIRMED') THEN {risk}::double ELSE 0.0::double END AS risk_contribution{extra}
 FROM (SELECT *, {target} AS target_id, {status} AS status FROM {src})"""


GAP01 = """CASE WHEN NOT (alert_severity = 'CRITICAL' AND (coalesce(asset_criticality = 'CRITICAL', false) OR coalesce(outcome = 'CLOSED', false))) THEN 'NOT_APPLICABLE'
 WHEN coalesce(asset_status = 'DECOMMISSIONED', false) THEN 'PASS'
 WHEN (alert_category IN ('EXFILTRATION_SUSPICION','RANSOMWARE','DATA_EXFIL') OR coalesce(outcome = 'CLOSED', false)) AND escalation_id IS NULL THEN 'FAIL' ELSE 'PASS' END"""
GAP03 = "CASE WHEN investigation_id IS NULL OR duration_seconds IS NULL THEN 'NOT_APPLICABLE' WHEN duration_seconds < 15 THEN 'FAIL' ELSE 'PASS' END"
GAP02 = "CASE WHEN alert_severity NOT IN ('CRITICAL','HIGH') THEN 'NOT_APPLICABLE' WHEN investigation_id IS NULL THEN 'FAIL' ELSE 'PASS' END"
GAP05 = """CASE WHEN NOT (alert_severity = 'CRITICAL' AND closure_id IS NOT NULL) THEN 'NOT_APPLICABLE'
 WHEN disposition_type = 'FALSE_POSITIVE' AND justification IS NULL THEN 'FAIL' ELSE 'PASS' END"""
GAP06 = """CASE WHEN NOT coalesce(case_status = 'CLOSED' AND alert_category IN ('RANSOMWARE','DATA_EXFIL'), false) THEN 'NOT_APPLICABLE'
 WHEN escalation_id IS NULL THEN 'FAIL' ELSE 'PASS' END"""
GAP04 = "CASE WHEN recent_repeats > 5 THEN 'FAIL' ELSE 'PASS' END"
cte("flow_cases", "flow cases", "SELECT f.*, c.status AS case_status FROM flow f LEFT JOIN cases c ON c.id = f.case_id")
cte("repeats", "alerts", """SELECT id, count(*) OVER (PARTITION BY asset_id, category ORDER BY created_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS recent_repeats FROM alerts""")
cte("flow_repeats", "flow repeats", "SELECT f.*, recent_repeats FROM flow f JOIN repeats ON repeats.id = f.alert_id")


def _gap(spark, d, rule):
    est = estate(spark, d)
    rows = G.gap_evaluations(W.workflow(est), est.completeness)
    return rows.where(F.col("rule_id") == rule).select(*VERDICTS)


def _declared(spark, d, rule):
    est = estate(spark, d)
    repeats = G.repeat_counts(est.alerts, RULES.repeat_window_seconds)
    rows = G.declared_gap_evaluations(W.workflow(est), repeats, est.cases, est.completeness)
    return rows.where(F.col("rule_id") == rule).select(*VERDICTS)


for _rule, _sql, _sev, _conf, _risk, _src, _run in [
        ("GAP-01", GAP01, "CRITICAL", 0.95, 30.0, "flow", _gap), ("GAP-03", GAP03, "MEDIUM", 0.9, 15.0, "flow", _gap),
        ("GAP-02", GAP02, "HIGH", 0.95, 25.0, "flow", _declared), ("GAP-04", GAP04, "HIGH", 0.95, 20.0, "flow_repeats", _declared),
        ("GAP-05", GAP05, "HIGH", 0.95, 20.0, "flow", _declared), ("GAP-06", GAP06, "CRITICAL", 0.95, 30.0, "flow_cases", _declared)]:
    query(_rule.lower().replace("-", ""), _src, _verdict_sql(_sql, _sev, _conf, _risk, "alert_id", _src))(
        lambda spark, d, rule=_rule, run=_run: run(spark, d, rule))


@query("recurrent_alerts", "alerts repeats", "SELECT a.id AS alert_id, recent_repeats FROM alerts a JOIN repeats r ON r.id = a.id")
def recurrent_alerts(spark, d):
    est = estate(spark, d)
    counts = G.repeat_counts(est.alerts, RULES.repeat_window_seconds)
    return est.alerts.join(counts, ["asset_id", "category", "created_at"]).select(F.col("id").alias("alert_id"), "recent_repeats")


@query("recurrent_telemetry", "telemetry", """SELECT id AS event_id, count(*) OVER (PARTITION BY asset_id, category ORDER BY created_at
 RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS recent_repeats FROM telemetry""")
def recurrent_telemetry(spark, d):
    tele = estate(spark, d).telemetry
    counts = G.repeat_counts(tele, RULES.repeat_window_seconds)
    return tele.join(counts, ["asset_id", "category", "created_at"]).select(F.col("id").alias("event_id"), "recent_repeats")


# --- negative space --------------------------------------------------------------------
cte("seen", "telemetry", "SELECT asset_id, count(*) AS telemetry_count, max(created_at) AS last_seen FROM telemetry GROUP BY asset_id")
cte("density", "assets alerts", """SELECT s.id AS asset_id, asset_type, criticality, status, coalesce(n, 0) AS density FROM assets s
 LEFT JOIN (SELECT asset_id, count(*) AS n FROM alerts GROUP BY asset_id) c ON c.asset_id = s.id""")
cte("peer_med", "density", """SELECT a.asset_id, count(*) AS peer_count, median(b.density) AS peer_median FROM density a JOIN density b
 ON a.asset_type = b.asset_type AND a.criticality = b.criticality AND b.status = 'ACTIVE' AND a.asset_id <> b.asset_id WHERE a.status = 'ACTIVE' GROUP BY a.asset_id""")
cte("asset_maint", "maintenance", "SELECT asset_id, count(*) AS maintenance_count FROM maintenance GROUP BY asset_id")
cte("asset_base", "assets seen density peer_med asset_maint", f"""SELECT s.id AS asset_id, s.cse_id, s.name AS asset_name, s.asset_type, s.criticality AS asset_criticality, s.status AS asset_status,
 coalesce(maintenance_count, 0) AS maintenance_count, epoch_us({AS_OF_SQL} - last_seen) / 1e6 / 3600.0 AS silence_hours, d.density, peer_count, peer_median,
 CASE WHEN peer_median > 0 THEN d.density / peer_median WHEN peer_median IS NOT NULL THEN 1.0 END AS density_ratio
 FROM assets s LEFT JOIN seen ON seen.asset_id = s.id LEFT JOIN density d ON d.asset_id = s.id LEFT JOIN peer_med p ON p.asset_id = s.id LEFT JOIN asset_maint m ON m.asset_id = s.id""")
NEG01 = """CASE WHEN asset_criticality <> 'CRITICAL' THEN 'NOT_APPLICABLE' WHEN asset_status = 'DECOMMISSIONED' OR maintenance_count > 0 THEN 'SUPPRESSED'
 WHEN coalesce(silence_hours, 49.0) >= 48.0 THEN 'CONFIRMED' ELSE 'PASS' END"""
NEG04 = """CASE WHEN NOT (asset_criticality IN ('CRITICAL','HIGH') AND asset_status = 'ACTIVE') THEN 'NOT_APPLICABLE' WHEN peer_median IS NULL THEN 'INSUFFICIENT_DATA'
 WHEN density_ratio < 0.2 THEN 'CONFIRMED' ELSE 'PASS' END"""
NEG05 = """CASE WHEN asset_status = 'DECOMMISSIONED' THEN 'SUPPRESSED' WHEN coalesce(silence_hours, 25.0) < 24.0 THEN 'PASS' WHEN maintenance_count > 0 THEN 'SUPPRESSED' ELSE 'CONFIRMED' END"""
for _rule, _sql, _sev, _conf, _risk in [("NEG-01", NEG01, "HIGH", 0.95, 25.0), ("NEG-04", NEG04, "MEDIUM", 0.85, 15.0), ("NEG-05", NEG05, "HIGH", 0.9, 25.0)]:
    query(_rule.lower().replace("-", ""), "asset_base", _verdict_sql(_sql, _sev, _conf, _risk, "asset_id", "asset_base"))(
        lambda spark, d, rule=_rule: N.asset_evaluations(estate(spark, d)).where(F.col("rule_id") == rule).select(*VERDICTS))


def _volume_cte(name: str, key_col: str) -> None:
    cte(name, "telemetry", f"""SELECT {key_col} AS cse_id, count(*) AS total_count, count(*) FILTER (created_at >= {AS_OF_SQL} - INTERVAL 1 DAY) AS recent_count,
 list_aggregate(bins, 'avg') AS mean_daily, list_aggregate(bins, 'stddev_pop') AS std_daily FROM (
 SELECT *, [ (SELECT 0) ] AS x FROM telemetry) t LEFT JOIN (SELECT k, list(coalesce(n, 0)::double ORDER BY b) AS bins FROM
 (SELECT DISTINCT {key_col} AS k FROM telemetry) CROSS JOIN (SELECT unnest(range(30)) AS b) LEFT JOIN
 (SELECT {key_col} AS k2, floor(epoch_us(created_at - ({AS_OF_SQL} - INTERVAL 30 DAY)) / 86400e6) AS b2, count(*) AS n FROM telemetry
  WHERE created_at >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY 1, 2) ON k2 = k AND b2 = b GROUP BY k) ON k = {key_col} GROUP BY {key_col}, bins""")


_volume_cte("volume", "cse_id")
_volume_cte("asset_volume", "asset_id")


def _stats_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN mean_daily > 0 THEN {r('(mean_daily - recent_count) / mean_daily * 100.0', 2)} ELSE 0.0::double END AS drop_pct,
 CASE WHEN mean_daily > 0 THEN {r('(mean_daily - recent_count) / (CASE WHEN std_daily < 1e-6 THEN 0.1 * mean_daily ELSE std_daily END)', 2)} ELSE 0.0::double END AS z_score FROM {src}"""


cte("volume_stats", "volume", _stats_sql("volume"))
cte("asset_volume_stats", "asset_volume", _stats_sql("asset_volume"))
cte("cse_maint", "maintenance", "SELECT cse_id, count(*) AS maintenance_count FROM maintenance GROUP BY cse_id")
cte("entity_base", "entities volume_stats cse_maint", """SELECT e.id AS cse_id, e.name AS cse_name, sector, size_tier, total_count, recent_count, mean_daily, std_daily, drop_pct, z_score,
 coalesce(maintenance_count, 0) AS maintenance_count FROM entities e LEFT JOIN volume_stats v ON v.cse_id = e.id LEFT JOIN cse_maint m ON m.cse_id = e.id""")
cte("asset_entity_base", "assets asset_volume_stats asset_maint", """SELECT e.id AS cse_id, e.name AS cse_name, total_count, recent_count, mean_daily, std_daily, drop_pct, z_score,
 coalesce(maintenance_count, 0) AS maintenance_count FROM assets e LEFT JOIN asset_volume_stats v ON v.cse_id = e.id LEFT JOIN asset_maint m ON m.asset_id = e.id""")
NEG02 = """CASE WHEN maintenance_count > 0 THEN 'SUPPRESSED' WHEN total_count IS NULL THEN 'CONFIRMED' WHEN drop_pct >= 70 AND z_score >= 1.5 THEN 'CONFIRMED' ELSE 'PASS' END"""


@query("neg02", "entity_base", _verdict_sql(NEG02, "CRITICAL", 0.95, 30.0, "cse_id", "entity_base"))
def neg02(spark, d):
    return N.entity_evaluations(estate(spark, d)).select(*VERDICTS)


@query("neg02_by_asset", "asset_entity_base", _verdict_sql(NEG02, "CRITICAL", 0.95, 30.0, "cse_id", "asset_entity_base", ", drop_pct, z_score"))
def neg02_by_asset(spark, d):
    return N.entity_evaluations(asset_entities(spark, d)).select(*VERDICTS, "drop_pct", "z_score")


@query("daily_activity", "asset_volume_stats", f"""SELECT cse_id AS asset_id, total_count, recent_count, {r('mean_daily', 6)} AS mean_daily, {r('std_daily', 6)} AS std_daily,
 drop_pct, z_score FROM asset_volume_stats""")
def daily_activity(spark, d):
    est = asset_entities(spark, d)
    v = N.volume_stats(N.daily_volume(est.telemetry, est.as_of, 30), 30)
    return v.select(F.col("cse_id").alias("asset_id"), "total_count", "recent_count", S.rounded(F.col("mean_daily"), 6).alias("mean_daily"),
                    S.rounded(F.col("std_daily"), 6).alias("std_daily"), "drop_pct", "z_score")


@query("asset_activity", "telemetry", "SELECT asset_id, count(*) AS alert_count, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S') AS last_seen FROM telemetry GROUP BY asset_id")
def asset_activity(spark, d):
    return N.asset_activity(estate(spark, d).telemetry).select("asset_id", "alert_count", S.iso(F.col("last_seen")).alias("last_seen"))


@query("peer_median", "density peer_med", "SELECT d.asset_id, density, coalesce(peer_count, CASE WHEN d.status = 'ACTIVE' THEN 0 END) AS peer_count, peer_median FROM density d LEFT JOIN peer_med p ON p.asset_id = d.asset_id")
def peer_median(spark, d):
    est = estate(spark, d)
    return N.peer_medians(est.assets, N.asset_activity(est.alerts).select("asset_id", "alert_count"))


cte("expected", "entities", """SELECT id AS cse_id, name AS cse_name, sector, unnest(['MALWARE_DETECTION','AUTHENTICATION_FAILURE','PRIVILEGE_ESCALATION','EXFILTRATION_SUSPICION']) AS expected_category FROM entities""")
cte("category_base", "expected alerts", """SELECT e.*, n AS category_count FROM expected e LEFT JOIN (SELECT cse_id, category, count(*) AS n FROM alerts GROUP BY 1, 2) o
 ON o.cse_id = e.cse_id AND o.category = e.expected_category""")
NEG03 = "CASE WHEN category_count IS NULL THEN 'CONFIRMED' ELSE 'PASS' END"


@query("neg03", "category_base", _verdict_sql(NEG03, "HIGH", 0.9, 20.0, "cse_id", "category_base", ", expected_category AS qualifier"))
def neg03(spark, d):
    return N.category_evaluations(estate(spark, d)).select(*VERDICTS, "qualifier")


# --- peers ----------------------------------------------------------------------------
cte("rates", "entities alerts investigations escalations", """SELECT e.id AS cse_id, sector, size_tier, inv AS investigation_count, esc AS escalation_count, esc / inv AS escalation_rate FROM entities e LEFT JOIN
 (SELECT a.cse_id, count(*) AS inv, count(x.id) AS esc FROM investigations i JOIN alerts a ON a.id = i.alert_id LEFT JOIN escalations x ON x.investigation_id = i.id GROUP BY 1) c ON c.cse_id = e.id""")
_Q = lambda c, g: f"""SELECT {g}, count({c}) AS members, quantile_cont({c}, 0.25) AS p25, median({c}) AS median, quantile_cont({c}, 0.75) AS p75, stddev_pop({c}) AS std_dev"""


@query("peer_baselines", "rates flow entities", f"""SELECT sector, size_tier, metric, members, {r('p25', 6)} AS p25, {r('median', 6)} AS median, {r('p75', 6)} AS p75, {r('std_dev', 6)} AS std_dev FROM (
 {_Q('escalation_rate', 'sector, size_tier')}, 'escalation_rate' AS metric FROM rates WHERE escalation_rate IS NOT NULL GROUP BY sector, size_tier
 UNION ALL {_Q('duration_seconds', 'sector, size_tier')}, 'investigation_duration' AS metric FROM flow f JOIN entities e ON e.id = f.cse_id WHERE duration_seconds IS NOT NULL GROUP BY sector, size_tier)""")
def peer_baselines(spark, d):
    est = estate(spark, d)
    group = ["sector", "size_tier"]
    owner = est.entities.select(F.col("id").alias("cse_id"), *group)
    durations = (est.investigations.join(est.alerts.select(F.col("id").alias("alert_id"), "cse_id"), "alert_id")
                 .join(owner, "cse_id"))
    both = PE.baseline(PE.escalation_rates(est), group, "escalation_rate", "escalation_rate").unionByName(
        PE.baseline(durations, group, "investigation_duration", "duration_seconds"))
    return both.select(*group, "metric", "members", *[S.rounded(F.col(c).cast("double"), 6).alias(c) for c in ("p25", "median", "p75", "std_dev")])


@query("peer01", "rates", f"""SELECT cse_id AS target_id, CASE WHEN escalation_rate IS NULL THEN 'INSUFFICIENT_DATA' WHEN escalation_rate < p25 - 2 * std_dev THEN 'FAIL' ELSE 'PASS' END AS status,
 investigation_count, escalation_count FROM rates JOIN (SELECT sector, quantile_cont(escalation_rate, 0.25) AS p25, stddev_pop(escalation_rate) AS std_dev FROM rates GROUP BY sector) b USING (sector)""")
def peer01(spark, d):
    return PE.peer01_evaluations(estate(spark, d), ["sector"]).select("target_id", "status", "investigation_count", "escalation_count")


# --- evaluations and findings -------------------------------------------------------------
cte("evals", "flow asset_base entity_base category_base", f"""SELECT 'GAP-01' AS rule_id, alert_id AS target_id, '' AS qualifier, {GAP01} AS status FROM flow
 UNION ALL SELECT 'GAP-03', alert_id, '', {GAP03} FROM flow UNION ALL SELECT 'NEG-01', asset_id, '', {NEG01} FROM asset_base
 UNION ALL SELECT 'NEG-04', asset_id, '', {NEG04} FROM asset_base UNION ALL SELECT 'NEG-05', asset_id, '', {NEG05} FROM asset_base
 UNION ALL SELECT 'NEG-02', cse_id, '', {NEG02} FROM entity_base UNION ALL SELECT 'NEG-03', cse_id, expected_category, {NEG03} FROM category_base""")


@query("rule_evaluations", "evals", "SELECT rule_id, target_id, qualifier, status FROM evals")
def rule_evaluations(spark, d):
    return FD.all_evaluations(estate(spark, d)).select("rule_id", "target_id", "qualifier", "status")


@query("rule_evaluation_counts", "evals", "SELECT rule_id, status, count(*) AS n FROM evals GROUP BY 1, 2")
def rule_evaluation_counts(spark, d):
    return FD.all_evaluations(estate(spark, d)).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


_SIL = one("coalesce(silence_hours, {0})")


def _sil(default: float) -> str:
    return one(f"coalesce(silence_hours, {default})")


_SHARE = one("density_ratio * 100.0")
cte("hits", "flow asset_base entity_base category_base", f"""
 SELECT 'GAP-01' AS rule_id, 'Alert' AS target_type, alert_id AS target_id, '' AS qualifier, cse_id, asset_id, case_id, alert_id, investigation_id, 'CRITICAL' AS severity, 0.95::double AS c0, 30.0::double AS risk_score,
  100.0::double AS evidence_completeness, 'Critical alert closed without supervisory escalation.' AS reason FROM flow WHERE {GAP01} = 'FAIL'
 UNION ALL SELECT 'GAP-03', 'Alert', alert_id, '', cse_id, asset_id, case_id, alert_id, investigation_id, 'MEDIUM', 0.9, 15.0, 75.0, 'Investigation duration far below the operational baseline.' FROM flow WHERE {GAP03} = 'FAIL'
 UNION ALL SELECT 'NEG-01', 'Asset', asset_id, '', cse_id, asset_id, NULL, NULL, NULL, 'HIGH', 0.95, 25.0, 100.0, 'Complete telemetry silence of ' || {_sil(49.0)} || ' h on critical asset ' || asset_name || '.' FROM asset_base WHERE {NEG01} = 'CONFIRMED'
 UNION ALL SELECT 'NEG-04', 'Asset', asset_id, '', cse_id, asset_id, NULL, NULL, NULL, 'MEDIUM', 0.85, 15.0, 100.0, 'Asset ' || asset_name || ' shows only ' || {_SHARE} || '% of its peers'' telemetry.' FROM asset_base WHERE {NEG04} = 'CONFIRMED'
 UNION ALL SELECT 'NEG-05', 'Asset', asset_id, '', cse_id, asset_id, NULL, NULL, NULL, 'HIGH', 0.9, 25.0, 100.0, 'Unexplained silence of ' || {_sil(25.0)} || ' h on asset ' || asset_name || '.' FROM asset_base WHERE {NEG05} = 'CONFIRMED'
 UNION ALL SELECT 'NEG-02', 'CSE', cse_id, '', cse_id, NULL, NULL, NULL, NULL, 'CRITICAL', 0.95, 30.0, 100.0, CASE WHEN total_count IS NULL THEN 'Entity ' || cse_name || ' sent no alerts.' ELSE
  'Alert volume of ' || cse_name || ' fell by ' || cast(drop_pct as varchar) || '% (z ' || cast(z_score as varchar) || ').' END FROM entity_base WHERE {NEG02} = 'CONFIRMED'
 UNION ALL SELECT 'NEG-03', 'CSE', cse_id, expected_category, cse_id, NULL, NULL, NULL, NULL, 'HIGH', 0.9, 20.0, 100.0, 'Mandatory category ' || expected_category || ' is absent at ' || cse_name || '.' FROM category_base WHERE {NEG03} = 'CONFIRMED'""")
cte("findings", "hits", f"""SELECT *, {key(RUN_SQL, 'rule_id', 'target_type', 'target_id', 'qualifier')} AS finding_id, {r('risk_score * c0', 2)} AS supervisory_priority,
 CASE WHEN evidence_completeness < 100 THEN {r('c0 * (evidence_completeness / 100.0)', 4)} ELSE c0 END AS confidence FROM hits""")
_F = "finding_id, rule_id, target_id, cse_id, asset_id, case_id, severity, confidence, risk_score, supervisory_priority, evidence_completeness, reason"


@query("gap_findings", "findings", f"SELECT {_F} FROM findings WHERE rule_id LIKE 'GAP-%'")
def gap_findings(spark, d):
    return FD.gap_findings(estate(spark, d)).select(*_F.split(", "))


@query("negative_findings", "findings", f"SELECT {_F} FROM findings WHERE rule_id LIKE 'NEG-%'")
def negative_findings(spark, d):
    return FD.negative_findings(estate(spark, d)).select(*_F.split(", "))


@query("findings", "findings", f"SELECT {_F} FROM findings")
def findings(spark, d):
    return FD.findings(estate(spark, d)).select(*_F.split(", "))


@query("analysis_run", "alerts findings", f"""SELECT {RUN_SQL} AS analysis_run_id, 'COMPLETED' AS status, (SELECT count(*) FROM alerts) AS records_processed, (SELECT count(*) FROM findings) AS findings_generated""")
def analysis_run(spark, d):
    run = analysis(spark, d)
    return FD.analysis_run(run.estate, run.findings).select("analysis_run_id", "status", "records_processed", "findings_generated")


# --- evidence -------------------------------------------------------------------------
_EV = "evidence_type, source_table, source_record_id"
cte("evidence", "findings flow", f"""SELECT finding_id, rule_id, {_EV}, {key('finding_id', 'evidence_type', 'source_table', 'source_record_id')} AS evidence_id FROM (
 SELECT finding_id, rule_id, 'DIRECT_RECORD' AS evidence_type, 'alerts' AS source_table, alert_id AS source_record_id FROM findings WHERE target_type = 'Alert'
 UNION ALL SELECT finding_id, rule_id, 'DIRECT_RECORD', 'assets', f.asset_id FROM findings f WHERE f.target_type IN ('Alert', 'Asset') AND EXISTS (SELECT 1 FROM assets s WHERE s.id = f.asset_id)
 UNION ALL SELECT finding_id, rule_id, 'DIRECT_RECORD', 'cses', cse_id FROM findings WHERE target_type = 'CSE'
 UNION ALL SELECT finding_id, rule_id, 'DIRECT_RECORD', 'investigations', investigation_id FROM findings WHERE target_type = 'Alert' AND investigation_id IS NOT NULL
 UNION ALL SELECT finding_id, rule_id, 'MISSING_EXPECTED_RECORD', 'investigations', 'MISSING_INVESTIGATION_' || alert_id FROM findings WHERE target_type = 'Alert' AND investigation_id IS NULL
 UNION ALL SELECT finding_id, rule_id, 'MISSING_EXPECTED_RECORD', 'escalations', 'MISSING_ESCALATION_' || alert_id FROM findings WHERE rule_id = 'GAP-01'
 UNION ALL SELECT finding_id, rule_id, 'WORKFLOW_TRANSITION', 'workflows', alert_id FROM findings WHERE target_type = 'Alert'
 UNION ALL SELECT finding_id, rule_id, 'DATA_QUALITY', 'dataset_imports', {IMPORT_SQL} FROM findings
 UNION ALL SELECT finding_id, rule_id, 'MISSING_EXPECTED_RECORD', 'alerts', 'MISSING_TELEMETRY_' || asset_id FROM findings WHERE rule_id = 'NEG-01'
 UNION ALL SELECT finding_id, rule_id, 'CONTEXT_SUPPRESSION', 'maintenance_logs', 'MAINT_CHECK_' || asset_id FROM findings WHERE rule_id = 'NEG-01'
 UNION ALL SELECT finding_id, rule_id, 'HISTORICAL_BASELINE', 'baselines', 'BASELINE_30D_' || cse_id FROM findings WHERE rule_id = 'NEG-02'
 UNION ALL SELECT finding_id, rule_id, 'STATISTICAL_DEVIATION', 'baseline_deviations', 'DEV_NEG02_' || cse_id FROM findings WHERE rule_id = 'NEG-02'
 UNION ALL SELECT finding_id, rule_id, 'MISSING_EXPECTED_RECORD', 'alerts', 'MISSING_CATEGORY_' || cse_id FROM findings WHERE rule_id = 'NEG-03'
 UNION ALL SELECT finding_id, rule_id, 'PEER_COMPARISON', 'peer_groups', 'PEER_GROUP_' || cse_id FROM findings WHERE rule_id = 'NEG-04'
 UNION ALL SELECT finding_id, rule_id, 'STATISTICAL_DEVIATION', 'peer_deviations', 'DEV_NEG04_' || asset_id FROM findings WHERE rule_id = 'NEG-04'
 UNION ALL SELECT finding_id, rule_id, 'CONTEXT_SUPPRESSION', 'maintenance_logs', 'MAINT_AUDIT_' || asset_id FROM findings WHERE rule_id = 'NEG-05')""")


@query("evidence_rows", "evidence", f"SELECT evidence_id, finding_id, rule_id, {_EV} FROM evidence")
def evidence_rows(spark, d):
    return E.evidence_rows(analysis(spark, d).findings).select("evidence_id", "finding_id", "rule_id", *_EV.split(", "))


@query("evidence_completeness", "findings evidence", """SELECT f.finding_id, f.rule_id, evidence_completeness, confidence, kinds AS present_types, n AS record_count FROM findings f JOIN
 (SELECT finding_id, string_agg(DISTINCT evidence_type, ',' ORDER BY evidence_type) AS kinds, count(*) AS n FROM evidence GROUP BY 1) e ON e.finding_id = f.finding_id""")
def evidence_completeness(spark, d):
    run = analysis(spark, d)
    p = E.packages(run.findings, run.estate.as_of, run.estate.import_id)
    return p.select("finding_id", "rule_id", "evidence_completeness", "confidence", F.array_join("present_evidence_types", ",").alias("present_types"),
                    F.size("supporting_records").cast("long").alias("record_count"))


@query("evidence_packages", "findings evidence", """SELECT f.finding_id, CASE WHEN f.rule_id LIKE 'GAP%' THEN 'ExecutionGapEngine' ELSE 'NegativeSpaceEngine' END AS engine, evidence_completeness >= 100 AS is_evidence_complete,
 f.rule_id LIKE 'GAP%' AS has_workflow, f.rule_id = 'NEG-02' AS has_baseline, f.rule_id = 'NEG-04' AS has_peers, supervisory_priority,
 '{"completeness_score":100.0,"is_clean":true}' AS data_quality FROM findings f""")
def evidence_packages(spark, d):
    run = analysis(spark, d)
    p = E.packages(run.findings, run.estate.as_of, run.estate.import_id)
    return p.select("finding_id", "engine", "is_evidence_complete", F.col("workflow_difference").isNotNull().alias("has_workflow"),
                    F.col("baseline_stats").isNotNull().alias("has_baseline"), F.col("peer_stats").isNotNull().alias("has_peers"),
                    "supervisory_priority", "data_quality")


@query("evidence_integrity", "evidence alerts assets", """SELECT finding_id, rule_id, count(*) AS evidence_count, count(*) FILTER (gone) AS tampered_count,
 CASE WHEN count(*) FILTER (gone) > 0 THEN 'INTEGRITY_COMPROMISED' ELSE 'VERIFIED' END AS status FROM (SELECT *,
 (source_table = 'alerts' AND source_record_id NOT IN (SELECT id FROM alerts)) OR (source_table = 'assets' AND source_record_id NOT IN (SELECT id FROM assets)) AS gone FROM evidence) GROUP BY 1, 2""")
def evidence_integrity(spark, d):
    run = analysis(spark, d)
    return E.integrity(E.evidence_rows(run.findings), run.estate).select("finding_id", "rule_id", "evidence_count", "tampered_count", "status")


@query("evidence_vanished", "evidence alerts assets", """SELECT finding_id, rule_id, count(*) AS evidence_count, count(*) FILTER (gone) AS tampered_count,
 CASE WHEN count(*) FILTER (gone) > 0 THEN 'INTEGRITY_COMPROMISED' ELSE 'VERIFIED' END AS status FROM (SELECT *,
 (source_table = 'alerts' AND source_record_id NOT IN (SELECT id FROM alerts WHERE severity <> 'CRITICAL')) OR (source_table = 'assets' AND source_record_id NOT IN (SELECT id FROM assets)) AS gone FROM evidence) GROUP BY 1, 2""")
def evidence_vanished(spark, d):
    """The critical alerts are deleted after the analysis: findings that stand on them are compromised, all others verified."""
    run = analysis(spark, d)
    left = SimpleNamespace(alerts=run.estate.alerts.where("severity <> 'CRITICAL'"), assets=run.estate.assets)
    return E.integrity(E.evidence_rows(run.findings), left).select("finding_id", "rule_id", "evidence_count", "tampered_count", "status")


@query("evidence_hash_check", "findings", "SELECT finding_id, rule_id = 'GAP-03' OR rule_id = 'NEG-02' AS changed FROM findings")
def evidence_hash_check(spark, d):
    """One payload of each GAP-03 and NEG-02 finding is rewritten after sealing: exactly their package hashes change."""
    run = analysis(spark, d)
    rows = E.evidence_rows(run.findings)
    hit = F.col("rule_id").isin("GAP-03", "NEG-02") & (F.col("evidence_type") == "DATA_QUALITY")
    now = E.integrity(rows.withColumn("payload_json", F.when(hit, "{}").otherwise(F.col("payload_json"))), run.estate)
    sealed = E.integrity(rows, run.estate).select("finding_id", F.col("sha256_hash").alias("sealed"))
    return now.join(sealed, "finding_id").select("finding_id", (F.col("sealed") != F.col("sha256_hash")).alias("changed"))
