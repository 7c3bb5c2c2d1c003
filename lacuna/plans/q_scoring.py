"""Risk, review queue and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.operators import lookups as L
from lacuna.operators import review_queue as Q
from lacuna.operators import risk as R
from lacuna.plans import analysis_job as AJ
from lacuna.plans.ctes import RUN_SQL, cte, key, one, r
from lacuna.plans.lens import estate, tag
from lacuna.plans.registry import query
from lacuna.plans.stages import analysis, scratch
from lacuna.sources import sinks as SK

_BAND = lambda c, mid: f"CASE WHEN {c} <= 24.99 THEN 'LOW' WHEN {c} >= 25 AND {c} <= 49.99 THEN '{mid}' WHEN {c} >= 50 AND {c} <= 74.99 THEN 'HIGH' WHEN {c} >= 75 THEN 'CRITICAL' ELSE 'LOW' END"
_SEV = lambda a, b, c, d: f"CASE severity WHEN 'CRITICAL' THEN {a} WHEN 'HIGH' THEN {b} WHEN 'MEDIUM' THEN {c} ELSE {d} END"

cte("contrib", "findings", f"""SELECT *, CASE WHEN confidence < 0.7 THEN {r('base_contribution * greatest(0.5, confidence)', 2)} ELSE base_contribution END AS effective_contribution, confidence < 0.7 AS is_qualified FROM (
 SELECT *, (CASE component WHEN 'investigation_anomaly' THEN 15 WHEN 'execution_gap' THEN {_SEV(30, 25, 18, 10)} WHEN 'peer_deviation' THEN 20 ELSE {_SEV(25, 20, 15, 8)} END)::double AS base_contribution FROM (
 SELECT *, CASE WHEN rule_id IN ('GAP-02','GAP-04','GAP-05') THEN 'investigation_anomaly' WHEN rule_id LIKE 'GAP%' THEN 'execution_gap' WHEN rule_id = 'NEG-04' THEN 'peer_deviation' WHEN rule_id LIKE 'NEG%' THEN 'negative_space' END AS component
 FROM findings WHERE upper(reason) NOT LIKE '%SUPPRESSED%') WHERE component IS NOT NULL)""")
cte("risk_sum", "entities contrib assets", """SELECT e.id AS cse_id, e.name AS cse_name, least(30.0::double, coalesce(eg, 0.0::double)) AS execution_gap, least(25.0::double, coalesce(ns, 0.0::double)) AS negative_space,
 least(20.0::double, coalesce(pd, 0.0::double)) AS peer_deviation, least(15.0::double, coalesce(ia, 0.0::double)) AS investigation_anomaly,
 CASE WHEN crit THEN 10.0::double WHEN high THEN 6.0::double ELSE 0.0::double END AS asset_criticality, coalesce(n, 0) AS contributing_findings, coalesce(q, 0) AS qualified_findings, conf_units, n
 FROM entities e LEFT JOIN (SELECT cse_id, max(effective_contribution) FILTER (component = 'execution_gap') AS eg, max(effective_contribution) FILTER (component = 'negative_space') AS ns,
 max(effective_contribution) FILTER (component = 'peer_deviation') AS pd, max(effective_contribution) FILTER (component = 'investigation_anomaly') AS ia, count(*) AS n, count(*) FILTER (is_qualified) AS q,
 sum(round_even(confidence * 10000, 0)::BIGINT) AS conf_units FROM contrib GROUP BY 1) c ON c.cse_id = e.id
 LEFT JOIN (SELECT cse_id, bool_or(criticality = 'CRITICAL') AS crit, bool_or(criticality = 'HIGH') AS high FROM assets WHERE status = 'ACTIVE' GROUP BY 1) a ON a.cse_id = e.id""")
cte("risk", "risk_sum", f"""SELECT *, {_BAND('normalized_score', 'MODERATE')} AS risk_band FROM (SELECT *, {key(RUN_SQL, 'cse_id')} AS risk_score_id, {r('least(100, greatest(0, raw_score))', 2)} AS normalized_score,
 CASE WHEN n IS NULL THEN 1.0::double ELSE {r('conf_units::double / n / 10000.0::double', 4)} END AS overall_confidence FROM
 (SELECT *, execution_gap + negative_space + peer_deviation + investigation_anomaly + asset_criticality AS raw_score FROM risk_sum))""")
_R = "risk_score_id, cse_id, execution_gap, negative_space, peer_deviation, investigation_anomaly, asset_criticality, raw_score, normalized_score, risk_band, overall_confidence, contributing_findings, qualified_findings"


def _scored(spark, d):
    run = analysis(spark, d)
    return run.estate, run.findings, R.entity_risk(run.estate, run.findings)


@query("finding_contributions", "contrib", "SELECT finding_id, cse_id, rule_id, component, base_contribution, effective_contribution, is_qualified FROM contrib")
def finding_contributions(spark, d):
    return R.contributions(analysis(spark, d).findings).select("finding_id", "cse_id", "rule_id", "component", "base_contribution", "effective_contribution", "is_qualified")


@query("entity_risk", "risk", f"SELECT {_R} FROM risk")
def entity_risk(spark, d):
    return _scored(spark, d)[2].select(*_R.split(", "))


cte("refs", "findings assets", """SELECT cse_id, finding_id, 0 AS position, 'alerts' AS source_table, alert_id AS source_record_id FROM findings WHERE target_type = 'Alert'
 UNION ALL SELECT f.cse_id, finding_id, 1, 'assets', f.asset_id FROM findings f JOIN assets s ON s.id = f.asset_id
 UNION ALL SELECT cse_id, finding_id, 2, 'investigations', investigation_id FROM findings WHERE investigation_id IS NOT NULL
 UNION ALL SELECT f.cse_id, finding_id, 3, 'escalations', 'ESC-' || substr(f.investigation_id, 5) FROM findings f WHERE f.investigation_id IS NOT NULL AND 'ESC-' || substr(f.investigation_id, 5) IN (SELECT id FROM escalations)
 UNION ALL SELECT cse_id, finding_id, 4, 'cases', case_id FROM findings WHERE case_id IS NOT NULL
 UNION ALL SELECT f.cse_id, finding_id, 5, 'closures', c.id FROM findings f JOIN closures c ON c.case_id = f.case_id
 UNION ALL SELECT cse_id, finding_id, 0, 'cses', cse_id FROM findings WHERE target_type = 'CSE'""")
from lacuna.plans.ctes import CTES  # noqa: E402

CTES["refs"][0].extend(["escalations", "closures"])


@query("risk_explanation_refs", "refs", """SELECT cse_id, CAST(rn AS INT) AS ref_rank, finding_id, source_table, source_record_id FROM (SELECT *, row_number() OVER (PARTITION BY cse_id ORDER BY finding_id, position) AS rn FROM refs) WHERE rn <= 10""")
def risk_explanation_refs(spark, d):
    return R.explanation_refs(R.contributions(analysis(spark, d).findings))


@query("risk_explanations", "risk", f"""SELECT cse_id, 'Supervisory risk of ' || cse_name || ': ' || {one('normalized_score')} || ' / 100, ' || risk_band AS title,
 to_json(struct_pack(component_breakdown := struct_pack(asset_criticality := asset_criticality, execution_gap := execution_gap, investigation_anomaly := investigation_anomaly, negative_space := negative_space, peer_deviation := peer_deviation),
 contributing_findings_count := contributing_findings, normalized_score := normalized_score, overall_confidence := overall_confidence, raw_score := raw_score, risk_band := risk_band))::varchar AS explanation_json FROM risk""")
def risk_explanations(spark, d):
    return R.explanations(analysis(spark, d).risk)


# --- review queue -----------------------------------------------------------------------
cte("cand", "findings risk assets", f"""SELECT *, {r('least(100, greatest(0, CASE WHEN factor_evidence_completeness < 40 THEN greatest(0, raw - 15) ELSE raw END))', 2)} AS priority_score FROM (
 SELECT *, factor_risk_significance * 0.25::double + factor_finding_severity * 0.2::double + factor_asset_criticality * 0.15::double + factor_evidence_completeness * 0.15::double + factor_evidence_confidence * 0.1::double
  + factor_novelty * 0.05::double + factor_peer_deviation * 0.05::double + factor_review_urgency * 0.05::double AS raw FROM (
 SELECT f.finding_id, f.rule_id, f.cse_id, f.asset_id, f.severity, k.risk_score_id, coalesce(k.normalized_score, 0.0::double) AS entity_risk, CASE WHEN f.confidence = 0 THEN 1.0::double ELSE f.confidence END AS sort_confidence,
 {r('least(100, greatest(0, greatest(coalesce(k.normalized_score, 0), f.risk_score)))', 2)} AS factor_risk_significance,
 ({_SEV(100, 80, 50, 25).replace('severity', 'f.severity')})::double AS factor_finding_severity,
 (CASE a.criticality WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 70 WHEN 'MEDIUM' THEN 40 ELSE 20 END)::double AS factor_asset_criticality,
 {r('f.evidence_completeness', 2)} AS factor_evidence_completeness, {r('f.confidence * 100.0::double', 2)} AS factor_evidence_confidence, 100.0::double AS factor_novelty,
 CASE WHEN f.rule_id = 'NEG-04' THEN 100.0::double ELSE 0.0::double END AS factor_peer_deviation, 50.0::double AS factor_review_urgency, split_part(f.rule_id, '-', 1) AS rule_category
 FROM findings f LEFT JOIN risk k ON k.cse_id = f.cse_id LEFT JOIN assets a ON a.id = f.asset_id))""")
cte("ordered", "cand", """SELECT *, row_number() OVER (ORDER BY priority_score DESC, entity_risk DESC, sort_confidence DESC, finding_id) AS pos FROM cand""")
cte("greedy", "ordered", """SELECT 0::BIGINT AS pos, []::varchar[] AS cses, []::varchar[] AS cats
 UNION ALL SELECT pick.pos, list_append(g.cses, pick.cse_id), list_append(g.cats, pick.rule_category) FROM greedy g, LATERAL (SELECT o.pos, o.cse_id, o.rule_category FROM ordered o
 WHERE o.pos > g.pos AND len(list_filter(g.cses, lambda x: x = o.cse_id)) < 2 AND len(list_filter(g.cats, lambda x: x = o.rule_category)) < 3 ORDER BY o.pos LIMIT 1) pick""")
cte("queue", "ordered greedy", f"""SELECT *, {key(RUN_SQL, 'finding_id')} AS queue_item_id, {_BAND('priority_score', 'MEDIUM')} AS priority_band FROM (
 SELECT *, CAST(row_number() OVER (ORDER BY pos) AS INT) AS rank FROM (
 SELECT o.*, 1 AS selection_pass FROM ordered o WHERE pos IN (SELECT pos FROM greedy WHERE pos > 0)
 UNION ALL SELECT * FROM (SELECT o.*, 2 AS selection_pass FROM ordered o WHERE pos NOT IN (SELECT pos FROM greedy) ORDER BY pos LIMIT (SELECT greatest(0, 10 - (count(*) - 1)) FROM greedy))))""")
_C = "finding_id, rule_id, cse_id, rule_category, priority_score, entity_risk, " + ", ".join(f"factor_{f}" for f in Q.FACTORS)
_QC = "queue_item_id, finding_id, cse_id, rule_id, risk_score_id, priority_score, rank, priority_band, selection_pass"


def _cands(spark, d):
    run = analysis(spark, d)
    return run.estate, run.findings, run.risk, Q.candidates(run.findings, run.risk, run.estate.assets)


@query("candidate_priority", "cand", f"SELECT {_C} FROM cand")
def candidate_priority(spark, d):
    return _cands(spark, d)[3].select(*_C.split(", "))


@query("review_queue", "queue", f"SELECT {_QC}, 'Rank ' || rank || ', priority ' || {one('priority_score')} || ' (' || priority_band || ')' AS rationale FROM queue")
def review_queue(spark, d):
    return Q.review_queue(analysis(spark, d).candidates).select(*_QC.split(", "), "rationale")


@query("queue_diversity", "cand queue", """SELECT (SELECT count(*) FROM cand) AS candidates_processed, count(*) AS queue_items_generated, (SELECT count(*) FROM cand) - count(*) AS candidates_excluded_by_diversity,
 count(*) FILTER (selection_pass = 2) AS candidates_reintroduced_by_fallback, (SELECT max(n) >= 3 FROM (SELECT count(*) AS n FROM queue GROUP BY cse_id)) AS systemic_concentration_detected,
 count(DISTINCT cse_id) AS cse_diversity_count, count(DISTINCT rule_category) AS category_diversity_count FROM queue""")
def queue_diversity(spark, d):
    run = analysis(spark, d)
    return Q.diversity_metrics(run.candidates, run.queue).drop("analysis_run_id")


@query("queue_search", "queue", f"SELECT {_QC} FROM queue WHERE priority_band = 'CRITICAL' AND severity = 'CRITICAL' AND (queue_item_id LIKE '%cse%' OR lower(cse_id) LIKE '%cse%')")
def queue_search(spark, d):
    queue = analysis(spark, d).queue
    return Q.search(queue, "CSE", "NEW", "CRITICAL", "CRITICAL", "priority_score", False).select(*_QC.split(", "))


def _changes(spark, d):
    """Status events taken from the event stream: every event moves one queue item, by rank."""
    e = estate(spark, d).tables.events
    state = F.when(F.col("event_type") == "click", "IN_REVIEW").when(F.col("event_type") == "error", "ESCALATED") \
        .when(F.col("event_type") == "purchase", "RESOLVED").when(F.col("event_type") == "signup", "DISMISSED").otherwise("NEW")
    return e.select("event_id", (F.col("event_id") % 10 + 1).cast("int").alias("rank"), F.col("ts").cast("timestamp").alias("changed_at"),
                    state.alias("new_status"), tag("USR", F.col("user_id")).alias("user_id"), F.lit("").alias("notes"))


cte("changes", "queue", """SELECT event_id, queue_item_id, ts AS changed_at, CASE event_type WHEN 'click' THEN 'IN_REVIEW' WHEN 'error' THEN 'ESCALATED' WHEN 'purchase' THEN 'RESOLVED' WHEN 'signup' THEN 'DISMISSED' ELSE 'NEW' END AS new_status,
 'USR-' || user_id AS user_id, finding_id FROM events JOIN queue ON rank = event_id % 10 + 1""")


def _changed(spark, d):
    queue = analysis(spark, d).queue
    keyed = _changes(spark, d).join(queue.select("rank", "queue_item_id"), "rank").drop("rank")
    return queue, *Q.status_changes(queue, keyed)


@query("queue_status_now", "queue changes", """SELECT q.queue_item_id, rank, coalesce(s, 'NEW') AS status FROM queue q LEFT JOIN (SELECT queue_item_id, arg_max(new_status, struct_pack(c := changed_at, e := event_id)) AS s FROM changes GROUP BY 1) c ON c.queue_item_id = q.queue_item_id""")
def queue_status_now(spark, d):
    return _changed(spark, d)[1].select("queue_item_id", "rank", "status")


@query("queue_status_audit", "changes", """SELECT event_id, queue_item_id AS entity_id, user_id, coalesce(lag(new_status) OVER (PARTITION BY queue_item_id ORDER BY changed_at, event_id), 'NEW') AS previous_status, new_status, finding_id FROM changes""")
def queue_status_audit(spark, d):
    return _changed(spark, d)[2].select("event_id", "entity_id", "user_id", "previous_status", "new_status", "finding_id")


@query("queue_history", "queue changes", """SELECT q.queue_item_id, q.rank, event_id, new_status FROM queue q LEFT JOIN changes c ON c.queue_item_id = q.queue_item_id""")
def queue_history(spark, d):
    queue, _, audit = _changed(spark, d)
    return L.queue_history(queue, audit).select("queue_item_id", "rank", "event_id", "new_status")


# --- dashboard ---------------------------------------------------------------------------
@query("dashboard", "entities risk findings cases queue", f"""SELECT (SELECT count(*) FROM entities) AS total_cses, (SELECT count(*) FROM risk WHERE risk_band IN ('CRITICAL','HIGH') OR normalized_score >= 50) AS critical_cses,
 (SELECT count(*) FROM findings) AS total_findings, (SELECT count(*) FROM findings WHERE severity = 'CRITICAL') AS critical_findings,
 (SELECT {r('sum(round_even(evidence_completeness * 100, 0)::BIGINT)::double / count(*) / 100.0::double', 1)} FROM findings) AS avg_evidence_completeness,
 (SELECT count(*) FROM cases WHERE status = 'OPEN') AS open_cases, (SELECT count(*) FROM queue WHERE priority_score >= 50 OR priority_band IN ('CRITICAL','HIGH')) AS high_priority_reviews""")
def dashboard(spark, d):
    run = analysis(spark, d)
    return L.dashboard(run.estate, run.findings, run.risk, run.queue)


cte("profiles", "entities assets findings risk", """SELECT e.id AS cse_id, e.name, sector, entity_type, size_tier, coalesce(na, 0) AS asset_count, coalesce(nf, 0) AS finding_count, normalized_score AS risk_score, risk_band FROM entities e
 LEFT JOIN (SELECT cse_id, count(*) AS na FROM assets GROUP BY 1) a ON a.cse_id = e.id LEFT JOIN (SELECT cse_id, count(*) AS nf FROM findings GROUP BY 1) f ON f.cse_id = e.id LEFT JOIN risk k ON k.cse_id = e.id""")


def _profiles(spark, d):
    run = analysis(spark, d)
    return L.entity_profiles(run.estate, run.findings, run.risk)


@query("entity_profiles", "profiles", "SELECT * FROM profiles")
def entity_profiles(spark, d):
    return _profiles(spark, d)


@query("entity_search", "profiles", "SELECT cse_id, name, sector, risk_score, finding_count FROM profiles WHERE lower(sector) LIKE '%as%' AND risk_band = 'CRITICAL'")
def entity_search(spark, d):
    return L.search_profiles(_profiles(spark, d), "AS", "CRITICAL", "risk").select("cse_id", "name", "sector", "risk_score", "finding_count")


@query("risk_bands", "profiles", "SELECT risk_band, count(*) AS n FROM profiles GROUP BY 1")
def risk_bands(spark, d):
    return L.band_histogram(_profiles(spark, d))


@query("latest_risk", "risk", "SELECT cse_id, 'RUN-2' AS analysis_run_id, normalized_score, risk_band FROM risk")
def latest_risk(spark, d):
    risk = analysis(spark, d).risk.select("cse_id", "analysis_run_id", "normalized_score", "risk_band")
    older = risk.withColumn("computed_at", F.to_timestamp(F.lit("2024-01-30 00:00:00")))
    newer = risk.withColumn("analysis_run_id", F.lit("RUN-2")).withColumn("computed_at", F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    return L.latest_risk(older.unionByName(newer))


@query("risk_by_entity", "contrib", "SELECT finding_id, rule_id, component, effective_contribution FROM contrib WHERE cse_id = 'CSE-3'")
def risk_by_entity(spark, d):
    return L.by_key(R.contributions(analysis(spark, d).findings), cse_id="CSE-3").select("finding_id", "rule_id", "component", "effective_contribution")


def _stored(spark, d, table: str, run_id: str = "RUN-1"):
    """A table of the run, stored by an older run of the same id and then again, and read back."""
    run, store = analysis(spark, d), scratch(spark, "store")
    rows = getattr(run, table)
    for df in (rows.limit(0), rows):
        SK.replace_run(df, f"{store}/{table}", {"analysis_run_id": run_id})
    return AJ.stored(spark, store, table, run_id)


@query("stored_risk", "risk", f"SELECT {_R} FROM risk")
def stored_risk(spark, d):
    return _stored(spark, d, "risk").select(*_R.split(", "))


@query("stored_queue", "queue", f"SELECT {_QC} FROM queue")
def stored_queue(spark, d):
    return _stored(spark, d, "queue").select(*_QC.split(", "))
