"""Evidence-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.operators import components as CC
from lacuna.operators import evaluation as V
from lacuna.operators import graph as G
from lacuna.plans.ctes import cte, r
from lacuna.plans.lens import estate
from lacuna.plans.stages import analysis, scratch, written
from lacuna.plans.registry import query

_TS = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
cte("silent", "assets alerts", "SELECT * FROM assets WHERE criticality = 'CRITICAL' AND status = 'ACTIVE' AND id NOT IN (SELECT asset_id FROM alerts)")
cte("nodes", "entities assets analysts alerts investigations escalations cases closures silent", f"""SELECT 'CSE:' || id AS id, 'CSE' AS entity_type, id AS canonical_record_id, id AS cse_id, NULL AS timestamp, 'ACTIVE' AS status, NULL AS criticality FROM entities
 UNION ALL SELECT 'ASSET:' || id, 'ASSET', id, cse_id, NULL, status, criticality FROM assets UNION ALL SELECT 'ANALYST:' || id, 'ANALYST', id, cse_id, NULL, 'ACTIVE', NULL FROM analysts
 UNION ALL SELECT 'ALERT:' || id, 'ALERT', id, cse_id, {_TS('created_at')}, 'REGISTERED', NULL FROM alerts
 UNION ALL SELECT 'INVESTIGATION:' || i.id, 'INVESTIGATION', i.id, a.cse_id, NULL, 'COMPLETED', NULL FROM investigations i LEFT JOIN alerts a ON a.id = i.alert_id
 UNION ALL SELECT 'ESCALATION:' || e.id, 'ESCALATION', e.id, a.cse_id, NULL, 'ESCALATED', NULL FROM escalations e LEFT JOIN investigations i ON i.id = e.investigation_id LEFT JOIN alerts a ON a.id = i.alert_id
 UNION ALL SELECT 'CASE:' || id, 'CASE', id, cse_id, NULL, 'OPEN', NULL FROM cases
 UNION ALL SELECT 'CLOSURE:' || c.id, 'CLOSURE', c.id, k.cse_id, NULL, 'CLOSED', NULL FROM closures c LEFT JOIN cases k ON k.id = c.case_id
 UNION ALL SELECT 'MISSING_EXPECTED:' || id, 'MISSING_EXPECTED', id, cse_id, NULL, 'ABSENT', NULL FROM silent""")
cte("named_links", "findings escalations", """SELECT DISTINCT case_id, coalesce('ESCALATION:' || e.id, 'INVESTIGATION:' || f.investigation_id) AS src FROM findings f LEFT JOIN escalations e ON e.investigation_id = f.investigation_id
 WHERE case_id IS NOT NULL AND f.investigation_id IS NOT NULL""")
cte("owned_inv", "investigations alerts escalations", """SELECT a.cse_id, min(i.id) AS first_inv, min(e.id) AS first_esc FROM investigations i JOIN alerts a ON a.id = i.alert_id LEFT JOIN escalations e ON e.investigation_id = i.id GROUP BY 1""")
cte("links", "named_links owned_inv cases", """SELECT * FROM named_links UNION ALL SELECT c.id, coalesce('ESCALATION:' || first_esc, 'INVESTIGATION:' || first_inv) FROM cases c JOIN owned_inv o ON o.cse_id = c.cse_id
 WHERE c.id NOT IN (SELECT case_id FROM named_links) AND coalesce(first_esc, first_inv) IS NOT NULL""")
cte("edges", "entities assets analysts alerts investigations escalations cases closures silent links", f"""SELECT 'CSE:' || a.cse_id AS src, 'ASSET:' || a.id AS dst, 'OWNS' AS relationship, NULL AS timestamp, a.cse_id FROM assets a JOIN entities e ON e.id = a.cse_id
 UNION ALL SELECT coalesce('ASSET:' || s.id, 'CSE:' || e.id), 'ALERT:' || a.id, 'GENERATES', {_TS('a.created_at')}, a.cse_id FROM alerts a LEFT JOIN assets s ON s.id = a.asset_id LEFT JOIN entities e ON e.id = a.cse_id WHERE coalesce(s.id, e.id) IS NOT NULL
 UNION ALL SELECT 'ALERT:' || a.id, 'INVESTIGATION:' || i.id, 'INVESTIGATES', {_TS('i.started_at')}, a.cse_id FROM investigations i JOIN alerts a ON a.id = i.alert_id
 UNION ALL SELECT 'ANALYST:' || n.id, 'INVESTIGATION:' || i.id, 'ASSIGNED_TO', NULL, a.cse_id FROM investigations i JOIN analysts n ON n.id = i.analyst_id LEFT JOIN alerts a ON a.id = i.alert_id
 UNION ALL SELECT 'INVESTIGATION:' || i.id, 'ESCALATION:' || e.id, 'ESCALATED_TO', {_TS('e.escalated_at')}, a.cse_id FROM escalations e JOIN investigations i ON i.id = e.investigation_id LEFT JOIN alerts a ON a.id = i.alert_id
 UNION ALL SELECT l.src, 'CASE:' || c.id, 'RESULTS_IN', {_TS('c.opened_at')}, c.cse_id FROM links l JOIN cases c ON c.id = l.case_id
 UNION ALL SELECT 'CASE:' || c.id, 'CLOSURE:' || k.id, 'CLOSED_BY', {_TS('k.closed_at')}, c.cse_id FROM closures k JOIN cases c ON c.id = k.case_id
 UNION ALL SELECT 'ASSET:' || id, 'MISSING_EXPECTED:' || id, 'MISSING_EXPECTED', NULL, cse_id FROM silent""")
cte("first_case", "links cases", """SELECT src, arg_min(c.id, struct_pack(o := opened_at, i := c.id)) AS case_id, min(opened_at) AS opened_at FROM links l JOIN cases c ON c.id = l.case_id GROUP BY src""")
cte("paths", "alerts investigations escalations first_case closures", """SELECT a.id AS alert_id, a.cse_id, a.severity, a.created_at, i.started_at, i.id AS investigation_id, e.id AS escalation_id, x.case_id AS direct_case, x.opened_at AS direct_opened_at,
 CASE WHEN e.id IS NOT NULL THEN y.case_id ELSE x.case_id END AS case_id, k.id AS closure_id FROM alerts a LEFT JOIN investigations i ON i.alert_id = a.id LEFT JOIN escalations e ON e.investigation_id = i.id
 LEFT JOIN first_case x ON x.src = 'INVESTIGATION:' || i.id LEFT JOIN first_case y ON y.src = 'ESCALATION:' || e.id LEFT JOIN closures k ON k.case_id = CASE WHEN e.id IS NOT NULL THEN y.case_id ELSE x.case_id END""")
_ANOM = "severity = 'CRITICAL' AND escalation_id IS NULL AND direct_case IS NOT NULL"
cte("shares", "investigations analysts", """SELECT analyst_id, handled, sum(handled) OVER () AS total_handled, count(*) OVER () AS team_size, handled / sum(handled) OVER () AS share
 FROM (SELECT analyst_id, count(*) AS handled FROM investigations WHERE analyst_id IN (SELECT id FROM analysts) GROUP BY 1)""")
cte("orphans", "nodes edges", "SELECT * FROM nodes WHERE entity_type IN ('INVESTIGATION','ESCALATION','CASE') AND id NOT IN (SELECT dst FROM edges)")
cte("anomalies", "paths orphans investigations escalations shares silent", f"""SELECT 'MISSING_TRANSITION' AS anomaly_type, 'HIGH' AS severity, 'ALERT:' || alert_id AS source_node, cse_id, 'INVESTIGATION>ESCALATION' AS detail FROM paths WHERE {_ANOM}
 UNION ALL SELECT 'TEMPORAL_VIOLATION', 'HIGH', 'ALERT:' || alert_id, cse_id, 'INVESTIGATION_BEFORE_ALERT' FROM paths WHERE started_at < created_at
 UNION ALL SELECT 'TEMPORAL_VIOLATION', 'HIGH', 'ALERT:' || alert_id, cse_id, 'CASE_BEFORE_INVESTIGATION' FROM paths WHERE direct_opened_at < started_at
 UNION ALL SELECT 'ORPHAN_ENTITY', 'MEDIUM', id, cse_id, entity_type FROM orphans
 UNION ALL SELECT 'WORKFLOW_BOTTLENECK', 'HIGH', 'GRAPH_AGGREGATE', NULL, cast(ratio as varchar) FROM (SELECT {r('(SELECT count(*) FROM escalations) / count(*)', 4)} AS ratio, count(*) AS n FROM investigations) WHERE n >= 5 AND ratio < 0.15
 UNION ALL SELECT 'ANALYST_CONCENTRATION', 'MEDIUM', 'ANALYST:' || analyst_id, NULL, cast({r('share', 4)} as varchar) FROM shares WHERE total_handled >= 10 AND team_size >= 3 AND share > 0.4
 UNION ALL SELECT 'MISSING_EXPECTED_ACTIVITY', 'HIGH', 'MISSING_EXPECTED:' || id, cse_id, 'no alerts' FROM silent""")


def _paths(spark, d):
    run = analysis(spark, d)
    return G.paths(run.estate, run.case_links)


@query("graph_nodes", "nodes", "SELECT id, entity_type, canonical_record_id, cse_id, timestamp, status, criticality FROM nodes")
def graph_nodes(spark, d):
    return G.nodes(estate(spark, d))


@query("graph_edges", "edges", "SELECT src, dst, relationship, timestamp, cse_id FROM edges")
def graph_edges(spark, d):
    return analysis(spark, d).edges


@query("graph_case_links", "links", "SELECT case_id, src FROM links")
def graph_case_links(spark, d):
    return analysis(spark, d).case_links.select("case_id", "src")


@query("graph_paths", "paths", f"""SELECT alert_id, cse_id, severity, CASE WHEN severity = 'CRITICAL' THEN 'ALERT>INVESTIGATION>ESCALATION>CASE>CLOSURE' ELSE 'ALERT>INVESTIGATION>CASE>CLOSURE' END AS expected_path,
 concat_ws('>', 'ALERT', CASE WHEN investigation_id IS NOT NULL THEN 'INVESTIGATION' END, CASE WHEN escalation_id IS NOT NULL THEN 'ESCALATION' END, CASE WHEN case_id IS NOT NULL THEN 'CASE' END,
 CASE WHEN closure_id IS NOT NULL THEN 'CLOSURE' END) AS observed_path, {_ANOM} AS is_anomalous FROM paths""")
def graph_paths(spark, d):
    return _paths(spark, d).select("alert_id", "cse_id", "severity", "expected_path", "observed_path", "is_anomalous")


@query("graph_temporal_checks", "paths", """SELECT alert_id, coalesce(started_at < created_at, false) AS investigation_before_alert, coalesce(direct_opened_at < started_at, false) AS case_before_investigation,
 NOT coalesce(started_at < created_at, false) AND NOT coalesce(direct_opened_at < started_at, false) AS is_valid FROM paths""")
def graph_temporal_checks(spark, d):
    return G.temporal_checks(_paths(spark, d)).drop("cse_id")


@query("graph_anomalies", "anomalies", "SELECT anomaly_type, severity, source_node, cse_id, detail FROM anomalies")
def graph_anomalies(spark, d):
    return analysis(spark, d).anomalies.drop("evidence_type")


@query("graph_in_degrees", "nodes edges", "SELECT n.id, entity_type, count(e.dst) AS in_degree FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY 1, 2")
def graph_in_degrees(spark, d):
    run = analysis(spark, d)
    return G.in_degrees(run.nodes, run.edges)


@query("graph_analyst_shares", "shares", f"SELECT analyst_id, handled, total_handled::BIGINT AS total_handled, team_size, {r('share', 6)} AS share FROM shares")
def graph_analyst_shares(spark, d):
    return G.analyst_shares(estate(spark, d)).withColumn("share", S.rounded(F.col("share"), 6))


@query("graph_type_counts", "nodes edges", "SELECT 'node' AS kind, entity_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY 2")
def graph_type_counts(spark, d):
    run = analysis(spark, d)
    return G.type_counts(run.nodes, run.edges)


_M = lambda t: f"(SELECT count(*) FROM nodes WHERE entity_type = '{t}')"


@query("graph_export", "nodes", """SELECT id, to_json(struct_pack(canonical_record_id := canonical_record_id, criticality := criticality, cse_id := cse_id, entity_type := entity_type, id := id, status := status, timestamp := timestamp))::varchar AS document FROM nodes""")
def graph_export(spark, d):
    cols = ["canonical_record_id", "criticality", "cse_id", "entity_type", "id", "status", "timestamp"]
    return G.nodes(estate(spark, d)).select("id", S.canonical_json(F.struct(*cols)).alias("document"))


@query("graph_export_edges", "edges", """SELECT src, dst, to_json(struct_pack(dst := dst, relationship := relationship, src := src))::varchar AS document FROM edges""")
def graph_export_edges(spark, d):
    return analysis(spark, d).edges.select("src", "dst", S.canonical_json(F.struct("dst", "relationship", "src")).alias("document"))


_HOPS = 12
for _n in range(_HOPS):
    _from = "SELECT id, id AS label FROM nodes" if _n == 0 else f"SELECT * FROM comp{_n - 1}"
    cte(f"comp{_n}", f"nodes edges comp{_n - 1}" if _n else "nodes edges", f"""SELECT l.id, least(l.label, coalesce(min(o.label), l.label)) AS label FROM ({_from}) l
 LEFT JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) e ON e.a = l.id LEFT JOIN ({_from}) o ON o.id = e.b GROUP BY l.id, l.label""")


_LABELS = f"comp{_HOPS - 1}"  # the graph is shallow (every chain hangs off its entity), so SQL spreads labels over a fixed number of hops


@query("graph_metrics", f"nodes edges orphans {_LABELS}", f"""SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, {r(_M('ESCALATION') + ' / ' + _M('INVESTIGATION'), 4)} AS escalation_investigation_ratio,
 {r(_M('CLOSURE') + ' / ' + _M('CASE'), 4)} AS closure_case_ratio, (SELECT count(*) FROM orphans) AS orphan_nodes_count, {_M('MISSING_EXPECTED')} AS missing_expected_count, (SELECT count(DISTINCT label) FROM {_LABELS}) AS component_count""")
def graph_metrics(spark, d):
    run = analysis(spark, d)
    return G.metrics(run.nodes, run.edges, run.components)


@query("graph_components", _LABELS, f"SELECT label, count(*) AS members FROM {_LABELS} GROUP BY 1")
def graph_components(spark, d):
    return analysis(spark, d).components.groupBy("label").agg(F.count(F.lit(1)).alias("members"))


@query("graph_component_count", _LABELS, f"SELECT count(DISTINCT label) AS component_count, max(n) AS largest FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n FROM {_LABELS})")
def graph_component_count(spark, d):
    sizes = analysis(spark, d).components.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("component_count"), F.max("n").alias("largest"))


@query("graph_components_grown", _LABELS, f"SELECT id, label FROM {_LABELS}")
def graph_components_grown(spark, d):
    """Stored labels of the graph without its cases and closures, to which these are then merged."""
    run = analysis(spark, d)
    late = F.col("entity_type").isin("CASE", "CLOSURE")
    is_late = lambda end: F.col(end).startswith("CASE:") | F.col(end).startswith("CLOSURE:")
    of_late = is_late("src") | is_late("dst")
    stored = written(CC.labels(run.nodes.where(~late).select("id"), run.edges.where(~of_late)), "labels", scratch(spark, "components"))
    return CC.merge(stored, run.nodes.where(late).select("id"), run.edges.where(of_late))


@query("graph_subgraph", "nodes edges", """SELECT src, dst, relationship FROM edges WHERE src IN (SELECT id FROM nodes ORDER BY list_position(['CSE','ASSET','ANALYST','ALERT','INVESTIGATION','ESCALATION','CASE','CLOSURE','MISSING_EXPECTED'], entity_type), id LIMIT 40) AND dst IN (SELECT id FROM nodes ORDER BY list_position(['CSE','ASSET','ANALYST','ALERT','INVESTIGATION','ESCALATION','CASE','CLOSURE','MISSING_EXPECTED'], entity_type), id LIMIT 40)""")
def graph_subgraph(spark, d):
    run = analysis(spark, d)
    return G.induced(run.nodes, run.edges)[1].select("src", "dst", "relationship")


@query("graph_evaluation", "anomalies findings", """SELECT anomaly_type, count(*) AS n, 100.0::double AS traceability_pct, 3.0::double AS mean_depth FROM anomalies GROUP BY 1""")
def graph_evaluation(spark, d):
    run = analysis(spark, d)
    return V.graph_evaluation(run.anomalies, run.findings)
