"""Report and snapshot queries, for all entities at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.digest import multiset_digest, row_hash
from lacuna.operators import evidence as E
from lacuna.operators import reports as RP
from lacuna.params import RULE_REGISTER
from lacuna.plans.ctes import RUN_SQL, cte, key, r
from lacuna.plans.lens import AS_OF
from lacuna.plans.q_intel import enriched, technique_map
from lacuna.plans.registry import query
from lacuna.plans import analysis_job as AJ
from lacuna.plans.stages import analysis, scratch, written

cte("sev_counts", "findings", """SELECT cse_id, count(*) AS total_findings, count(*) FILTER (severity = 'CRITICAL') AS critical_findings, count(*) FILTER (severity = 'HIGH') AS high_findings,
 count(*) FILTER (severity NOT IN ('CRITICAL','HIGH','LOW')) AS medium_findings, count(*) FILTER (severity = 'LOW') AS low_findings FROM findings GROUP BY 1""")
cte("executive", "entities risk sev_counts enriched", """SELECT *, CASE WHEN critical_findings >= 5 OR normalized_score >= 80 THEN 'CRITICAL' WHEN critical_findings >= 2 OR normalized_score >= 60 THEN 'HIGH' WHEN critical_findings >= 1 OR normalized_score >= 40 THEN 'ELEVATED'
 WHEN normalized_score >= 20 THEN 'MODERATE' ELSE 'NOMINAL' END AS posture FROM (SELECT e.id AS cse_id, e.name, e.sector, k.normalized_score, k.risk_band, k.overall_confidence, coalesce(total_findings, 0) AS total_findings, coalesce(critical_findings, 0) AS critical_findings,
 coalesce(high_findings, 0) AS high_findings, coalesce(medium_findings, 0) AS medium_findings, coalesce(low_findings, 0) AS low_findings, coalesce(na, 0) AS assets_assessed, coalesce(nk, 0) AS kev_exposures FROM entities e LEFT JOIN risk k ON k.cse_id = e.id
 LEFT JOIN sev_counts s ON s.cse_id = e.id LEFT JOIN (SELECT cse_id, count(*) AS na, count(*) FILTER (is_kev) AS nk FROM enriched GROUP BY 1) a ON a.cse_id = e.id)""")


def _executive(spark, d):
    run = analysis(spark, d)
    return RP.executive_summary(run.estate.entities, run.findings, run.risk, enriched(spark, d))


@query("report_executive", "executive", "SELECT * FROM executive")
def report_executive(spark, d):
    return _executive(spark, d)


@query("report_top_gaps", "findings technique_map", """SELECT cse_id, CAST(place AS INT) AS place, finding_id, f.rule_id, severity, supervisory_priority, technique_id FROM (SELECT *, row_number() OVER (PARTITION BY cse_id ORDER BY supervisory_priority DESC, finding_id) AS place FROM findings) f
 LEFT JOIN technique_map t ON t.rule_id = f.rule_id WHERE place <= 5""")
def report_top_gaps(spark, d):
    return RP.top_gaps(analysis(spark, d).findings, technique_map(spark, d)).select("cse_id", "place", "finding_id", "rule_id", "severity", "supervisory_priority", "technique_id")


@query("report_kev_exposures", "enriched", "SELECT cse_id, id AS asset_id, name AS asset_name, asset_type, primary_cve AS cve_id, cvss_base_score, threat_group FROM enriched WHERE is_kev")
def report_kev_exposures(spark, d):
    return RP.kev_exposures(enriched(spark, d))


cte("ev_counts", "evidence", "SELECT finding_id, count(*) AS evidence_records FROM evidence GROUP BY 1")
cte("technical", "findings enriched technique_map ev_counts", """SELECT f.finding_id, f.rule_id, f.cse_id, f.severity, f.confidence, f.supervisory_priority, f.evidence_completeness, a.name AS asset_name, a.asset_type, technique_id, primary_cve AS cve_id, is_kev, evidence_records
 FROM findings f LEFT JOIN enriched a ON a.id = f.asset_id LEFT JOIN technique_map t ON t.rule_id = f.rule_id JOIN ev_counts e ON e.finding_id = f.finding_id""")


def _technical(spark, d):
    return RP.technical_findings(analysis(spark, d).findings, enriched(spark, d), technique_map(spark, d))


@query("report_technical", "technical", "SELECT * FROM technical")
def report_technical(spark, d):
    return _technical(spark, d).select("finding_id", "rule_id", "cse_id", "severity", "confidence", "supervisory_priority", "evidence_completeness", "asset_name", "asset_type", "technique_id", "cve_id", "is_kev", "evidence_records")


@query("report_technical_summary", "technical sev_counts", "SELECT s.*, n::BIGINT AS total_evidence_records FROM sev_counts s JOIN (SELECT cse_id, sum(evidence_records) AS n FROM technical GROUP BY 1) t ON t.cse_id = s.cse_id")
def report_technical_summary(spark, d):
    return RP.technical_summary(_technical(spark, d))


@query("report_risk_components", "risk", " UNION ALL ".join(f"SELECT cse_id, '{label}' AS component, {label[3:]} AS score FROM risk" for label in RP.COMPONENT_LABELS))
def report_risk_components(spark, d):
    return RP.risk_components(analysis(spark, d).risk)


cte("asset_risk", "enriched", "SELECT cse_id, id AS asset_id, asset_type, criticality, is_kev, primary_cve AS cve_id, least(100.0::double, 20.0::double + CASE criticality WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 15 ELSE 0 END + CASE WHEN is_kev THEN 40 ELSE 0 END) AS asset_risk FROM enriched")


@query("report_risk_assets", "asset_risk", "SELECT * FROM asset_risk")
def report_risk_assets(spark, d):
    return RP.asset_risk(enriched(spark, d))


@query("report_risk_summary", "risk asset_risk", f"""SELECT k.cse_id, normalized_score, raw_score, risk_band, {r('overall_confidence', 2)} AS confidence, CASE greatest(execution_gap, negative_space, peer_deviation, investigation_anomaly, asset_criticality) WHEN execution_gap THEN 'execution_gap' WHEN negative_space THEN 'negative_space'
 WHEN peer_deviation THEN 'peer_deviation' WHEN investigation_anomaly THEN 'investigation_anomaly' ELSE 'asset_criticality' END AS highest_risk_component, coalesce(nh, 0) AS high_risk_assets FROM risk k LEFT JOIN (SELECT cse_id, count(*) FILTER (asset_risk >= 70) AS nh FROM asset_risk GROUP BY 1) a ON a.cse_id = k.cse_id""")
def report_risk_summary(spark, d):
    return RP.risk_summary(analysis(spark, d).risk, enriched(spark, d))


@query("report_assets", "enriched findings", """SELECT e.cse_id, e.id AS asset_id, e.name, e.asset_type, e.criticality, e.status, primary_cve AS cve_id, is_kev, coalesce(n, 0) AS findings_count, top_priority FROM enriched e
 LEFT JOIN (SELECT asset_id, count(*) AS n, max(supervisory_priority) AS top_priority FROM findings WHERE asset_id IS NOT NULL GROUP BY 1) f ON f.asset_id = e.id""")
def report_assets(spark, d):
    return RP.asset_report(enriched(spark, d), analysis(spark, d).findings).select("cse_id", "asset_id", "name", "asset_type", "criticality", "status", "cve_id", "is_kev", "findings_count", "top_priority")


@query("report_cve_inventory", "enriched", "SELECT primary_cve AS cve_id, string_agg(DISTINCT asset_type, ',' ORDER BY asset_type) AS asset_types, arg_min(name, id) AS sample_asset, max(cvss_base_score) AS cvss_base_score, bool_or(is_kev) AS is_kev, count(*) AS affected_assets FROM enriched WHERE primary_cve IS NOT NULL GROUP BY 1")
def report_cve_inventory(spark, d):
    return RP.cve_inventory(enriched(spark, d)).withColumn("asset_types", F.array_join("asset_types", ","))


cte("coverage", "findings technique_map", "SELECT technique_id, technique_name, min(f.rule_id) AS associated_rule, CASE WHEN technique_id IN ('T1562.002','T1070.001') THEN 'DIRECT' ELSE 'SUPPORTED_INFERENCE' END AS mapping_type FROM (SELECT DISTINCT rule_id FROM findings) f JOIN technique_map t ON t.rule_id = f.rule_id GROUP BY 1, 2")


@query("report_technique_coverage", "coverage", "SELECT * FROM coverage")
def report_technique_coverage(spark, d):
    return RP.technique_coverage(analysis(spark, d).findings, technique_map(spark, d))


@query("report_threat_summary", "enriched coverage", "SELECT count(DISTINCT primary_cve) AS total_cves_mapped, count(DISTINCT primary_cve) FILTER (is_kev) AS kev_cves, (SELECT count(*) FROM coverage) AS attack_techniques_identified, count(DISTINCT threat_group) FILTER (primary_cve IS NOT NULL) AS threat_groups_associated FROM enriched")
def report_threat_summary(spark, d):
    return RP.threat_summary(enriched(spark, d), analysis(spark, d).findings, technique_map(spark, d))


_FIELDS = sorted("name sector normalized_score risk_band overall_confidence total_findings critical_findings high_findings medium_findings low_findings assets_assessed kev_exposures posture".split())
_PACK = "struct_pack(" + ", ".join(f"{f} := {f}" for f in _FIELDS) + ")"
cte("snapshots", "executive", f"""SELECT *, sha256(content_json) AS sha256_checksum, {key(RUN_SQL, "'EXECUTIVE'", 'cse_id')} AS report_id, total_findings FROM (SELECT *, to_json({_PACK})::varchar AS summary_json,
 to_json(struct_pack(analysis_run_id := {RUN_SQL}, cse_id := cse_id, summary := {_PACK}))::varchar AS content_json FROM executive)""")


def _snapshots(spark, d):
    run = analysis(spark, d)
    return RP.snapshots(_executive(spark, d), "EXECUTIVE", run.estate.run_id, AS_OF)


@query("report_snapshots", "snapshots", f"SELECT report_id, cse_id, content_json, sha256_checksum, 'REP-20240131-' || upper(substr(report_id, 1, 8)) AS report_number FROM snapshots")
def report_snapshots(spark, d):
    return _snapshots(spark, d).select("report_id", "cse_id", "content_json", "sha256_checksum", "report_number")


@query("report_snapshot_check", "snapshots", "SELECT report_id, cse_id, critical_findings > 0 AS is_tampered FROM snapshots")
def report_snapshot_check(spark, d):
    """Documents of entities with critical findings are altered after signing; exactly those must be flagged."""
    text = F.regexp_replace("content_json", '"critical_findings":[1-9][0-9]*', '"critical_findings":0')
    return RP.verify_snapshots(_snapshots(spark, d).withColumn("content_json", text)).select("report_id", "cse_id", "is_tampered")


#: The tables each kind of report shows, beside the findings, evidence and assets that all of them stand on.
COMMON = ["findings", "evidence", "assets"]
OWN_TABLES = {"EXECUTIVE": ["top_gaps", "kev_exposures"], "TECHNICAL": ["technical"], "RISK": ["risk_components", "asset_risk"], "ASSET": ["asset_report", "cve_inventory"], "THREAT": ["cve_inventory", "technique_coverage"]}


def _tables(spark, d, findings, evidence, context=None):
    """Whole rows of every table that a report shows, with a cse_id. A table over all entities counts for each of them, by its digest."""
    run, (assets, mapping) = analysis(spark, d), context or _context(spark, d)
    ids = run.estate.entities.select(F.col("id").alias("cse_id"))

    def shared(df):
        cols = [F.to_json(F.struct(c)) if t.startswith("array") else F.col(c) for c, t in sorted(df.dtypes)]
        return ids.crossJoin(multiset_digest(df.select(row_hash(*cols).alias("row_hash"))))  # one row
    return {"findings": findings.drop("evidence"), "evidence": evidence, "assets": run.estate.assets, "top_gaps": RP.top_gaps(findings, mapping).drop("evidence"),
            "kev_exposures": RP.kev_exposures(assets), "technical": RP.technical_findings(findings, assets, mapping).drop("evidence"), "risk_components": RP.risk_components(run.risk),
            "asset_risk": RP.asset_risk(assets), "asset_report": RP.asset_report(assets, findings), "cve_inventory": shared(RP.cve_inventory(assets)),
            "technique_coverage": shared(RP.technique_coverage(findings, mapping))}


def _context(spark, d):
    """Assets with their threats, and the techniques of the rules."""
    return enriched(spark, d), technique_map(spark, d)


def _evidence(findings):
    """All columns of the evidence, with the entity of its finding."""
    return E.evidence_rows(findings, "cse_id")


def _summaries(spark, d, context=None):
    """The own report of each kind, a row per entity."""
    run, (assets, mapping) = analysis(spark, d), context or _context(spark, d)
    ids = run.estate.entities.select(F.col("id").alias("cse_id"))
    per_asset = RP.asset_report(assets, run.findings).groupBy("cse_id").agg(F.count(F.lit(1)).alias("assets"), F.sum("findings_count").alias("findings_count"), F.max("top_priority").alias("top_priority"), F.count_if("is_kev").alias("kev_assets"))
    executive = RP.executive_summary(run.estate.entities, run.findings, run.risk, assets)
    technical = RP.technical_summary(RP.technical_findings(run.findings, assets, mapping))
    return {"EXECUTIVE": executive, "TECHNICAL": ids.join(technical, "cse_id", "left"), "RISK": ids.join(RP.risk_summary(run.risk, assets), "cse_id", "left"),
            "ASSET": ids.join(per_asset, "cse_id", "left"), "THREAT": ids.crossJoin(RP.threat_summary(assets, run.findings, mapping))}


def _altered(spark, d, findings, evidence):
    """(cse_id, part, kind): all five kinds are signed with their tables; what is found changed once findings and evidence are the given ones.

    The context is worked out once for all tables and summaries."""
    run, place = analysis(spark, d), scratch(spark, "reports")
    context = [written(df, name, place) for df, name in zip(_context(spark, d), ("assets", "mapping"), strict=True)]
    then = written(RP.bound_tables(_tables(spark, d, run.findings, _evidence(run.findings), context)), "then", place)
    now = written(RP.bound_tables(_tables(spark, d, findings, evidence, context)), "now", place)
    found = None
    for kind, summary in _summaries(spark, d, context).items():
        mine = F.col("part").isin(*COMMON, *OWN_TABLES[kind])
        signed = written(RP.snapshots(summary, kind, run.estate.run_id, AS_OF, then.where(mine)), f"signed_{kind}", place)
        one = RP.changed_parts(signed, now.where(mine)).withColumn("kind", F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return found


def _in_all(found):
    return found.groupBy("cse_id", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(OWN_TABLES)).drop("n")


@query("report_altered_parts", "findings", "SELECT cse_id, 'findings' AS part FROM findings WHERE finding_id = (SELECT min(finding_id) FROM findings)")
def report_altered_parts(spark, d):
    """All five reports are signed with their tables; one finding is altered afterwards. Exactly its entity's findings are flagged, in each."""
    run = analysis(spark, d)
    victim = run.findings.agg(F.min("finding_id")).scalar()
    altered = run.findings.withColumn("status", F.when(F.col("finding_id") == victim, "ALTERED").otherwise(F.col("status")))
    return _in_all(_altered(spark, d, altered, _evidence(run.findings)))


@query("report_altered_evidence", "findings", "SELECT cse_id, 'evidence' AS part FROM findings WHERE finding_id = (SELECT min(finding_id) FROM findings)")
def report_altered_evidence(spark, d):
    """As report_altered_parts, but what is altered is the payload of one finding's evidence."""
    run = analysis(spark, d)
    victim = run.findings.agg(F.min("finding_id")).scalar()
    altered = _evidence(run.findings).withColumn("payload_json", F.when(F.col("finding_id") == victim, "{}").otherwise(F.col("payload_json")))
    return _in_all(_altered(spark, d, run.findings, altered))


@query("analysis_rerun", "findings", "SELECT CASE WHEN rule_id LIKE 'GAP-%' THEN 'gap' ELSE 'negative_space' END AS engine, rule_id, count(*) AS n FROM findings WHERE rule_id NOT LIKE 'GAP-%' GROUP BY 1, 2")
def analysis_rerun(spark, d):
    """A run is stored, stored again, and its gap rules rerun without a finding: the other engine's findings are there once."""
    run, store = analysis(spark, d), scratch(spark, "store")
    for _ in range(2):
        AJ.store_run(run, store, "RUN-1")
    AJ.store_findings(run.gap_findings.limit(0), store, "RUN-1", "gap")
    return AJ.stored(spark, store, "findings", "RUN-1").groupBy("engine", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("report_search", "snapshots", "SELECT report_id, cse_id FROM snapshots WHERE cse_id = 'CSE-7'")
def report_search(spark, d):
    return RP.search(_snapshots(spark, d), "RUN-1", "CSE-7", "EXECUTIVE").select("report_id", "cse_id")


@query("report_export", "snapshots", """SELECT report_id, to_json(struct_pack(content := content_json, export_version := '1.0.0', report_id := report_id, report_number := 'REP-20240131-' || upper(substr(report_id, 1, 8)), report_type := 'EXECUTIVE',
 sha256_checksum := sha256_checksum, summary := summary_json))::varchar AS document FROM snapshots""")
def report_export(spark, d):
    return RP.export_envelope(_snapshots(spark, d))


@query("report_evidence_references", "evidence findings snapshots", "SELECT report_id, e.finding_id, evidence_id, evidence_type, source_table, source_record_id FROM evidence e JOIN findings f ON f.finding_id = e.finding_id JOIN snapshots s ON s.cse_id = f.cse_id")
def report_evidence_references(spark, d):
    run = analysis(spark, d)
    return RP.evidence_references(_snapshots(spark, d), E.evidence_rows(run.findings), run.findings).drop("relevance")


_REG = ", ".join(f"('{a}', '{b}', '{c}', '{e}', '{f}', {g}::double)" for a, b, c, e, f, g in RULE_REGISTER)


@query("rule_register_hits", "findings", f"SELECT reg.rule_id, version, severity, base_risk, coalesce(n, 0) AS findings_count FROM (VALUES {_REG}) reg(rule_id, version, name, family, severity, base_risk) LEFT JOIN (SELECT rule_id, count(*) AS n FROM findings GROUP BY 1) f ON f.rule_id = reg.rule_id")
def rule_register_hits(spark, d):
    reg = spark.createDataFrame(RULE_REGISTER, "rule_id string, version string, name string, family string, severity string, base_risk double")
    n = analysis(spark, d).findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings_count"))
    return reg.select("rule_id", "version", "severity", "base_risk").join(n, "rule_id", "left").fillna(0, ["findings_count"])
