"""Report tables and signed snapshots.

A report is a set of tables plus one small JSON document per entity. Long lists (findings,
assets, evidence) stay tables and are bound to the document by row count and digest, so a
report never has to be assembled in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lacuna.functions import scalar as S
from lacuna.functions.digest import group_digest, row_hash
from lacuna.operators import risk as R


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per entity and severity; an unknown severity counts as MEDIUM."""
    s = F.col("severity")
    known = s.isin("CRITICAL", "HIGH", "MEDIUM", "LOW")
    return findings.groupBy("cse_id").agg(
        F.count(F.lit(1)).alias("total_findings"), S.count_where(s == "CRITICAL").alias("critical_findings"), S.count_where(s == "HIGH").alias("high_findings"),
        S.count_where((s == "MEDIUM") | ~known).alias("medium_findings"), S.count_where(s == "LOW").alias("low_findings"))


def executive_summary(entities: DataFrame, findings: DataFrame, risk: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per entity: posture, score, severity counts and exposure. ``assets`` carries is_kev."""
    per_asset = assets.groupBy("cse_id").agg(F.count(F.lit(1)).alias("assets_assessed"), S.count_where(F.col("is_kev")).alias("kev_exposures"))
    rows = (entities.select(F.col("id").alias("cse_id"), "name", "sector").join(risk.select("cse_id", "normalized_score", "risk_band", "overall_confidence"), "cse_id", "left")
            .join(severity_counts(findings), "cse_id", "left").join(per_asset, "cse_id", "left")
            .fillna(0).fillna({"risk_band": "LOW"}))
    return rows.withColumn("posture", S.posture(F.col("normalized_score"), F.col("critical_findings")))


def top_gaps(findings: DataFrame, mapping: DataFrame, limit: int = 5) -> DataFrame:
    """The findings of highest priority per entity, with their technique. The literal rank filter prunes per task."""
    order = Window.partitionBy("cse_id").orderBy(F.desc("supervisory_priority"), F.asc("finding_id"))
    top = findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return top.join(mapping.select("rule_id", "technique_id"), "rule_id", "left")


def kev_exposures(assets: DataFrame) -> DataFrame:
    return assets.where("is_kev").select("cse_id", F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), "asset_type", F.col("primary_cve").alias("cve_id"), "cvss_base_score", "threat_group")


def technical_findings(findings: DataFrame, assets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every finding with its asset, technique and vulnerability context; evidence is nested and bounded."""
    own = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), "asset_type", "criticality", F.col("primary_cve").alias("cve_id"), "cvss_base_score", "is_kev")
    return (findings.join(own, "asset_id", "left").join(mapping.select("rule_id", "technique_id", "technique_name"), "rule_id", "left")
            .withColumn("evidence_records", F.size("evidence").cast("long")))


def technical_summary(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("cse_id").agg(F.sum("evidence_records").alias("total_evidence_records"))
    return severity_counts(rows).join(sums, "cse_id")


# --- fixed values: what each risk component stands for in the report -------------------------
COMPONENT_LABELS = ["R1_execution_gap", "R2_negative_space", "R3_peer_deviation", "R4_investigation_anomaly", "R5_asset_criticality"]


def risk_components(risk: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(label).alias("component"), S.rounded(F.col(c), 2).alias("score")) for label, c in zip(COMPONENT_LABELS, R.COMPONENTS)])
    return risk.select("cse_id", F.explode(pairs).alias("p")).select("cse_id", "p.*")


def asset_risk(assets: DataFrame) -> DataFrame:
    """Simple exposure score per asset, highest first."""
    level = F.col("criticality")
    score = F.lit(20.0) + F.when(level == "CRITICAL", 30.0).when(level == "HIGH", 15.0).otherwise(0.0) + F.when(F.col("is_kev"), 40.0).otherwise(0.0)
    return (assets.select("cse_id", F.col("id").alias("asset_id"), "asset_type", "criticality", "is_kev", F.col("primary_cve").alias("cve_id"),
                          F.least(S.rounded(score, 2), F.lit(100.0)).alias("asset_risk")).orderBy(F.desc("asset_risk"), F.asc("asset_id")))


def risk_summary(risk: DataFrame, assets: DataFrame) -> DataFrame:
    high = asset_risk(assets).groupBy("cse_id").agg(S.count_where(F.col("asset_risk") >= 70.0).alias("high_risk_assets"))
    return R.highest_component(risk).select("cse_id", "normalized_score", "raw_score", "risk_band", S.rounded(F.col("overall_confidence"), 2).alias("confidence"), "highest_risk_component") \
        .join(high, "cse_id", "left").fillna(0, ["high_risk_assets"])


def asset_report(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Inventory with finding counts; the findings themselves are in the technical table."""
    n = findings.where("asset_id is not null").groupBy("asset_id").agg(F.count(F.lit(1)).alias("findings_count"), F.max("supervisory_priority").alias("top_priority"))
    own = assets.select("cse_id", F.col("id").alias("asset_id"), "name", "asset_type", "criticality", "status", F.col("primary_cve").alias("cve_id"), "cvss_base_score", "is_kev", "threat_group")
    return own.join(n, "asset_id", "left").fillna(0, ["findings_count"])


def cve_inventory(assets: DataFrame) -> DataFrame:
    """Per CVE: affected asset types, a sample asset and the exposure flags."""
    return assets.where("primary_cve is not null").groupBy(F.col("primary_cve").alias("cve_id")).agg(
        F.array_sort(F.collect_set("asset_type")).alias("asset_types"), F.min_by("name", "id").alias("sample_asset"), F.max("cvss_base_score").alias("cvss_base_score"),
        F.bool_or("is_kev").alias("is_kev"), F.count(F.lit(1)).alias("affected_assets"))


def technique_coverage(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Techniques the findings point to, each with its first rule."""
    rules = findings.select("rule_id").distinct()
    return (rules.join(mapping, "rule_id").groupBy("technique_id", "technique_name").agg(F.min("rule_id").alias("associated_rule"))
            .withColumn("mapping_type", F.when(F.col("technique_id").isin("T1562.002", "T1070.001"), "DIRECT").otherwise("SUPPORTED_INFERENCE")))


def threat_summary(assets: DataFrame, findings: DataFrame, mapping: DataFrame) -> DataFrame:
    cves = cve_inventory(assets)
    return cves.agg(F.count(F.lit(1)).alias("total_cves_mapped"), S.count_where(F.col("is_kev")).alias("kev_cves")).fillna(0) \
        .withColumn("attack_techniques_identified", technique_coverage(findings, mapping).agg(F.count(F.lit(1))).scalar()) \
        .withColumn("threat_groups_associated", assets.where("primary_cve is not null").agg(F.countDistinct("threat_group")).scalar())


def bound_tables(parts: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """(cse_id, part, row_count, digest): what a report binds of its long tables, each with a cse_id, per entity.

    The digest is that of the bag of rows, so order and partitioning don't matter and no list is gathered. A table of this
    shape is returned as it is."""
    if isinstance(parts, DataFrame):
        return parts
    out = None
    for name, df in parts.items():
        cols = [F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in sorted(df.columns)]
        d = group_digest(df.select("cse_id", row_hash(*cols).alias("row_hash")), "cse_id").select("cse_id", F.lit(name).alias("part"), "row_count", "digest")
        out = d if out is None else out.unionByName(d)
    return out


def snapshots(summary: DataFrame, report_type: str, run_id: str, as_of: str, parts: dict[str, DataFrame] | DataFrame | None = None) -> DataFrame:
    """One signed document per row of a report table; the checksum covers the canonical content.

    ``parts`` are the report's long tables; their row counts and digests per entity are part of the signed content."""
    fields = sorted(c for c in summary.columns if c != "cse_id")
    body = [F.lit(run_id).alias("analysis_run_id"), F.col("cse_id")]
    if parts is not None:
        bound = bound_tables(parts).groupBy("cse_id").agg(F.array_sort(F.collect_list(F.struct("part", "row_count", "digest"))).alias("parts"))  # one entry per part
        summary = summary.join(bound, "cse_id", "left")
        body.append(F.coalesce("parts", F.array().cast("array<struct<part:string,row_count:long,digest:string>>")).alias("parts"))
    content = S.canonical_json(F.struct(*body, F.struct(*fields).alias("summary")))
    return (summary.select("cse_id", content.alias("content_json"), S.canonical_json(F.struct(*fields)).alias("summary_json"))
            .withColumn("sha256_checksum", F.sha2("content_json", 256))
            .withColumn("report_id", S.key_hash(F.lit(run_id), F.lit(report_type), F.col("cse_id")))
            .withColumn("report_number", F.concat(F.lit("REP-"), F.date_format(F.to_timestamp(F.lit(as_of)), "yyyyMMdd"), F.lit("-"), F.upper(F.substring("report_id", 1, 8))))
            .withColumn("report_type", F.lit(report_type)).withColumn("analysis_run_id", F.lit(run_id)).withColumn("status", F.lit("COMPLETED")))


def verify_snapshots(stored: DataFrame) -> DataFrame:
    """Recompute every checksum and flag the documents that changed."""
    return stored.withColumn("is_tampered", F.sha2("content_json", 256) != F.col("sha256_checksum"))


def changed_parts(stored: DataFrame, parts: dict[str, DataFrame] | DataFrame) -> DataFrame:
    """(cse_id, part) of every signed part whose table is no longer what was signed, vanished rows included."""
    shape = "parts array<struct<part:string,row_count:long,digest:string>>"
    signed = stored.select("cse_id", F.explode(F.from_json("content_json", shape)["parts"]).alias("p")).select("cse_id", "p.*")
    now = bound_tables(parts).withColumnRenamed("digest", "found").drop("row_count")
    both = signed.join(now, ["cse_id", "part"], "full").join(stored.select("cse_id"), "cse_id", "left_semi")
    return both.where(~F.col("digest").eqNullSafe(F.col("found"))).select("cse_id", "part")


def evidence_references(report: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence rows that a report stands on: those of its entity's findings."""
    owner = findings.select("finding_id", "cse_id")
    return evidence.join(owner, "finding_id").join(report.select("report_id", "cse_id"), "cse_id").select(
        "report_id", "finding_id", "evidence_id", "evidence_type", "source_table", "source_record_id", "relevance")


def search(reports: DataFrame, run_id: str | None = None, cse_id: str | None = None, report_type: str | None = None) -> DataFrame:
    out = reports
    for name, value in (("analysis_run_id", run_id), ("cse_id", cse_id), ("report_type", report_type)):
        if value:
            out = out.where(F.col(name) == value)
    return out


def export_envelope(stored: DataFrame) -> DataFrame:
    """Export document per report, keys in alphabetical order."""
    return stored.select("report_id", S.canonical_json(F.struct(
        F.col("content_json").alias("content"), F.lit("1.0.0").alias("export_version"), "report_id", "report_number", "report_type", "sha256_checksum",
        F.col("summary_json").alias("summary"))).alias("document"))
