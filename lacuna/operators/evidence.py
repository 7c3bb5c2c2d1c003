"""Typed evidence per finding, completeness against the contract, packages and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna import params as P
from lacuna.functions import scalar as S
from lacuna.operators.workflow import missing_transitions
from lacuna.plans.lens import Estate

ITEM = "struct<evidence_type:string,source_table:string,source_record_id:string,evidence_timestamp:string,description:string,relevance:string,payload_json:string>"


def _item(kind: str, table: str, record: Column, when_: Column, description, relevance: str, payload: Column) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(F.lit(kind).alias("evidence_type"), F.lit(table).alias("source_table"),
                    record.cast("string").alias("source_record_id"), when_.cast("string").alias("evidence_timestamp"),
                    text.alias("description"), F.lit(relevance).alias("relevance"),
                    S.canonical_json(payload).alias("payload_json")).cast(ITEM)


def _quality_item(completeness: float, import_id: str) -> Column:
    payload = F.struct(F.lit(completeness).alias("completeness_score"), F.lit(completeness >= 95.0).alias("is_clean"))
    return _item("DATA_QUALITY", "dataset_imports", F.lit(import_id), F.lit(None),
                 f"Import completeness {completeness}%.", "HIGH", payload)


def _absence(expected: str, window: str) -> Column:
    return F.struct(F.lit(window).alias("expected_window"), F.lit(expected).alias("expected_evidence"))


def _keep(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def gap_kinds() -> Column:
    """Evidence types a workflow finding has, without building the evidence itself."""
    lost = ~F.col("has_investigation") | ((F.col("rule_id") == "GAP-01") & ~F.col("has_escalation"))
    return _keep(F.lit("DIRECT_RECORD"), F.when(lost, F.lit("MISSING_EXPECTED_RECORD")), F.lit("WORKFLOW_TRANSITION"), F.lit("DATA_QUALITY"))


def negative_kinds() -> Column:
    """Evidence types a negative-space finding has: the subject, its rule's own types, and data quality."""
    rule = F.col("rule_id")
    return _keep(F.lit("DIRECT_RECORD"), F.when(rule.isin("NEG-01", "NEG-03"), F.lit("MISSING_EXPECTED_RECORD")),
                 F.when(rule.isin("NEG-01", "NEG-05"), F.lit("CONTEXT_SUPPRESSION")), F.when(rule == "NEG-02", F.lit("HISTORICAL_BASELINE")),
                 F.when(rule == "NEG-04", F.lit("PEER_COMPARISON")), F.when(rule.isin("NEG-02", "NEG-04"), F.lit("STATISTICAL_DEVIATION")),
                 F.lit("DATA_QUALITY"))


def gap_items(completeness: float, import_id: str) -> Column:
    """Evidence of a workflow finding, in fixed order, as one array."""
    c = F.col
    alert = _item("DIRECT_RECORD", "alerts", c("alert_id"), S.iso(c("created_at")),
                  F.concat(F.lit("Alert "), c("alert_category"), F.lit(" "), c("alert_severity")), "CRITICAL",
                  F.struct(c("alert_category").alias("category"), c("alert_severity").alias("severity"), c("source_system")))
    asset = F.when(c("asset_name").isNotNull(), _item(
        "DIRECT_RECORD", "assets", c("asset_id"), F.lit(None), F.concat(F.lit("Asset "), c("asset_name")), "HIGH",
        F.struct("asset_type", c("asset_criticality").alias("criticality"), c("asset_name").alias("name"))))
    found = _item("DIRECT_RECORD", "investigations", c("investigation_id"), S.iso(c("started_at")),
                  F.concat(F.lit("Investigation of "), F.coalesce(c("duration_seconds").cast("string"), F.lit("?")), F.lit(" s")),
                  "HIGH", F.struct("analyst_id", "duration_seconds"))
    lost = _item("MISSING_EXPECTED_RECORD", "investigations", F.concat(F.lit("MISSING_INVESTIGATION_"), c("alert_id")),
                 F.lit(None), "No investigation exists for this alert.", "CRITICAL",
                 _absence("Investigation record", "30 minutes after the alert"))
    unescalated = F.when((c("rule_id") == "GAP-01") & ~c("has_escalation"), _item(
        "MISSING_EXPECTED_RECORD", "escalations", F.concat(F.lit("MISSING_ESCALATION_"), c("alert_id")), F.lit(None),
        "No escalation exists before closure.", "CRITICAL", _absence("Escalation record", "Before closure")))
    gaps = F.transform(missing_transitions(), lambda m: F.concat(m["from"], F.lit(">"), m["to"]))
    flow = _item("WORKFLOW_TRANSITION", "workflows", c("alert_id"), F.lit(None), "Reconstructed workflow.", "CRITICAL",
                 F.struct(F.array(*[F.lit(s) for s in P.EXPECTED_WORKFLOW]).alias("expected_sequence"),
                          gaps.alias("missing_transitions"), c("observed_sequence")))
    return _keep(alert, asset, F.when(c("has_investigation"), found).otherwise(lost), unescalated, flow,
                 _quality_item(completeness, import_id))


def negative_items(completeness: float, import_id: str, rules: list[str]) -> Column:
    """Evidence of negative-space findings; only the items of the given rules are built."""
    c, none = F.col, F.lit(None)
    by_rule = {
        "NEG-01": lambda: [
            _item("MISSING_EXPECTED_RECORD", "alerts", F.concat(F.lit("MISSING_TELEMETRY_"), c("asset_id")), none,
                  "Expected telemetry is absent.", "CRITICAL", _absence("Regular telemetry", "48 hours")),
            _item("CONTEXT_SUPPRESSION", "maintenance_logs", F.concat(F.lit("MAINT_CHECK_"), c("asset_id")), none,
                  "No maintenance or retirement explains the silence.", "HIGH",
                  F.struct(c("asset_status"), F.lit(False).alias("maintenance_overlap")))],
        "NEG-02": lambda: [
            _item("HISTORICAL_BASELINE", "baselines", F.concat(F.lit("BASELINE_30D_"), c("cse_id")), none, "Rolling volume baseline.", "HIGH",
                  F.struct(S.rounded(c("mean_daily"), 2).alias("mean_daily_volume"), c("recent_count"), S.rounded(c("std_daily"), 2).alias("std_dev"))),
            _item("STATISTICAL_DEVIATION", "baseline_deviations", F.concat(F.lit("DEV_NEG02_"), c("cse_id")), none,
                  "Measured volume drop.", "CRITICAL", F.struct("drop_pct", "z_score"))],
        "NEG-03": lambda: [
            _item("MISSING_EXPECTED_RECORD", "alerts", F.concat(F.lit("MISSING_CATEGORY_"), c("cse_id")), none,
                  "Mandatory category is absent.", "CRITICAL", F.struct("expected_category"))],
        "NEG-04": lambda: [
            _item("PEER_COMPARISON", "peer_groups", F.concat(F.lit("PEER_GROUP_"), c("cse_id")), none, "Peer alert density.", "HIGH",
                  F.struct("asset_type", c("peer_count").alias("peer_group_size"), c("peer_median").alias("peer_median_density"))),
            _item("STATISTICAL_DEVIATION", "peer_deviations", F.concat(F.lit("DEV_NEG04_"), c("asset_id")), none,
                  "Deviation from peers.", "CRITICAL", F.struct("density", "density_ratio"))],
        "NEG-05": lambda: [
            _item("CONTEXT_SUPPRESSION", "maintenance_logs", F.concat(F.lit("MAINT_AUDIT_"), c("asset_id")), none,
                  "Silence without maintenance record.", "CRITICAL", F.struct(c("maintenance_count").alias("maintenance_logs_count")))],
    }
    if rules[0] in ("NEG-02", "NEG-03"):
        subject = _item("DIRECT_RECORD", "cses", c("cse_id"), none, F.concat(F.lit("Entity "), c("cse_name")), "CRITICAL",
                        F.struct(c("cse_name").alias("name"), "sector", "size_tier"))
    else:
        subject = _item("DIRECT_RECORD", "assets", c("asset_id"), none, F.concat(F.lit("Asset "), c("asset_name")), "CRITICAL",
                        F.struct("asset_type", c("asset_criticality").alias("criticality"), c("asset_name").alias("name"), c("asset_status").alias("status")))
    own = [F.when(c("rule_id") == rule, item) for rule in rules for item in by_rule[rule]()]
    return _keep(subject, *own, _quality_item(completeness, import_id))


def required_types() -> Column:
    contract = F.create_map(*[x for rule, kinds in P.EVIDENCE_CONTRACT.items()
                              for x in (F.lit(rule), F.array(*[F.lit(k) for k in kinds]))])
    return F.coalesce(F.try_element_at(contract, F.col("rule_id")), F.array(*[F.lit(k) for k in P.DEFAULT_CONTRACT]))


def attach(findings: DataFrame, items: Column, kinds: Column) -> DataFrame:
    """Add the evidence array, score its types against the contract and scale the confidence.

    All narrow: a finding's evidence follows from its own row, so no join is needed. The score
    needs only the types, so a plan that drops the evidence column never builds it.
    """
    need = required_types()
    pct = S.rounded(F.size(F.array_intersect(need, kinds)) / F.size(need) * 100.0, 2)
    return (findings.withColumns({"evidence": items, "evidence_completeness": pct})
            .withColumn("confidence", F.when(F.col("evidence_completeness") < 100.0, S.rounded(
                F.col("confidence") * (F.col("evidence_completeness") / 100.0), 4)).otherwise(F.col("confidence"))))


def evidence_rows(findings: DataFrame, *carried: str) -> DataFrame:
    """One row per piece of evidence, with the ``carried`` columns of its finding."""
    rows = findings.select("finding_id", "rule_id", "analysis_run_id", *carried, F.posexplode("evidence").alias("position", "item"))
    return rows.select(
        S.key_hash(F.col("finding_id"), F.col("item.evidence_type"), F.col("item.source_table"),
                   F.col("item.source_record_id")).alias("evidence_id"),
        "finding_id", "rule_id", "analysis_run_id", "item.*", *carried)


def packages(findings: DataFrame, as_of: str, import_id: str) -> DataFrame:
    """One evidence package per finding. Evidence is already nested in the finding."""
    kinds = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["evidence_type"])))
    first_payload = lambda kind: F.try_element_at(F.transform(F.filter(
        "evidence", lambda e: e["evidence_type"] == kind), lambda e: e["payload_json"]), F.lit(1))
    return findings.select(
        "finding_id", "rule_id", "rule_version",
        F.when(F.col("rule_id").startswith("GAP"), "ExecutionGapEngine").otherwise("NegativeSpaceEngine").alias("engine"),
        "cse_id", "asset_id", "case_id", "severity", "confidence", "risk_score", "supervisory_priority",
        "evidence_completeness", (F.col("evidence_completeness") >= 100.0).alias("is_evidence_complete"),
        required_types().alias("required_evidence_types"), kinds.alias("present_evidence_types"),
        "expected_behaviour", "observed_behaviour", "recommendation", F.col("evidence").alias("supporting_records"),
        first_payload("WORKFLOW_TRANSITION").alias("workflow_difference"),
        first_payload("HISTORICAL_BASELINE").alias("baseline_stats"),
        first_payload("PEER_COMPARISON").alias("peer_stats"),
        first_payload("DATA_QUALITY").alias("data_quality"),
        F.lit(import_id).alias("dataset_import_id"), "analysis_run_id", F.to_timestamp(F.lit(as_of)).alias("assembled_at"))


def integrity(rows: DataFrame, est: Estate) -> DataFrame:
    """Per finding: hash over its evidence in id order and a count of vanished sources."""
    alerts = est.alerts.select(F.lit("alerts").alias("source_table"), F.col("id").alias("source_record_id"))
    assets = est.assets.select(F.lit("assets").alias("source_table"), F.col("id").alias("source_record_id"))
    gone = (rows.where((F.col("source_table").isin("alerts", "assets")))
            .join(alerts.unionByName(assets), ["source_table", "source_record_id"], "left_anti")
            .groupBy("finding_id").agg(F.count(F.lit(1)).alias("tampered_count")))
    line = F.concat_ws(":", "evidence_id", "evidence_type", "source_table", "source_record_id", "payload_json")
    # A finding has a handful of evidence rows by construction, so the list is bounded.
    hashed = rows.groupBy("finding_id", "rule_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", line.alias("line")))),
                                        lambda x: x["line"]), ""), 256).alias("sha256_hash"),
        F.count(F.lit(1)).alias("evidence_count"))
    return (hashed.join(gone, "finding_id", "left")
            .withColumn("tampered_count", F.coalesce("tampered_count", F.lit(0)).cast("long"))
            .withColumn("status", F.when(F.col("tampered_count") > 0, "INTEGRITY_COMPROMISED").otherwise("VERIFIED")))
