"""The analysis run: evaluations, findings and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lacuna.operators import evidence, gap_rules, negative_space
from lacuna.operators.evaluations import VERDICT_FIELDS, to_findings
from lacuna.operators.workflow import workflow
from lacuna.params import RULES, RuleParams
from lacuna.plans.lens import Estate

FINDING_COLUMNS = [
    "finding_id", "analysis_run_id", "rule_id", "rule_version", "target_type", "target_id", "qualifier", "cse_id",
    "asset_id", "case_id", "alert_id", "investigation_id", "severity", "anomaly_score", "confidence", "risk_score",
    "supervisory_priority", "evidence_completeness", "reason", "expected_behaviour", "observed_behaviour",
    "evidence_refs", "recommendation", "status", "found_at", "evidence"]
_REF = "array<struct<source_table:string,source_record_id:string,description:string>>"


def _finish(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    none = F.lit(None).cast("string")
    return df.select(*[F.col(c).cast(_REF).alias(c) if c == "evidence_refs" else F.col(c) if c in have else none.alias(c) for c in FINDING_COLUMNS])


def gap_findings(est: Estate, params: RuleParams = RULES) -> DataFrame:
    flow = workflow(est, params, gap_rules.gap_hit(est.completeness, params), gap_rules.gap_may(params))
    rows = gap_rules.gap_evaluations(flow, est.completeness, params)
    hits = to_findings(rows, est.run_id, est.as_of)
    return _finish(evidence.attach(hits, evidence.gap_items(est.completeness, est.import_id), evidence.gap_kinds()))


def _subject_ref(table: str, id_col: str, name_col: str):
    return F.array(F.struct(F.lit(table).alias("source_table"), F.col(id_col).alias("source_record_id"), F.col(name_col).alias("description")))


def negative_findings(est: Estate, params: RuleParams = RULES) -> DataFrame:
    parts = [(negative_space.asset_evaluations(est, params), ["NEG-01", "NEG-04", "NEG-05"], _subject_ref("assets", "asset_id", "asset_name")),
             (negative_space.entity_evaluations(est, params), ["NEG-02"], _subject_ref("cses", "cse_id", "cse_name")),
             (negative_space.category_evaluations(est, params), ["NEG-03"], _subject_ref("cses", "cse_id", "cse_name"))]
    out = None
    for rows, rules, ref in parts:
        hits = to_findings(rows, est.run_id, est.as_of).withColumn("evidence_refs", ref)
        items = evidence.negative_items(est.completeness, est.import_id, rules)
        part = _finish(evidence.attach(hits, items, evidence.negative_kinds()))
        out = part if out is None else out.unionByName(part)
    return out


def findings(est: Estate, params: RuleParams = RULES) -> DataFrame:
    """All findings of one run: workflow gaps and negative space."""
    return gap_findings(est, params).unionByName(negative_findings(est, params))


def all_evaluations(est: Estate, params: RuleParams = RULES) -> DataFrame:
    """Every verdict, not only the findings."""
    parts = [gap_rules.gap_evaluations(workflow(est, params), est.completeness, params),
             negative_space.asset_evaluations(est, params), negative_space.entity_evaluations(est, params),
             negative_space.category_evaluations(est, params)]
    out = parts[0].select(*VERDICT_FIELDS, "cse_id")
    for p in parts[1:]:
        out = out.unionByName(p.select(*VERDICT_FIELDS, "cse_id"))
    return out


def analysis_run(est: Estate, found: DataFrame) -> DataFrame:
    """One provenance row for the run."""
    n_found = found.agg(F.count(F.lit(1))).scalar()
    return est.alerts.agg(F.count(F.lit(1)).alias("records_processed")).withColumn("findings_generated", n_found).select(
        F.lit(est.run_id).alias("analysis_run_id"), F.lit(est.import_id).alias("dataset_import_id"),
        F.lit("COMPLETED").alias("status"), F.lit("1.0.0").alias("rule_version"), F.lit("1.0.0").alias("model_version"),
        "records_processed", "findings_generated")
