"""The analysis job: findings, evidence, risk and queue of one run, stored so that a rerun replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators import evidence as E
from lacuna.plans.stages import AnalysisRun
from lacuna.sources import sinks as SK

ENGINES = ("gap", "negative_space")


def store_findings(findings: DataFrame, store: str, run_id: str, engine: str) -> None:
    """Replace the findings of one engine and their evidence; the other engine's rows stay as they are."""
    scope = {"analysis_run_id": run_id, "engine": engine}
    SK.replace_run(findings.drop("evidence"), f"{store}/findings", scope)
    SK.replace_run(E.evidence_rows(findings), f"{store}/evidence", scope)


def store_run(run: AnalysisRun, store: str, run_id: str) -> None:
    """Analyse and store everything of a run."""
    for engine, findings in zip(ENGINES, (run.gap_findings, run.negative_findings), strict=True):
        store_findings(findings, store, run_id, engine)
    SK.replace_run(run.risk, f"{store}/risk", {"analysis_run_id": run_id})
    SK.replace_run(run.queue, f"{store}/queue", {"analysis_run_id": run_id})


def stored(spark: SparkSession, store: str, table: str, run_id: str) -> DataFrame:
    """The current rows of a table of a run."""
    return SK.read_runs(spark, f"{store}/{table}").where(f"analysis_run_id = '{run_id}'")
