"""One analysis run over one folder, stage by stage.

Later stages (risk, queue, graph, reports, evaluation) all start from the findings, so
each stage is written once as a Parquet table under the shared checkpoint folder and read back. That
cuts the lineage, survives lost executors, and gives the next stage column pruning and
real table sizes instead of a replay of everything before it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators import components as CC
from lacuna.operators import findings as FD
from lacuna.operators import graph as G
from lacuna.operators import review_queue as Q
from lacuna.operators import risk as R
from lacuna.plans.lens import LensEstate
from lacuna.session import scratch, written


class StoredEstate(LensEstate):
    """Canonical tables written once and scanned from then on, as after an import."""

    def __init__(self, spark: SparkSession, folder: str, root: str):
        super().__init__(spark, folder)
        self.root = root

    def _stored(self, name: str) -> DataFrame:
        return written(getattr(super(), name), name, self.root)

    first_lines = cached_property(lambda self: self._stored("first_lines"))  # three tables are read from it
    case_rows = cached_property(lambda self: self._stored("case_rows"))  # and two from this
    entities = cached_property(lambda self: self._stored("entities"))
    assets = cached_property(lambda self: self._stored("assets"))
    analysts = cached_property(lambda self: self._stored("analysts"))
    alerts = cached_property(lambda self: self._stored("alerts"))
    investigations = cached_property(lambda self: self._stored("investigations"))
    escalations = cached_property(lambda self: self._stored("escalations"))
    cases = cached_property(lambda self: self._stored("cases"))
    closures = cached_property(lambda self: self._stored("closures"))
    maintenance = cached_property(lambda self: self._stored("maintenance"))
    telemetry = cached_property(lambda self: self._stored("telemetry"))
    owned_investigations = cached_property(lambda self: self._stored("owned_investigations"))  # these three are joins that several stages need
    owned_escalations = cached_property(lambda self: self._stored("owned_escalations"))
    silent_assets = cached_property(lambda self: self._stored("silent_assets"))

    TABLES = ["entities", "assets", "analysts", "alerts", "investigations", "escalations", "cases", "closures", "maintenance", "telemetry"]

    def load(self) -> None:
        """Write all canonical tables now."""
        for name in self.TABLES:
            getattr(self, name)


class AnalysisRun:
    """Stage tables of one run, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.root = scratch(spark, "run")
        self.estate = StoredEstate(spark, folder, self.root)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.root)

    @cached_property
    def gap_findings(self) -> DataFrame:
        return self._write(FD.gap_findings(self.estate), "gap_findings")

    @cached_property
    def negative_findings(self) -> DataFrame:
        return self._write(FD.negative_findings(self.estate), "negative_findings")

    @cached_property
    def findings(self) -> DataFrame:
        """Findings with their nested evidence; readers that skip the evidence never load it."""
        return self.gap_findings.unionByName(self.negative_findings)

    @cached_property
    def risk(self) -> DataFrame:
        return self._write(R.entity_risk(self.estate, self.findings), "risk")

    @cached_property
    def candidates(self) -> DataFrame:
        return self._write(Q.candidates(self.findings, self.risk, self.estate.assets), "candidates")

    @cached_property
    def queue(self) -> DataFrame:
        return self._write(Q.review_queue(self.candidates), "queue")

    @cached_property
    def case_links(self) -> DataFrame:
        """Only workflow findings can name a case."""
        return self._write(G.case_links(self.estate, self.gap_findings), "case_links")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._write(G.nodes(self.estate), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self._write(G.edges(self.estate, self.case_links), "edges")

    @cached_property
    def components(self) -> DataFrame:
        return self._write(CC.labels(self.nodes.select("id"), self.edges), "components")

    @cached_property
    def anomalies(self) -> DataFrame:
        return self._write(G.anomalies(self.estate, self.case_links, self.nodes, self.edges), "anomalies")


_RUNS: dict[tuple, AnalysisRun] = {}


def analysis(spark: SparkSession, folder: str) -> AnalysisRun:
    """The run of a folder in this application; its stages are shared by all queries of the session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RUNS:
        _RUNS[key] = AnalysisRun(spark, folder)
    return _RUNS[key]
