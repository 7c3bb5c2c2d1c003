"""Time the stages of one analysis run and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every stage is forced and
written; a stage reads the tables the stages before it wrote. A pass over the smallest
data set first loads classes and compiles generated code, as a long-lived cluster would have done.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lacuna.operators import audit as A
from lacuna.operators import graph as G
from lacuna.plans import q_ingest, q_intel, registry
from lacuna.plans.q_audit import audit_events
from lacuna.plans.stages import AnalysisRun, written
from lacuna.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.001"))


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stages(spark, folder: str) -> dict:
    """Name to callable, in run order; later ones rely on the earlier ones."""
    run = AnalysisRun(spark, folder)

    def ingest():
        out = q_ingest._alerts(spark, folder, lambda df: written(df, "checked_alerts", run.root))
        force(out.valid)
        force(out.quarantined)
        out.counters.collect()

    return {
        "ingest_alerts": ingest,
        "load_tables": lambda: run.estate.load(),
        "gap_rules": lambda: run.gap_findings,
        "negative_space_rules": lambda: run.negative_findings,
        "risk": lambda: run.risk,
        "priority": lambda: run.candidates,
        "review_queue": lambda: run.queue,
        "graph_build": lambda: (run.case_links, run.nodes, run.edges),
        "graph_anomalies": lambda: run.anomalies,
        "graph_metrics": lambda: G.metrics(run.nodes, run.edges, run.components).collect(),
        "vulnerability_parse": lambda: (force(q_intel._nvd(spark, folder)), force(q_intel._kev(spark, folder))),
        "asset_enrichment": lambda: force(q_intel.enriched(spark, folder)),
        "audit_chain": lambda: force(A.chain(audit_events(spark, folder))),
    }


def main() -> None:
    registry.load()
    spark = build_session("bench", CPUS, int(os.environ.get("BENCH_PARTITIONS", CPUS)))
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM):
        for fn in stages(spark, WARM).values():
            fn()
    times = {}
    for name, fn in stages(spark, FOLDER).items():
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "analysis_run_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
