import ast
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from lacuna.functions.digest import multiset_digest, row_hash
from lacuna.operators import evaluation as V
from lacuna.plans import q_reports

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_binary_metrics(spark):
    got = V.binary_metrics(spark.createDataFrame([(10, 2, 0, 88), (0, 0, 0, 5), (0, 3, 0, 0)], "tp long, fp long, fn long, tn long")).collect()
    assert (got[0]["precision"], got[0]["recall"], got[0]["false_positive_rate"]) == (0.8333, 1.0, 0.0222)
    assert (got[1]["precision"], got[1]["recall"]) == (1.0, 1.0) and got[2]["precision"] == 0.0


def test_ranking(spark):
    ranked = spark.createDataFrame([(x, i + 1) for i, x in enumerate("abcde")], "id string, rank int")
    got = {r["k"]: r for r in V.ranking_metrics(ranked, spark.createDataFrame([("a", 1), ("c", 1)], "id string, grade int"), [1, 3]).collect()}
    assert got[3]["precision_at_k"] == 0.6667 and got[1]["recall_at_k"] == 0.5 and got[3]["recall_at_k"] == 1.0
    assert got[3]["average_precision_at_k"] == round((1 + 2 / 3) / 2, 4)


def test_reduction(spark):
    rows = [(str(i), f"C{i % 5}", "GAP-01", "CRITICAL") for i in range(100)]
    found = spark.createDataFrame(rows, "finding_id string, cse_id string, rule_id string, severity string")
    got = V.reduction_metrics(found, found.where(F.col("finding_id").cast("int") < 10)).first()
    assert got["review_reduction"] == 0.9 and got["herfindahl_index"] == 0.2 and got["cse_coverage"] == 1.0


def test_digest_ignores_order_and_partitions(spark):
    df = spark.range(1000).select(row_hash(F.col("id")).alias("row_hash"))
    one, two = multiset_digest(df.repartition(7)).first(), multiset_digest(df.orderBy(F.desc("row_hash"))).first()
    assert one == two and one["row_count"] == 1000
    assert multiset_digest(df.where("row_hash > '1'")).first()["digest"] != one["digest"]


def test_detectors_do_not_read_truth():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lacuna", "operators")
    for name in os.listdir(root):
        if name.endswith(".py") and name != "evaluation.py":
            tree = ast.parse(open(os.path.join(root, name), encoding="utf-8").read())
            used = {getattr(n, "module", "") or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
            assert not any("evaluation" in m and m.endswith("evaluation") for m in used), name


def _norm(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["gap01", "neg02_by_asset", "neg04", "nearest_case", "entity_risk", "review_queue", "queue_diversity", "graph_anomalies", "evidence_integrity",
                                  "truth_evaluation", "ablation", "ingest_alerts", "import_quality", "cpe_match", "report_snapshots", "audit_chain", "state_digest", "recurrent_telemetry"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entrypoint.queries()[name](spark, FOLDER)
    cols = sorted(got.columns)
    res = con.execute(entrypoint.oracle_sql()[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    assert _norm([r[c] for c in cols] for r in got.collect()) == _norm([r[have.index(c)] for c in cols] for r in res.fetchall())


@pytest.mark.parametrize("name", ["report_altered_parts", "report_altered_evidence"])
def test_an_altered_finding_or_payload_is_found_in_all_reports(spark, name):
    test_query_matches_its_sql(spark, name)


def test_every_kind_signs_its_own_report_and_whole_tables(spark):
    findings = q_reports.analysis(spark, FOLDER).findings
    tables = q_reports._tables(spark, FOLDER, findings, q_reports._evidence(findings))
    assert set(tables["findings"].columns) == set(findings.columns) - {"evidence"}
    assert {"payload_json", "description", "relevance", "evidence_timestamp"} <= set(tables["evidence"].columns)
    summaries = q_reports._summaries(spark, FOLDER)
    assert set(summaries) == set(q_reports.OWN_TABLES) and len({tuple(sorted(x.columns)) for x in summaries.values()}) == 5
    assert all("cse_id" in tables[part].columns for own in q_reports.OWN_TABLES.values() for part in own)


def test_entry_returns_rows(spark):
    assert entrypoint.entry(spark).count() == 25


def test_altered_parts_work_out_threats_and_techniques_once(spark, monkeypatch):
    from lacuna.plans import q_reports

    asked = []
    for name in ("enriched", "technique_map"):
        monkeypatch.setattr(q_reports, name, lambda s, d, of=getattr(q_reports, name), name=name: asked.append(name) or of(s, d))
    q_reports.report_altered_parts(spark, FOLDER)
    assert asked == ["enriched", "technique_map"]


def test_evidence_carries_the_entity_of_its_finding_without_a_join(spark):
    from lacuna.plans import q_reports
    from lacuna.plans.stages import analysis

    findings = analysis(spark, FOLDER).findings
    rows = q_reports._evidence(findings)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    told = {(r["finding_id"], r["cse_id"]) for r in rows.select("finding_id", "cse_id").distinct().collect()}
    assert told == {(r["finding_id"], r["cse_id"]) for r in findings.select("finding_id", "cse_id").collect()}
