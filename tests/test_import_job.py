import uuid

import pytest

from lacuna.params import RULE_REGISTER
from lacuna.plans import import_job as J
from lacuna.sources import commit_log as CL
from lacuna.sources import sinks as SK
from lacuna.streaming import ingest_stream as IS

AS_OF = "2024-01-31 00:00:00"
U = [str(uuid.UUID(int=i)) for i in range(1, 9)]


def test_import_twice_adds_nothing_and_keeps_provenance(spark, tmp_path):
    store = str(tmp_path / "store")
    (tmp_path / "cses.csv").write_text(f"id,name,sector\n{U[0]},One,ENERGY\n{U[1]},,ENERGY\n")
    first = J.import_file(spark, str(tmp_path / "cses.csv"), store, "i1", AS_OF).first()
    assert (first["accepted_count"], first["quarantined_count"], first["status"]) == (1, 1, "QUARANTINED")
    (tmp_path / "cses_more.csv").write_text(f"id,name,sector\n{U[2]},One,ENERGY\n{U[3]},Two,ENERGY\n")
    J.import_file(spark, str(tmp_path / "cses_more.csv"), store, "i2", AS_OF)
    assert sorted(r["name"] for r in spark.read.parquet(f"{store}/cses").collect()) == ["One", "Two"]
    assert spark.read.parquet(f"{store}/data_quality_issues").count() == 1
    with pytest.raises(Exception):
        J.import_file(spark, str(tmp_path / "alerts.xml"), store, "i3", AS_OF)
    assert sorted(r["status"] for r in spark.read.parquet(f"{store}/dataset_imports").collect()) == ["COMPLETED", "FAILED", "QUARANTINED"]


def test_stream_import_runs_the_batch_code(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for n, ids in enumerate(([U[4], U[5]], [U[5], U[6]])):
        (src / f"p{n}.csv").write_text("id,cse_id,name\n" + "".join(f"{i},{U[0]},asset\n" for i in ids))
    stream = IS.file_stream(spark, str(src), "id string, cse_id string, name string", "csv", files_per_batch=1, header=True)
    IS.run_available(stream, J.stream_sink("assets", ["id"], store, uuid.uuid4().hex, AS_OF), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(f"{store}/assets").collect()) == [U[4], U[5], U[6]]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    for entity, ddl, rows in (("alerts", "id string, cse_id string, asset_id string, created_at string", [(U[0], U[1], U[2], "2024-01-01"), ("", U[1], U[2], "2024-01-02"), ("bad", U[1], U[2], "2024-01-01")]),
                              ("cases", "id string, cse_id string", [(U[3], U[1]), (U[4], "x")]), ("maintenance_logs", "id string, cse_id string", [(U[5], U[1])])):
        sink = J.stream_sink(entity, ["id"], store, entity, AS_OF)
        for _ in range(2):
            sink(spark.createDataFrame(rows, ddl), 7)
    assert {e: spark.read.parquet(f"{store}/{e}").count() for e in ("alerts", "cases", "maintenance_logs", "data_quality_issues")} == {"alerts": 2, "cases": 1, "maintenance_logs": 1, "data_quality_issues": 2}


def test_only_a_missing_store_counts_as_empty(spark, tmp_path):
    (tmp_path / "alerts").mkdir()
    (tmp_path / "alerts" / "part-0.parquet").write_text("not parquet")
    assert J._existing(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(Exception):
        J._existing(spark, str(tmp_path / "alerts"))


def test_rule_register_is_insert_if_absent(spark, tmp_path):
    store = str(tmp_path / "store")
    assert J.register_rules(spark, RULE_REGISTER, store).count() == len(RULE_REGISTER)
    assert J.register_rules(spark, RULE_REGISTER + [("NEW-01", "1.0.0", "n", "f", "LOW", 1.0)], store).count() == 1
    assert spark.read.parquet(f"{store}/rule_versions").count() == len(RULE_REGISTER) + 1


def test_run_ids_that_look_like_numbers_stay_apart(spark, tmp_path):
    store = str(tmp_path / "runs")
    for run, value in (("007", 1), ("7", 2), ("1e3", 3), ("2024-01-01", 4)):
        SK.replace_run(spark.createDataFrame([(run, value)], "run_id string, value int"), store, {"run_id": run})
    SK.replace_run(spark.createDataFrame([("7", 5)], "run_id string, value int"), store, {"run_id": "7"})
    rows = SK.read_runs(spark, store)
    assert dict(rows.dtypes)["run_id"] == "string"
    assert sorted((r.run_id, r.value) for r in rows.collect()) == [("007", 1), ("1e3", 3), ("2024-01-01", 4), ("7", 5)]


def test_of_two_writers_of_one_scope_one_wins(spark, tmp_path):
    store, rows = str(tmp_path / "runs"), lambda v: spark.createDataFrame([(v,)], "value int")
    assert SK.replace_run(rows(0), store, {"run_id": "a"}) == 0
    seen = CL.head(spark, store)
    assert SK.replace_run(rows(1), store, {"run_id": "b"}, seen) == 1
    assert SK.replace_run(rows(2), store, {"run_id": "a"}, seen) == 2  # another scope came between
    with pytest.raises(CL.Conflict):
        SK.replace_run(rows(3), store, {"run_id": "a"}, seen)
    assert sorted((r.run_id, r.value) for r in SK.read_runs(spark, store).collect()) == [("a", 2), ("b", 1)]
    assert [r["scope"] for r in SK.stale_generations(spark, store).collect()] == [{"run_id": "a"}]
    assert SK.remove_stale(spark, store) == 1 and SK.read_runs(spark, store).count() == 2
    assert sorted(p.name for p in (tmp_path / "runs" / "commits").glob("[!.]*")) == [f"{k:020d}.json" for k in range(3)]
