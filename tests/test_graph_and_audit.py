import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacuna.operators import audit as A
from lacuna.operators import components as CC
from lacuna.operators import graph as G
from lacuna.params import GENESIS_HASH
from tests.test_rules import NOW, alert, asset, make

LOG = ("seq long, timestamp timestamp, user_id string, actor_role string, action string, entity_type string, entity_id string, status string, "
       "correlation_id string, before_after string, metadata string")
NONE = "case_id string, evidence_refs array<struct<source_table:string,source_record_id:string,description:string>>"


def log(spark, n, start=0):
    rows = [(start + i, datetime(2024, 1, 1) + timedelta(seconds=i), "u", "EXAMINER", "A", "E", str(i), "SUCCESS", None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_short_log_is_one_plain_chain(spark):
    rows = A.chain(log(spark, 5)).withColumn("payload", A.payload()).orderBy("seq").collect()
    before = GENESIS_HASH
    for r in rows:
        assert r["previous_hash"] == before
        before = hashlib.sha256((before + r["payload"]).encode()).hexdigest()
        assert r["integrity_hash"] == before


def test_many_blocks_and_levels_verify_and_break(spark):
    chained = A.chain(log(spark, 70), block=4).cache()
    assert chained.where(F.col("previous_hash") == GENESIS_HASH).count() == 1
    assert A.verify(chained, block=4).first()["is_intact"]
    for seq in (0, 17, 69):
        bad = chained.withColumn("action", F.when(F.col("seq") == seq, "X").otherwise(F.col("action")))
        got = A.verify(bad, block=4).first()
        assert not got["is_intact"] and got["first_broken_seq"] == seq and got["verified_count"] == seq
    # Even with its own hash forged, a changed old entry breaks the chain that follows it.
    forged = chained.withColumn("action", F.when(F.col("seq") == 3, "X").otherwise(F.col("action")))
    forged = forged.withColumn("integrity_hash", F.when(F.col("seq") == 3, F.sha2(F.concat("previous_hash", A.payload()), 256)).otherwise(F.col("integrity_hash")))
    assert A.verify(forged, block=4).first()["first_broken_seq"] == 4
    # A removed entry shows up at its successor.
    assert A.verify(chained.where("seq <> 10"), block=4).first()["first_broken_seq"] == 11


def test_growth_changes_no_hash_and_append_continues(spark):
    """16 events fill two levels of blocks of 4; 20 need a third."""
    old, new = log(spark, 16), log(spark, 200).where("seq >= 16")
    chained = A.chain(old, block=4)
    whole = {r["seq"]: r["integrity_hash"] for r in A.chain(log(spark, 200), block=4).collect()}
    assert all(whole[r["seq"]] == r["integrity_hash"] for r in chained.collect())
    for cut in (16, 18, 64, 67):
        stored = A.chain(log(spark, 200).where(F.col("seq") < cut), block=4)
        later = log(spark, 200).where(F.col("seq") >= cut)
        for digests in (None, A.block_digests(stored, 4)):
            more = A.append(stored, later, 4, digests)
            assert {r["seq"]: r["integrity_hash"] for r in more.collect()} == {k: v for k, v in whole.items() if k >= cut}
    assert A.verify(chained.unionByName(A.append(chained, new, 4)), block=4).first()["is_intact"]
    with pytest.raises(ValueError):
        A.append(chained, log(spark, 3), 4)
    with pytest.raises(Exception, match="beyond the digest levels"):
        A.chain(log(spark, 70), block=4, levels=2).collect()
    assert {r["seq"]: r["integrity_hash"] for r in A.chain(log(spark, 40), block=4, levels=5).collect()} == {k: v for k, v in whole.items() if k < 40}
    assert A.append(chained.limit(0), log(spark, 3), 4).count() == 3


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    nodes = [f"n{i:02d}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20, 35)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in CC.labels(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in nodes}


def _graph(est, spark):
    links = G.case_links(est, spark.createDataFrame([], NONE))
    nodes, edges = G.nodes(est), G.edges(est, links)
    return links, nodes, edges, G.anomalies(est, links, nodes, edges)


def test_graph_fixtures(spark):
    t = NOW
    est = make(spark, [asset("A"), asset("S")], [alert("1", "A", t, sev="CRITICAL"), alert("2", "A", t, sev="LOW")],
               investigations=[("i1", "1", None, t - timedelta(hours=2), None, 60, "CLOSED"), ("i9", "gone", None, t, None, 60, "CLOSED")],
               cases=[("k1", "C1", "OPEN", t, None)])
    _, nodes, edges, anomalies = _graph(est, spark)
    got = {(r["anomaly_type"], r["source_node"]) for r in anomalies.collect()}
    assert ("MISSING_TRANSITION", "ALERT:1") in got and ("TEMPORAL_VIOLATION", "ALERT:1") in got
    assert ("ORPHAN_ENTITY", "INVESTIGATION:i9") in got and ("MISSING_EXPECTED_ACTIVITY", "MISSING_EXPECTED:S") in got
    assert not any(source == "ALERT:2" for _, source in got)
    ids = {r[0] for r in nodes.select("id").collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in edges.collect())


def test_full_chain_has_no_gap(spark):
    t = NOW
    est = make(spark, [asset("A")], [alert("1", "A", t, sev="CRITICAL")], investigations=[("i1", "1", None, t, None, 60, "CLOSED")],
               escalations=[("e1", "i1", "SOC_LEAD", t, "")], cases=[("k1", "C1", "OPEN", t, None)], closures=[("c1", "k1", "TRUE_POSITIVE", "x", t, "")])
    links, _, _, anomalies = _graph(est, spark)
    assert anomalies.count() == 0
    assert G.paths(est, links).first()["observed_path"] == "ALERT>INVESTIGATION>ESCALATION>CASE>CLOSURE"


def test_paths_join_the_alerts_last(spark):
    """Repeated and null keys give the rows of the plain joins, and an alert's own columns meet one join alone."""
    t = NOW
    est = make(spark, [asset("A")], [alert("1", "A", t, sev="CRITICAL"), alert("1", "A", t, sev="LOW"), alert("2", "A", t, sev="CRITICAL"), alert("3", "A", t), alert(None, "A", t)],
               investigations=[("i1", "1", None, t, None, 60, None), ("i2", "2", None, t, None, 60, None), ("i1", "3", None, t, None, 60, None), ("i9", None, None, t, None, 60, None)],
               escalations=[("e2", "i2", "SOC_LEAD", t, "")], cases=[("k1", "C1", "OPEN", t, None), ("k2", "C1", "OPEN", t, None)], closures=[("c1", "k1", "TRUE_POSITIVE", "x", t, "")])
    links = spark.createDataFrame([("k1", "INVESTIGATION:i1"), ("k2", "ESCALATION:e2")], "case_id string, src string")
    out = G.paths(est, links)
    assert sorted((str(r["alert_id"]), r["severity"], r["observed_path"], r["is_anomalous"]) for r in out.collect()) == sorted(
        [("1", "CRITICAL", "ALERT>INVESTIGATION>CASE>CLOSURE", True), ("1", "LOW", "ALERT>INVESTIGATION>CASE>CLOSURE", False), ("2", "CRITICAL", "ALERT>INVESTIGATION>ESCALATION>CASE", False),
         ("3", est.alerts.where("id = '3'").first()["severity"], "ALERT>INVESTIGATION>CASE>CLOSURE", False), ("None", est.alerts.where("id IS NULL").first()["severity"], "ALERT", False)])
    joins = [x for x in out._jdf.queryExecution().analyzed().toString().split("\n") if "Join LeftOuter" in x]
    assert "alert_id" in joins[0]  # the outermost one


def test_analyst_concentration(spark):
    est = make(spark, alerts=[alert(str(i), "A", NOW) for i in range(12)],
               investigations=[(f"i{i}", str(i), "L1" if i < 8 else f"L{i % 3 + 2}", NOW, None, 60, "CLOSED") for i in range(12)])
    est.analysts = spark.createDataFrame([(f"L{i}", "C1", "h", "r") for i in range(1, 6)], "id string, cse_id string, handle string, role string")
    _, _, _, anomalies = _graph(est, spark)
    kinds = {(r["anomaly_type"], r["source_node"]) for r in anomalies.collect()}
    assert ("ANALYST_CONCENTRATION", "ANALYST:L1") in kinds and ("WORKFLOW_BOTTLENECK", "GRAPH_AGGREGATE") in kinds
