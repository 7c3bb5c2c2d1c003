import random
from datetime import datetime

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.operators import review_queue as Q
from lacuna.params import QueueParams

CAND = ("analysis_run_id string, finding_id string, rule_id string, cse_id string, asset_id string, severity string, risk_score_id string, entity_risk double, "
        "found_at timestamp, sort_confidence double, " + ", ".join(f"factor_{f} double" for f in Q.FACTORS) + ", priority_score double, is_penalised boolean, rule_category string")
T = datetime(2024, 1, 1)


def cand(i, entity, category, score):
    return ("R", i, f"{category}-01", entity, None, "HIGH", None, 0.0, T, 1.0, *([0.0] * 8), float(score), False, category)


def greedy(rows, p, q, target):
    rows = sorted(rows, key=lambda r: (-r[-3], r[1]))
    by_e, by_c, one, rest = {}, {}, [], []
    for r in rows:
        e, c = r[3], r[-1]
        if by_e.get(e, 0) < p and by_c.get(c, 0) < q:
            by_e[e], by_c[c] = by_e.get(e, 0) + 1, by_c.get(c, 0) + 1
            one.append(r[1])
        else:
            rest.append(r[1])
    return one, rest[:max(0, target - len(one))]


def test_two_passes_against_plain_greedy(spark):
    rng = random.Random(11)
    for trial in range(6):
        p, q, target = rng.randint(1, 3), rng.randint(1, 3), rng.randint(3, 12)
        rows = [cand(f"f{i:03d}", f"E{rng.randint(0, 4)}", rng.choice(["GAP", "NEG", "PEER"]), rng.choice([50, 60, 60, 70, 80])) for i in range(120)]
        got = Q.review_queue(spark.createDataFrame(rows, CAND), QueueParams(max_per_entity=p, max_per_category=q, target_size=target)).collect()
        one, two = greedy(rows, p, q, target)
        assert {r["finding_id"] for r in got if r["selection_pass"] == 1} == set(one)
        assert {r["finding_id"] for r in got if r["selection_pass"] == 2} == set(two)
        assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))


def test_limits_above_a_thousand_and_many_categories(spark):
    rng = random.Random(3)
    rows = [cand(f"f{i:05d}", f"E{rng.randint(0, 40)}", f"C{rng.randint(0, 30)}", rng.randint(1, 99)) for i in range(4000)]
    got = Q.review_queue(spark.createDataFrame(rows, CAND), QueueParams(max_per_entity=60, max_per_category=1200, target_size=2600)).collect()
    one, two = greedy(rows, 60, 1200, 2600)
    assert {r["finding_id"] for r in got if r["selection_pass"] == 1} == set(one)
    assert {r["finding_id"] for r in got if r["selection_pass"] == 2} == set(two)


def test_concentration_fallback(spark):
    rows = [cand(f"a{i}", "A", "GAP", 90 - i) for i in range(8)] + [cand("b", "B", "GAP", 10)]
    cands = spark.createDataFrame(rows, CAND)
    queue = Q.review_queue(cands, QueueParams(target_size=5))
    m = Q.diversity_metrics(cands, queue).first()
    assert m["queue_items_generated"] == 5 and m["candidates_reintroduced_by_fallback"] == 2 and m["systemic_concentration_detected"]


def _finding(spark, completeness):
    found = spark.createDataFrame([("R", "f", "GAP-01", "C", "A", "CRITICAL", "NEW", 1.0, completeness, 0.9, 30.0, T)],
                                  "analysis_run_id string, finding_id string, rule_id string, cse_id string, asset_id string, severity string, status string, "
                                  "confidence double, evidence_completeness double, anomaly_score double, risk_score double, found_at timestamp")
    risk = spark.createDataFrame([("C", "k", 85.0)], "cse_id string, risk_score_id string, normalized_score double")
    assets = spark.createDataFrame([("A", "CRITICAL")], "id string, criticality string")
    return Q.candidates(found, risk, assets).first()


def test_priority_value(spark):
    assert _finding(spark, 100.0)["priority_score"] == 90.75
    low = _finding(spark, 20.0)
    assert low["is_penalised"] and low["priority_score"] == 90.75 - 12.0 - 15.0


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 24.99, 25.0, 49.99, 50.0, 74.99, 75.0, 100.0)], "s double")
    got = [r[0] for r in rows.select(S.risk_band(F.col("s"))).collect()]
    assert got == ["LOW", "LOW", "MODERATE", "MODERATE", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    mods = spark.createDataFrame([(100.0,), (95.0,), (85.0,), (65.0,), (40.0,)], "s double").select(S.confidence_modifier(F.col("s"))).collect()
    assert [r[0] for r in mods] == [1.0, 1.0, 0.85, 0.65, 0.40]


def test_status_changes_carry_over_hours(spark):
    queue = spark.createDataFrame([("q", "f", "C", "NEW")], "queue_item_id string, finding_id string, cse_id string, status string")
    stamp = lambda h, m: datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([(1, "q", stamp(1, 0), "IN_REVIEW", "u", ""), (2, "q", stamp(1, 5), "ESCALATED", "u", ""), (3, "q", stamp(5, 0), "RESOLVED", "u", "")],
                                   "event_id long, queue_item_id string, changed_at timestamp, new_status string, user_id string, notes string")
    now, audit = Q.status_changes(queue, events)
    assert now.first()["status"] == "RESOLVED"
    assert [r["previous_status"] for r in audit.orderBy("event_id").collect()] == ["NEW", "IN_REVIEW", "ESCALATED"]
