from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lacuna.operators import sensitivity as SN
from lacuna.params import RULES
from lacuna.plans.lens import asset_entities, estate
from lacuna.plans.q_evaluation import sweeps

SF = "/root/testdata/sf0.001"


def test_steps_agree_with_the_rules_at_eight_thresholds(spark):
    params = replace(RULES, drop_pct=5.0, drop_z=0.1)  # so few events seldom fall by 70 %
    sources = [(rows.cache(), each) for rows, each in sweeps(estate(spark, SF), asset_entities(spark, SF))]
    steps = SN.steps(sources, params).cache()
    for rows, each in sources:
        for sweep in each:
            own = steps.where((F.col("rule_id") == sweep.rule_id) & (F.col("parameter") == sweep.parameter))
            points = [r[0] for r in own.select("threshold").orderBy("threshold").collect()]
            assert len(points) > 2, sweep
            at = [points[0] - 1, points[0], points[len(points) // 3], points[len(points) // 2], (points[1] + points[2]) / 2, points[-2], points[-1], points[-1] + 1]
            plain = rows.agg(*[F.count_if(sweep.flagged(t, params)).alias(f"t{i}") for i, t in enumerate(at)]).first()
            read = {r["threshold"]: r["flagged"] for r in own.collect()}
            for i, t in enumerate(at):
                assert SN.flagged_at(own, t).first()["flagged"] == plain[i], (sweep, t)
                assert read.get(t, plain[i]) == plain[i]


def test_no_rows_no_steps(spark):
    rows = spark.createDataFrame([], "v double")
    rule = lambda p: F.struct(F.when(F.col("v") >= p.drop_pct, "FAIL").otherwise("PASS").alias("status"))
    assert SN.steps([(rows, [SN.Sweep("R", "drop_pct", rule, F.col("v"), True)])]).count() == 0


@pytest.mark.parametrize("at_least", [True, False])
def test_ties_nulls_and_a_hot_value(spark, at_least):
    values = [None, 1.0, 2.0, 2.0, 5.0] + [3.0] * 50
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    hit = lambda p: F.col("v") >= p.drop_pct if at_least else F.col("v") < p.drop_pct
    rule = lambda p: F.struct(F.when(F.col("v").isNull() | hit(p), "FAIL").otherwise("PASS").alias("status"))
    got = {r["threshold"]: r["flagged"] for r in SN.steps([(rows, [SN.Sweep("R", "drop_pct", rule, F.col("v"), at_least)])]).collect()}
    known = [v for v in values if v is not None]
    assert got == {t: 1 + sum(v >= t if at_least else v < t for v in known) for t in set(known)}
