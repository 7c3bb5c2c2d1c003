"""Percentiles by radix selection against the built-in ones, and the bit pattern against plain order."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import order_statistics as O
from lacuna.operators import peers as PE

FRACTIONS = {"low": 0.0, "p25": 0.25, "p33": 1 / 3, "mid": 0.5, "p75": 0.75, "p999": 0.999, "top": 1.0}
ODD = [0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), float("nan"), 2.0**53, 1 / 3]


def test_bits_sort_like_numbers_and_come_back():
    rng = np.random.default_rng(1)
    x = np.concatenate([ODD, rng.normal(size=500) * 10.0 ** rng.integers(-30, 30, 500)])
    bits = O.to_bits(x)
    plain = x + 0.0
    assert (np.argsort(bits, kind="stable") == np.argsort(plain, kind="stable")).all()  # numpy sorts NaN last too
    back = O.from_bits(bits)
    assert ((back == plain) | (np.isnan(back) & np.isnan(plain))).all()


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [(g, h, rng.choice(ODD[:8]) if rng.random() < 0.3 else rng.gauss(0, 1) * 10 ** rng.randint(-5, 5)) for g in ("a", "b", None) for h in (1, None) for _ in range(rng.randint(1, 300))]
    rows += [("a", 1, None), ("only null", 1, None), ("one", 1, 7.0), ("two", 1, -1.0), ("two", 1, 2.0)]
    rows += [("nan", 1, x) for x in (1.0, 2.0, float("nan"), float("nan"))] + [("same", 2, 3.25)] * 5000
    return spark.createDataFrame(rows, "g string, h int, v double")


def test_percentiles_equal_the_built_in_ones(values):
    got = {(r.g, r.h): r for r in O.percentiles(values, ["g", "h"], "v", FRACTIONS).collect()}
    plain = values.where("v is not null").groupBy("g", "h").agg(*[F.percentile("v", p).alias(n) for n, p in FRACTIONS.items()]).collect()
    assert len(got) == len(plain) > 8
    for r in plain:
        for name in FRACTIONS:
            mine = got[r.g, r.h][name]
            assert mine == r[name] or math.isnan(mine) and math.isnan(r[name]), (r.g, r.h, name)


def test_no_groups_and_no_rows(spark, values):
    assert O.percentiles(values.where("g = 'two'"), [], "v", {"mid": 0.5}).first()["mid"] == 0.5
    assert O.percentiles(values.where("false"), ["g"], "v", {"mid": 0.5}).count() == 0


def test_baseline_of_peers(values):
    known = values.where("v is not null and not isnan(v)")
    got = {(r.g, r.h): r for r in PE.baseline(values.where("not isnan(v)"), ["g", "h"], "m", "v").collect()}
    for r in known.groupBy("g", "h").agg(F.count("v").alias("n"), F.median("v").alias("m"), F.percentile("v", 0.75).alias("q")).collect():
        assert (got[r.g, r.h]["members"], got[r.g, r.h]["median"], got[r.g, r.h]["p75"]) == (r.n, r.m, r.q)
