"""Hard negatives against a plain search of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row long, block long, n int, anchor string"


def rows():
    rng = random.Random(3)
    out = []
    for k in range(400):
        v = [round(rng.uniform(-1, 1) + 0.4, 3) for _ in range(6)]
        out.append([k, v, k % 4 if k % 3 else 1])
    for k in range(0, 400, 9):
        out[k][1] = list(out[1][1])  # equal vectors under many labels: ties
    out[5][1], out[6][1], out[7][1], out[8][1] = None, [], [0.1, None], [float("nan")] * 6
    out[10][2], out[11][1], out[12][1] = None, [float("inf")] * 6, [0.5, 0.5]
    out[300][1] = [1e30, -1e18, 0.0, 0.0, 0.0, 0.0]
    out[100][1] = [-9.0, 0.0, 0.0, 0.0, 0.0, 0.0]  # positives of negative score open no window
    out += [out[20], out[20], out[200], [None, out[1][1], 1], [None, out[2][1], 0]]
    return [(*r, 1, 2, 3, "x") for r in out]


def exact(a, b):
    return max(H.LEAST, min(H.NO_ID, sum(x * y for x, y in zip(a, b, strict=False))))


def expected(table, every=20, positives=5, negatives=10):
    used = []
    for vec_id, v, label, *_ in table:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((vec_id, [max(-(2**62), min(2**62, math.floor(256 * x))) for x in v], label))
    out = []
    for i, (anchor_id, a, label) in enumerate(used):
        if anchor_id is None or anchor_id % every:
            continue
        scored = sorted(((-exact(a, b), H.NO_ID if v is None else v, m) for j, (v, b, m) in enumerate(used) if j != i))
        for minus, positive, _ in [s for s in scored if s[2] == label][:positives]:
            own = [s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:negatives]
            out += [(anchor_id, positive if positive != H.NO_ID else None, k + 1, v if v != H.NO_ID else None, -minus, -s) for k, (s, v, _) in enumerate(own)]
    return sorted(out, key=repr)


def mined(docs):
    return H.hard_negatives(docs, F.col("vec_id") % 20 == 0, F.col("label"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_against_all_rows(docs):
    got = sorted((tuple(r) for r in mined(docs).collect()), key=repr)
    assert got == expected(rows()) and len(got) > 300


def test_blocks_of_few_anchors_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 3)
    monkeypatch.setattr(H, "CELL_BYTES", 2000)
    assert sorted((tuple(r) for r in mined(docs).collect()), key=repr) == expected(rows())


def test_slots_fed_in_parts_keep_the_best_of_every_window():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-9, 9, (700, 3)), rng.integers(-9, 9, (4, 3))
    limits = np.sort(rng.integers(-50, 120, (4, 5)), axis=1)[:, ::-1].copy()
    limits[1, 2] = limits[1, 3]  # two windows with one upper limit
    slots = H.Slots(np.arange(4) - 10, np.zeros(4, np.int64), a, limits, np.full(4, H.LEAST), 6, False)
    vec = rng.permutation(700)
    for k in range(0, 700, 97):
        slots.feed(np.arange(k, min(k + 97, 700)), vec[k:k + 97], np.ones(len(vec[k:k + 97]), np.int64), x[k:k + 97])
    scores = a @ x.T
    for i in range(4):
        for j in range(5):
            want = sorted((-s, v) for s, v in zip(scores[i].tolist(), vec.tolist(), strict=True) if s <= limits[i, j])[:6]
            suffix = (slots.a == i) & (slots.slot >= j)
            got = sorted(zip((-slots.score[suffix]).tolist(), slots.vec[suffix].tolist(), strict=True))[:6]
            assert got == want


def test_shares_do_not_overflow(spark):
    values = [0, 1, 9, 10, 99, 100, 101, 12345, H.NO_ID]
    df = spark.createDataFrame([(v,) for v in values], "s long").select("s", H.share_up("s", 30).alias("low"), H.share_down("s", 90).alias("high"))
    assert [(r.low, r.high) for r in df.collect()] == [(-(-30 * v // 100), 90 * v // 100) for v in values]


def test_empty_table_and_no_anchors(spark, docs):
    assert mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.hard_negatives(docs, F.lit(False), F.col("label")).count() == 0
