"""The first line of every order: shuffled before it is sorted, and still reduced early where an order is very long."""

import random
from datetime import datetime
from types import SimpleNamespace

from lacuna.plans import lens
from lacuna.schemas import SOURCE_DDL

ORDER = [10, 3, 1, 2, 5, 4, 8, 7, 9, 6]  # ship date, number, part, supplier, price, quantity, return flag, tax, line status, discount


def test_first_lines_are_shuffled_before_any_sort_and_exact(spark):
    rng = random.Random(5)
    def line(order, number):
        return (order, rng.choice([None, 1, 2]), rng.randint(1, 2), number, float(rng.randint(1, 2)), 1.0, 0.05, 0.04, rng.choice(["R", "A", None]), "F",
                rng.choice([None, *[datetime(2024, 1, d) for d in (1, 2, 3)]]))

    rows = [line(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 1024, 1025, 5000])) for _ in range(400)] + [line(9, n) for n in (None, 4000)] + [line(8, 3)] * 3
    lines = spark.createDataFrame(rows, SOURCE_DDL["lineitem"]).repartition(5)
    out = lens.first_lines(SimpleNamespace(lineitem=lines))
    want = {}
    for r in rows:
        k = tuple((r[i] is not None, r[i] if r[i] is not None else 0) for i in ORDER)
        want[r[0]] = min(want.get(r[0], k), k)
    got = {r["l_orderkey"]: tuple((v is not None, v if v is not None else 0) for v in r[1:]) for r in out.collect()}
    assert got == want and out.columns == ["l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_tax", "l_linestatus", "l_discount"]
    assert "RepartitionByExpression [l_orderkey" in out._jdf.queryExecution().optimizedPlan().toString()
