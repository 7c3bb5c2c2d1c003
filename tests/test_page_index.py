import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lacuna.operators.page_index import PageIndex
from lacuna.plans.stages import scratch
from lacuna.sources.commit_log import Conflict

DDL = "t timestamp, seq long, what string"


def rows(n, start=0):
    """Ties in time, a third of all rows at one time."""
    rng = random.Random(n)
    out = [(datetime(2024, 1, 1) + timedelta(days=start, hours=0 if i % 3 == 0 else rng.randrange(20)), start * 1000 + i, f"w{i}") for i in range(n)]
    rng.shuffle(out)
    return out


def test_every_page_from_either_end(spark):
    data = rows(137)
    index = PageIndex(spark, scratch(spark), ["t", "seq"])
    assert index.append(spark.createDataFrame(data, DDL), 20) == 137
    ordered = sorted(data)
    for offset in (0, 19, 60, 130, 137, 500):
        assert [tuple(r)[:3] for r in index.page(25, offset).collect()] == ordered[offset:offset + 25]
        assert [tuple(r)[:3] for r in index.page(25, offset, newest_first=True).collect()] == ordered[::-1][offset:offset + 25]
    ranges = index.index().orderBy("before").collect()
    assert sum(r["rows"] for r in ranges) == 137 and max(r["rows"] for r in ranges) < 60
    assert len(index.page(5, 60).inputFiles()) <= 2


def test_pages_by_key_across_appends(spark):
    old, new = rows(90), rows(60, start=2)
    index = PageIndex(spark, scratch(spark), ["t", "seq"])
    index.append(spark.createDataFrame(old, DDL), 16)
    index.append(spark.createDataFrame(new, DDL), 16)
    ordered = sorted(old + new)
    for at in (0, 44, 88, 89, 90, 149):
        key = ordered[at][:2]
        assert [tuple(r)[:3] for r in index.page_after(key, 12).collect()] == ordered[at + 1:at + 13]
        assert [tuple(r)[:3] for r in index.page_before(key, 12).collect()] == ordered[:at][::-1][:12]
    unknown = (datetime(2024, 1, 2, 12), 5)
    assert [r["seq"] for r in index.page_after(unknown, 3).collect()] == [x[1] for x in ordered if x[:2] > unknown][:3]
    with pytest.raises(ValueError):
        index.append(spark.createDataFrame(old[:1], DDL))


def test_nulls_last_ties_and_empty_tables(spark):
    index = PageIndex(spark, scratch(spark), ["t", "seq"])
    assert index.total() == 0 and index.append(spark.createDataFrame([], DDL)) == 0
    t = datetime(2024, 1, 1)
    data = [(None, None, "d"), (t, None, "c"), (t, 1, "a"), (t, 1, "b"), (None, 3, "e")]
    index.append(spark.createDataFrame(data, DDL), 2)
    got = [r["what"] for r in index.page(10).collect()]
    assert sorted(got[:2]) == ["a", "b"] and got[2:] == ["c", "e", "d"]
    assert [r["what"] for r in index.page_after((t, 1), 2).collect()] == ["c", "e"]
    assert [r["what"] for r in index.page_before((None, 3), 1).collect()] == ["c"]
    assert index.page_after((None, None), 5).count() == 0


def test_one_of_two_appends_wins(spark, monkeypatch):
    index = PageIndex(spark, scratch(spark), ["t", "seq"])
    index.append(spark.createDataFrame(rows(10), DDL))
    from lacuna.operators import page_index
    seen = page_index.CL.head(spark, f"{index.path}/index")
    index.append(spark.createDataFrame(rows(10, start=3), DDL))
    monkeypatch.setattr(page_index.CL, "head", lambda *_: seen)
    with pytest.raises(Conflict):
        index.append(spark.createDataFrame(rows(10, start=4), DDL))
    monkeypatch.undo()
    assert index.total() == 20
