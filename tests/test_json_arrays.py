"""Parallel reading of JSON documents against the plain reader."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.sources import files as FS
from lacuna.sources import json_arrays as JA

ODD = ['}', '{', '"', '\\', '\\"', '}{][', '"}, {"id": "fake"}', "é} ", "\\\\", "", "a\nb\t", "[" * 9]


def objects(n, seed=1):
    rng = random.Random(seed)
    return [{"id": str(k), "name": rng.choice(ODD) + "x" * rng.randint(0, 9) + rng.choice(ODD), "sector": None if k % 5 else {"deep": [{"a": rng.choice(ODD)}, [1, {}]]}} for k in range(n)]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "200b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def found(spark, path, level=1):
    rows = JA.json_records(spark, str(path), level).orderBy("file", "place").collect()
    return [json.loads(r["record"]) for r in rows]


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_find_their_own_records(spark, tmp_path, small_ranges, indent):
    want = objects(60)
    want[7]["name"] = 'long "}{ ' * 300  # longer than several ranges
    (tmp_path / "a.json").write_text("﻿ \n" + json.dumps(want, indent=indent, ensure_ascii=indent is None) + "\n", encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() >= 8
    assert found(spark, tmp_path / "a.json") == want


def test_records_of_an_inner_array(spark, tmp_path, small_ranges):
    want = objects(30, 2)
    (tmp_path / "a.json").write_text(json.dumps({"total": 30, "note": "[{", "items": want}, indent=1))
    assert found(spark, tmp_path / "a.json", 2) == want


@pytest.mark.parametrize("text, want", [("", []), ("[]", []), (" [ ] ", []), ("[{}]", [{}]), ('[1, "}", {"a": 1}, [2]]', [{"a": 1}]), ('[{"a": 1}, {"b": {"c"', [{"a": 1}])])
def test_edges(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    assert found(spark, tmp_path / "a.json") == want


def test_several_files_in_one_task(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.json").write_text(json.dumps(objects(9, k)))
    assert found(spark, tmp_path) == [o for k in range(5) for o in objects(9, k)]


def test_structure_of_any_cut_composes():
    text = json.dumps(objects(8), ensure_ascii=False).encode()
    data = np.frombuffer(text, np.uint8)
    whole, end = JA.structure(data, False)
    assert whole.sum() == 0 and not end
    for cut in [i + 1 for i, c in enumerate(text) if c == ord("}")]:
        left, inside = JA.structure(data[:cut], False)
        right, _ = JA.structure(data[cut:], inside)
        assert (np.concatenate([left, right]) == whole).all()


def test_read_json_equals_the_plain_reader(spark, tmp_path, small_ranges):
    (tmp_path / "cses.json").write_text(json.dumps(objects(40), separators=(",", ":"), ensure_ascii=False), encoding="utf-8")  # nested values stay text; the readers space them differently
    for entity in ("cses", None):
        plain = spark.read.option("multiLine", True).option("primitivesAsString", True)
        plain = (plain.schema(FS._text_schema(entity)) if entity else plain).json(str(tmp_path / "cses.json"))
        mine = FS.read_json(spark, str(tmp_path / "cses.json"), entity)
        assert mine.columns == [*plain.columns, "src_file", "src_pos"]
        assert mine.orderBy("src_pos").drop("src_file", "src_pos").collect() == plain.collect()
        assert mine.select(F.countDistinct("src_pos")).first()[0] == 40
