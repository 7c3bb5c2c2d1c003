"""Joins are planned by the size of a table's rows, not by that of its compressed file."""

import pytest
from pyspark.sql import functions as F

from lacuna.session import FILE_FACTOR, scratch, use_row_sizes, written

NAME = "spark.sql.sources.fileCompressionFactor"
ROWS = 250_000


@pytest.fixture
def unset(spark):
    before = spark.conf.get(NAME)
    spark.conf.unset(NAME)
    yield spark
    spark.conf.set(NAME, before)


def _size(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_many_rows_in_a_small_file_are_not_broadcast(unset):
    root, key = scratch(unset, "sizes"), F.concat(F.lit("AST-"), F.col("id").cast("string"))
    assets = unset.range(0, ROWS, 1, 2).select(key.alias("id"), F.lit("CSE-1").alias("cse_id"), F.concat(F.lit("Customer#"), key).alias("name"),
                                               F.lit("SERVER").alias("asset_type"), F.lit("HIGH").alias("criticality"), F.lit("ACTIVE").alias("status"))
    few = unset.range(3).select(F.concat(F.lit("CSE-"), F.col("id").cast("string")).alias("id"))
    assets, few = written(assets, "assets", root), written(few, "entities", root)
    alerts = written(unset.range(9).select(F.concat(F.lit("ALT-"), F.col("id").cast("string")).alias("id"), F.lit("CSE-1").alias("cse_id"), key.alias("asset_id"),
                                           F.lit(None).cast("timestamp").alias("created_at")), "alerts", root)
    assert _size(assets) > ROWS * 40
    owned = assets.join(few.withColumnRenamed("id", "cse_id"), "cse_id", "left_semi")
    assert "BroadcastHashJoin" in owned._jdf.queryExecution().sparkPlan().toString()  # a table of few rows still is
    found = alerts.join(assets.select(F.col("id").alias("asset_id"), "name", "asset_type", "criticality", "status"), "asset_id", "left")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.where("name is not null").count() == 9


def test_a_factor_that_is_set_stays(unset):
    unset.conf.set(NAME, "3.0")
    assert float(use_row_sizes(unset).conf.get(NAME)) == 3.0
    unset.conf.unset(NAME)
    assert float(use_row_sizes(unset).conf.get(NAME)) == FILE_FACTOR
