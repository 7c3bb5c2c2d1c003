"""Session settings used by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a byte of a Parquet file stands for when joins are planned. Counted-up keys, names made of them and constants shrink
#: that far: the assets take 1.7 bytes a row in their file and 128 as rows.
FILE_FACTOR = 64


def build_session(app: str, cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the jobs expect from a cluster as well."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("LACUNA_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Exports carry naive times that mean UTC; every job reads them that way."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_row_sizes(spark: SparkSession) -> SparkSession:
    """Tables are broadcast, by way of the driver, if their rows are few, not if their files are small; a factor that is set stays as it is.
    What looks too large by its file but is small is still broadcast once its real size is known, after the shuffle."""
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = configured or tempfile.mkdtemp(prefix="lacuna-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return configured or current


def written(df: DataFrame, name: str, root: str) -> DataFrame:
    """Write a table under ``root`` and return a scan of it."""
    path = f"{root}/{name}"
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # read a few times at most, so size counts
    return use_row_sizes(df.sparkSession).read.schema(schema).parquet(path)


def scratch(spark: SparkSession, name: str = "stage") -> str:
    """A fresh folder for written intermediate tables, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/lacuna-{name}-{uuid.uuid4().hex}"
