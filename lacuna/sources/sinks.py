"""Writers: canonical tables, quarantine, provenance, run-scoped replacement and exports."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lacuna.functions import scalar as S
from lacuna.sources import commit_log as CL


def append(df: DataFrame, path: str) -> None:
    """Add rows that are already known to be new."""
    df.write.mode("append").parquet(path)


def replace_run(df: DataFrame, path: str, scope: dict[str, str], seen: int | None = None) -> int:
    """Make the rows of a table under ``scope`` (say, a run and an engine) exactly those of ``df``, also if there are none.

    Rows are written as a new generation of their scope; one numbered commit then makes it the current one, and its number is returned. Until
    then readers see the old rows, after it the new ones, and a failed write changes nothing. Of two writers of one scope that started from the
    same commit (``seen``, by default the last one now) one wins and the other gets a :class:`commit_log.Conflict`. See :func:`read_runs`
    and :func:`stale_generations`."""
    spark, generation = df.sparkSession, uuid.uuid4().hex
    seen = CL.head(spark, path) if seen is None else seen
    where = "".join(f"/{k}={v}" for k, v in scope.items())
    df.drop(*scope).write.parquet(f"{path}/rows{where}/generation={generation}")
    return CL.commit(spark, path, scope, generation, seen)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The current rows of a table written by :func:`replace_run`, with the columns of its scope."""
    now = CL.current(spark, path)
    names = [e["key"] for e in now.select("scope").first()["scope"]]
    reader = spark.read.option("basePath", f"{path}/rows")
    as_text = [T.StructField(f.name, T.StringType()) if f.name in (*names, "generation") else f for f in reader.parquet(f"{path}/rows").schema]
    rows = reader.schema(T.StructType(as_text)).parquet(f"{path}/rows")  # folder names are text: run 007 is not run 7
    return rows.join(now.select("generation"), "generation", "left_semi").drop("generation")


def stale_generations(spark: SparkSession, path: str) -> DataFrame:
    """(scope, generation) that commits have replaced; see :func:`remove_stale`."""
    log = CL.commits(spark, path).select(F.col("scope"), "generation")
    return log.join(CL.current(spark, path).select("generation"), "generation", "left_anti")


def remove_stale(spark: SparkSession, path: str) -> int:
    """Delete the folders of replaced generations and tell how many; for the owner of the store, when no old reader is left."""
    removed, fs = 0, spark._jvm.org.apache.hadoop.fs
    for row in stale_generations(spark, path).toLocalIterator():
        # The scope's folders lie in the order in which the writer named them.
        for status in fs.Path(f"{path}/rows").getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs.Path(f"{path}/rows{'/*' * len(row['scope'])}/generation={row['generation']}")):
            removed += bool(status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).delete(status.getPath(), True))
    return removed


def with_engine(findings: DataFrame) -> DataFrame:
    """Partition key that lets the two rule engines replace their findings separately."""
    return findings.withColumn("engine", F.when(F.col("rule_id").startswith("GAP-"), "gap").otherwise("negative_space"))


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per table with a header; times as ISO text, nulls as blanks."""
    for name, df in tables.items():
        cols = [S.iso(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema]
        df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def export_json(documents: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document per line."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def _as_array(batches):
    """The text rows of a task as the lines of one JSON array."""
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    first = True
    for batch in batches:
        lines = batch["value"].to_pylist()
        yield pa.RecordBatch.from_pydict({"value": pa.array([line if first and not k else "," + line for k, line in enumerate(lines)], pa.string())})
        first = first and not lines
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


def export_json_arrays(df: DataFrame, folder: str) -> None:
    """Files of one JSON array each, one per task, with nulls written out."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(_as_array, "value string").write.mode("overwrite").text(folder)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Experiment or data-set manifest as JSON lines."""
    manifest.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_manifest(spark, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)
