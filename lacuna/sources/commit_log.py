"""Numbered commits of a stored table: JSON files 0, 1, 2, ... that are put only where none is yet.

A commit says which generation of rows a scope (say, a run and an engine) has from now on. The order of commits is that of their numbers,
never of a clock. A file appears whole, under its own name, by a rename that fails where the name is taken; that is as exclusive as the
file system makes it (HDFS and its like do).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_COMMIT = "version long, scope map<string,string>, generation string"


class Conflict(RuntimeError):
    """Another writer has committed the same scope meanwhile; nothing of this write is visible."""


def _put(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a file unless its name is taken."""
    fs = spark._jvm.org.apache.hadoop.fs
    target, draft = fs.Path(f"{folder}/{name}"), fs.Path(f"{folder}/_draft-{uuid.uuid4().hex}")
    context = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if target.toUri().getScheme() else fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    out = draft.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context.rename(draft, target, spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        context.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits: version, scope and generation."""
    try:
        return spark.read.schema(_COMMIT).json(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def head(spark: SparkSession, path: str) -> int:
    """Number of the last commit, -1 before the first."""
    last = commits(spark, path).agg(F.max("version")).first()[0]
    return -1 if last is None else last


def commit(spark: SparkSession, path: str, scope: dict[str, str], generation: str, seen: int) -> int:
    """Make a generation the current one of its scope and return the commit's number. ``seen`` is the head that the writer started from:
    a later commit of another scope is stepped over, one of the same scope is a :class:`Conflict`."""
    scope, version = {k: str(v) for k, v in scope.items()}, seen + 1
    while not _put(spark, f"{path}/commits", f"{version:020d}.json", json.dumps({"version": version, "scope": scope, "generation": generation})):
        others = commits(spark, path).where(F.col("version") >= version).select("version", "scope").collect()  # those since the writer started
        if any(o["scope"] == scope for o in others):
            raise Conflict(f"{scope} was committed by another writer")
        version = max([version, *(o["version"] for o in others)]) + 1
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """(scope as sorted entries, generation) of every scope's last commit."""
    entries = F.array_sort(F.map_entries("scope")).alias("scope")
    return commits(spark, path).select(entries, "version", "generation").groupBy("scope").agg(F.max_by("generation", "version").alias("generation"))
