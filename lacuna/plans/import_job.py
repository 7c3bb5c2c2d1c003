"""Import of one export file into the canonical tables of a store folder."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.operators import ingest as I
from lacuna.plans.stages import scratch, written
from lacuna.session import use_utc
from lacuna.sources import files as FS
from lacuna.sources import key_index as KI
from lacuna.sources import sinks as SK


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing imported yet


def known_keys(spark: SparkSession, entity: str, store: str, capacity: int = KI.CAPACITY) -> KI.KeyIndex:
    """The index of an entity's keys in a store; made from the stored rows if it is missing or unfinished."""
    path = f"{store}/known_keys/{entity}"
    index = KI.opened(spark, path)
    if index is not None:
        return index
    stored = _existing(spark, f"{store}/{entity}")
    ids = sorted({name for keys in I.KNOWN_BY[entity] for name in keys})
    rows = spark.createDataFrame([], ", ".join(f"{name} string" for name in ids)) if stored is None else stored.select(*ids)
    return KI.built(rows, I.KNOWN_BY[entity], path, capacity)


def store_batch(raw: DataFrame, entity: str, order_by: list[str], store: str, import_id: str, as_of: str) -> I.Ingested:
    """Validate a batch, append the rows that are new, quarantine the rest.

    A batch that is repeated under its import id adds nothing: its rows are known by now, and so are its issues."""
    spark = raw.sparkSession
    root = scratch(spark, f"import-{import_id}")
    out = I.ingest(raw, entity, order_by, import_id, as_of, lambda df: written(df, f"checked_{entity}", root))
    if entity in I.RULES:
        index = known_keys(spark, entity, store)
        fresh = written(index.only_new(out.valid, I.KNOWN_BY[entity]), f"new_{entity}", root)
        index.opened_for_writing(spark)
        SK.append(fresh, f"{store}/{entity}")
        index.extended(KI.digests(fresh, I.KNOWN_BY[entity]))
    issues = out.quarantined.drop("record_key")
    noted = _existing(spark, f"{store}/data_quality_issues")
    if noted is not None:
        keys = ["dataset_import_id", "issue_type", "record_ref"]
        issues = written(issues.join(noted.select(*keys).distinct(), keys, "left_anti"), "new_issues", root)
    SK.append(issues, f"{store}/data_quality_issues")
    return out


def import_file(spark: SparkSession, path: str, store: str, import_id: str, as_of: str) -> DataFrame:
    """Read, validate and store one file; returns its provenance row, also when the import fails."""
    use_utc(spark)
    name = os.path.basename(path)
    entity = FS.entity_of_name(path) or "unknown"
    try:
        entity, raw = FS.read_export(spark, path)
        out = store_batch(raw, entity, ["src_file", "src_pos"], store, import_id, as_of)
        record = I.import_record(out.counters, name, entity, import_id)
    except Exception:
        failed = spark.createDataFrame([(import_id, name, f"FILE_INGEST_{entity.upper()}", 0, 0, 0, "FAILED", 0.0)],
                                       "dataset_import_id string, filename string, source string, row_count long, accepted_count long, "
                                       "quarantined_count long, status string, completeness_score double")
        SK.append(failed, f"{store}/dataset_imports")
        raise
    SK.append(record, f"{store}/dataset_imports")
    return record


def import_directory(spark: SparkSession, folder: str, store: str, import_id: str, as_of: str) -> None:
    """All exports of a folder, parents before children."""
    use_utc(spark)
    for entity, raw in FS.read_directory(spark, folder).items():
        out = store_batch(raw, entity, ["src_file", "src_pos"], store, f"{import_id}-{entity}", as_of)
        SK.append(I.import_record(out.counters, entity, entity, f"{import_id}-{entity}"), f"{store}/dataset_imports")


def stream_sink(entity: str, order_by: list[str], store: str, import_id: str, as_of: str):
    """``foreachBatch`` function that runs the same batch import on every micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, entity, order_by, store, f"{import_id}-{batch_id}", as_of)
    return write


def register_rules(spark: SparkSession, rules: list[tuple], store: str) -> DataFrame:
    """Add rule versions that are not registered yet and return the ones added."""
    ddl = "rule_id string, version string, name string, family string, severity string, base_risk double"
    wanted = spark.createDataFrame(rules, ddl).withColumn("status", F.lit("ACTIVE"))
    known = _existing(spark, f"{store}/rule_versions")
    fresh = wanted if known is None else wanted.join(known.select("rule_id", "version"), ["rule_id", "version"], "left_anti")
    added = written(fresh, "rule_versions", scratch(spark, "register"))
    SK.append(added, f"{store}/rule_versions")
    return added
