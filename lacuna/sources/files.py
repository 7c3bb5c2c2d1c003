"""File sources: CSV and JSON exports read as text columns, with entity detection."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lacuna.schemas import CANONICAL_DDL, LOAD_ORDER
from lacuna.session import checkpoint_dir
from lacuna.sources.json_arrays import json_records

# --- fixed values: file-name words in the order they are tested, and header words ------
NAME_WORDS = [("alert", "alerts"), ("asset", "assets"), ("cse", "cses"), ("investigation", "investigations"),
              ("escalation", "escalations"), ("case", "cases"), ("closure", "closures"), ("analyst", "analysts")]
HEADER_WORDS = [(("raw_severity", "category"), "alerts"), (("criticality", "asset_type"), "assets"),
                (("size_tier", "sector"), "cses"), (("duration_seconds", "started_at"), "investigations")]


def _text_schema(entity: str) -> T.StructType | None:
    """All columns of an entity as text; raw values are never inferred."""
    if entity not in CANONICAL_DDL:
        return None
    names = [f.name for f in T.StructType.fromDDL(CANONICAL_DDL[entity]).fields]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def with_position(df: DataFrame) -> DataFrame:
    """File and position of each record, the order in which a first occurrence wins."""
    return df.withColumn("src_file", F.col("_metadata.file_path")).withColumn("src_pos", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """CSV with header. Blanks stay empty text; nothing is coerced."""
    df = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    df = with_position(df)
    return df.fillna("", [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != "src_file"])


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first text in the file opens an array rather than a JSON line; one character is fetched."""
    text = F.ltrim("value", F.lit("﻿ \t\r"))
    first = spark.read.text(path).select(F.substring(text, 1, 1).alias("c")).where("c <> ''").limit(1).collect()
    return bool(first) and first[0]["c"] == "["


def read_json(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """JSON array file or JSON Lines; both are split across tasks."""
    schema = _text_schema(entity) if entity else None
    if is_json_array(spark, path):
        return read_json_array(spark, path, schema)
    reader = spark.read.option("primitivesAsString", True)
    return with_position((reader.schema(schema) if schema else reader).json(path))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None, level: int = 1) -> DataFrame:
    """Records of JSON arrays as columns, with file and position; without a schema, it is inferred from all records."""
    records = json_records(spark, path, level)
    if schema is None:
        lines = f"{checkpoint_dir(spark)}/lacuna-json-{uuid.uuid4().hex}"
        records.select(F.translate("record", "\r\n", "  ").alias("value")).write.text(lines)  # line breaks in a record are white space
        schema = spark.read.option("primitivesAsString", True).json(lines).schema
    parsed = records.select(F.from_json("record", schema, {"primitivesAsString": "true"}).alias("r"), F.col("file").alias("src_file"), F.col("place").alias("src_pos"))
    return parsed.select("r.*", "src_file", "src_pos")


READERS: dict[str, Callable[..., DataFrame]] = {".csv": read_csv, ".json": read_json, ".jsonl": read_json}


def register_reader(suffix: str, reader: Callable[..., DataFrame]) -> None:
    """Plug in another format: ``reader(spark, path, entity) -> DataFrame`` of text columns."""
    READERS[suffix] = reader


def entity_of_name(name: str) -> str | None:
    low = os.path.basename(name).lower()
    return next((entity for word, entity in NAME_WORDS if word in low), None)


def entity_of_header(columns: list[str]) -> str:
    have = {c.lower() for c in columns}
    return next((entity for words, entity in HEADER_WORDS if have & set(words)), "unknown")


def read_export(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(entity, records) of one export; the reader follows the suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise ValueError(f"Unsupported ingestion file format: {os.path.basename(path)}")
    entity = entity_of_name(path)
    df = READERS[suffix](spark, path, entity)
    if entity is None:
        entity = entity_of_header(df.columns) if suffix == ".csv" else "unknown"
    return entity, df


def entity_column(file_name):
    """The file-name test as a column, for scans over many files at once."""
    out = F.lit("unknown")
    for word, entity in reversed(NAME_WORDS):
        out = F.when(F.lower(file_name).contains(word), F.lit(entity)).otherwise(out)
    return out


def exports_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, listed by Spark, so any store will do; an export may also be a folder of parts, such as ``alerts.csv/``."""
    inside = folder.rstrip("/").split("://", 1)[-1].lstrip("/") + "/"
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    names = paths.select(F.substring_index(F.substring_index("path", inside, -1), "/", 1).alias("name")).distinct()
    return [r["name"] for r in names.collect()]  # a name per table of an export


def read_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All exports of a folder in dependency order; ground-truth files are never read here."""
    out: dict[str, DataFrame] = {}
    files = [f for f in exports_in(spark, folder) if os.path.splitext(f)[1].lower() in READERS and not f.startswith("ground_truth")]
    for table in LOAD_ORDER:
        for name in sorted(files):
            if os.path.splitext(name)[0].lower() == table:
                out[table] = READERS[os.path.splitext(name)[1].lower()](spark, f"{folder.rstrip('/')}/{name}", table)
    return out
