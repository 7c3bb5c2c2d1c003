"""Validation, normalisation, de-duplication and quarantine of raw export records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.functions import scalar as S


@dataclass(frozen=True)
class EntityRules:
    """What one entity type requires and how its fields are filled."""

    label: str
    required: tuple[str, ...]
    references: tuple[str, ...] = ()       # identifier fields besides id
    must_parse: tuple[str, ...] = ()       # times without which the record is useless
    times: tuple[str, ...] = ()            # times that may be missing
    times_now: tuple[str, ...] = ()        # times that default to the import time
    texts: tuple[tuple[str, str | None], ...] = ()  # field and the default when absent


# --- fixed values: required fields and defaults per entity -------------------------------
RULES = {
    "cses": EntityRules("CSE", ("name", "sector"), texts=(("name", None), ("sector", None), ("entity_type", "OPERATOR"), ("size_tier", "TIER_1"))),
    "assets": EntityRules("Asset", ("cse_id", "name"), ("cse_id",), texts=(("name", None), ("asset_type", "GENERIC"), ("status", "ACTIVE"))),
    "alerts": EntityRules("Alert", ("cse_id", "asset_id"), ("cse_id", "asset_id"), ("created_at",),
                          texts=(("source_system", "SIEM"), ("category", "UNSPECIFIED"), ("status", "OPEN"))),
    "investigations": EntityRules("Investigation", ("alert_id",), ("alert_id", "analyst_id"), ("started_at",), ("ended_at",),
                                  texts=(("notes", ""), ("outcome", "CLOSED"))),
    "escalations": EntityRules("Escalation", ("investigation_id",), ("investigation_id",), times_now=("escalated_at",),
                               texts=(("escalated_to", "SOC_LEAD"), ("reason", ""))),
    "cases": EntityRules("Case", ("cse_id",), ("cse_id",), times=("closed_at",), times_now=("opened_at",), texts=(("status", "OPEN"),)),
    "closures": EntityRules("Closure", ("case_id",), ("case_id",), times_now=("closed_at",), texts=(("closed_by", "SYSTEM"), ("justification", ""))),
    "analysts": EntityRules("Analyst", ("cse_id", "handle"), ("cse_id",), texts=(("handle", None), ("role", "ANALYST_L1"))),
    "maintenance_logs": EntityRules("MaintenanceLog", ("cse_id",), ("cse_id", "asset_id"), times_now=("start_time", "end_time"),
                                    texts=(("maintenance_ref", "MAINT_REF_UNSPECIFIED"), ("reason", ""), ("approved_by", "SYSTEM"))),
}
# Keys under which a record may already be known; any one of them is enough.
KNOWN_BY = {"cses": [["id"], ["name"]], "assets": [["id"]], "analysts": [["id"], ["cse_id", "handle"]],
            "investigations": [["id"], ["alert_id"]], "escalations": [["id"], ["investigation_id"]], "closures": [["id"], ["case_id"]],
            "alerts": [["id"]], "cases": [["id"]], "maintenance_logs": [["id"]]}


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def record_key(df: DataFrame, entity: str) -> Column:
    """Identity of a raw record: its id, or a fingerprint of key fields where it has none."""
    own = _field(df, "id")
    parts = [F.coalesce(_field(df, n), F.lit("None")) for n in ("cse_id", "asset_id", "created_at", "category")]
    return F.when(_blank(own), F.sha2(F.concat_ws(":", F.lit(entity), *parts), 256)).otherwise(F.concat(F.lit(f"{entity}:"), own))


def first_records(df: DataFrame, entity: str, order_by: list[str]) -> DataFrame:
    """First record per identity. Rank 1 is pruned before the shuffle, so copies of one record never pile up."""
    order = Window.partitionBy("record_key").orderBy(*order_by)
    return (df.withColumn("record_key", record_key(df, entity)).withColumn("copy", F.row_number().over(order))
            .where("copy = 1").drop("copy"))


def issue(df: DataFrame, entity: str) -> Column:
    """First reason to quarantine a record, or null."""
    if entity not in RULES:
        return F.lit(f"Unknown entity type {entity}")
    rule = RULES[entity]
    bad_id = ~_blank(_field(df, "id")) & ~S.is_uuid(_field(df, "id"))
    lacking = _blank(_field(df, rule.required[0]))
    for name in rule.required[1:]:
        lacking = lacking | _blank(_field(df, name))
    plural = "fields" if len(rule.required) > 1 else "field"
    out = F.when(bad_id, "Malformed record identifier").when(lacking, f"Missing required {rule.label} {plural}: {' or '.join(rule.required)}")
    for name in rule.must_parse:
        out = out.when(S.timestamp(_field(df, name)).isNull(), f"Invalid or unparseable {rule.label.lower()} {name} timestamp")
    for name in rule.references:
        out = out.when(~_blank(_field(df, name)) & ~S.is_uuid(_field(df, name)), "Malformed reference identifier")
    return out


def canonical(df: DataFrame, entity: str, as_of: str) -> list[Column]:
    """Columns of the canonical row."""
    rule = RULES[entity]
    now = F.to_timestamp(F.lit(as_of))
    made_id = S.uuid_text(F.md5(F.col("record_key")))
    cols = [F.when(_blank(_field(df, "id")), made_id).otherwise(S.uuid_text(_field(df, "id"))).alias("id")]
    cols += [F.when(~_blank(_field(df, n)), S.uuid_text(_field(df, n))).alias(n) for n in rule.references]
    cols += [F.coalesce(_field(df, n), F.lit(default)).alias(n) if default is not None else _field(df, n).alias(n) for n, default in rule.texts]
    cols += [S.timestamp(_field(df, n)).alias(n) for n in rule.must_parse + rule.times]
    cols += [F.coalesce(S.timestamp(_field(df, n)), now).alias(n) for n in rule.times_now]
    if entity == "assets":
        cols.append(S.criticality(_field(df, "criticality")).alias("criticality"))
    elif entity == "alerts":
        given, raw = S.text_or_default(_field(df, "severity"), None), S.text_or_default(_field(df, "raw_severity"), None)
        cols += [S.severity(F.coalesce(given, raw)).alias("severity"), F.coalesce(raw, given, F.lit("UNKNOWN")).alias("raw_severity")]
    elif entity == "investigations":
        cols.append(S.digits_to_int(_field(df, "duration_seconds")).alias("duration_seconds"))
    elif entity == "closures":
        cols.append(S.disposition(_field(df, "disposition_type")).alias("disposition_type"))
    return cols


@dataclass
class Ingested:
    """Both outputs of one import and its counters."""

    valid: DataFrame
    quarantined: DataFrame
    counters: DataFrame


def ingest(raw: DataFrame, entity: str, order_by: list[str], import_id: str, as_of: str,
           stage: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """De-duplicate, validate and split one batch of raw records.

    ``stage`` may write the checked records and hand back a scan of them; both outputs and the
    counters then read that table instead of each repeating the de-duplication.
    """
    checked = first_records(raw, entity, order_by)
    checked = checked.withColumn("issue", issue(checked, entity))
    if stage is not None:
        checked = stage(checked)
    good = checked.where("issue is null")
    valid = good.select(*canonical(good, entity, as_of)) if entity in RULES else good.select("record_key")
    ref = F.coalesce(_field(checked, "id"), F.concat(F.lit("row_"), F.col("record_key")))
    bad = checked.where("issue is not null").select(
        F.lit(import_id).alias("dataset_import_id"), F.lit(f"INVALID_{entity.upper()}_RECORD").alias("issue_type"), F.lit("record").alias("field"),
        ref.alias("record_ref"), F.lit("HIGH").alias("severity"), F.col("issue").alias("description"), "record_key")
    says = lambda word: F.lower("issue").contains(word)
    counts = checked.agg(S.count_where(F.col("issue").isNull()).alias("accepted"), S.count_where(F.col("issue").isNotNull()).alias("quarantined"),
                         S.count_where(says("timestamp")).alias("invalid_timestamps"), S.count_where(says("cse")).alias("unmapped_cses"))
    counts = counts.fillna(0).withColumn("total", raw.agg(F.count(F.lit(1))).scalar())
    return Ingested(valid, bad, counts.withColumn("duplicates", F.col("total") - F.col("accepted") - F.col("quarantined")))


def only_new(valid: DataFrame, existing: DataFrame, entity: str) -> DataFrame:
    """Rows not yet known under any of their keys: one anti join per key."""
    out = valid
    for keys in KNOWN_BY.get(entity, []):
        out = out.join(existing.select(*keys).distinct(), keys, "left_anti")
    return out


def import_record(counters: DataFrame, file_name: str, entity: str, import_id: str) -> DataFrame:
    """Provenance row of one import."""
    share = F.when(F.col("total") > 0, S.rounded(F.col("accepted") / F.col("total") * 100.0, 2)).otherwise(F.lit(100.0))
    return counters.select(
        F.lit(import_id).alias("dataset_import_id"), F.lit(file_name).alias("filename"), F.lit(f"FILE_INGEST_{entity.upper()}").alias("source"),
        F.col("total").alias("row_count"), F.col("accepted").alias("accepted_count"), F.col("quarantined").alias("quarantined_count"),
        F.when(F.col("quarantined") == 0, "COMPLETED").otherwise("QUARANTINED").alias("status"), share.alias("completeness_score"))
