"""External SOC alert logs mapped onto canonical alerts, with provenance per field."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lacuna.functions import scalar as S

REQUIRED = ["timestamp", "category", "severity"]
# --- fixed values: where each canonical field comes from ------------------------------
PROVENANCE = {"alert_id": "OBSERVED", "timestamp": "OBSERVED", "src_ip": "OBSERVED", "dest_ip": "OBSERVED", "alert_type": "OBSERVED",
              "severity": "DERIVED", "cse_id": "SYNTHETICALLY_AUGMENTED", "investigation_status": "SYNTHETICALLY_AUGMENTED"}


def has_required_header(columns: list[str]) -> bool:
    have = {c.strip().lower() for c in columns}
    return all(c in have for c in REQUIRED)


def normalise(rows: DataFrame, as_of: str) -> DataFrame:
    """Canonical alerts; a field missing from the header falls through to its alternatives."""
    def first_of(*names: str, default=None):
        found = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(*found, F.lit(default)) if found else F.lit(default)

    fallback_id = S.key_hash(*[F.col(c) for c in rows.columns])
    stamp = F.coalesce(S.text_or_default(first_of("timestamp", default=""), None), S.text_or_default(first_of("created_at", default=""), None))
    ts = F.coalesce(F.try_to_timestamp(stamp), F.to_timestamp(F.lit(as_of)))
    raw = F.upper(first_of("severity", default="LOW"))
    sev = S.soc_log_severity(first_of("severity", default="LOW"))
    details = F.struct(first_of("src_ip", default="").alias("src_ip"), first_of("dest_ip", default="").alias("dest_ip"),
                       first_of("signature", "description", default="").alias("signature"))
    return rows.select(
        F.coalesce(first_of("alert_id", "id"), fallback_id).alias("alert_id"), first_of("cse_id", "entity_id", default="CSE-EXT-01").alias("cse_id"),
        first_of("asset_id", "host_id", "src_ip", default="ASSET-EXT-01").alias("asset_id"), ts.alias("created_at"),
        first_of("category", "event_type", default="SECURITY_ALERT").alias("category"), sev.alias("severity"),
        first_of("status", default="CLOSED").alias("status"), details.alias("details"),
        F.create_map(*[x for k, v in PROVENANCE.items() for x in (F.lit(k), F.lit(v))]).alias("field_provenance"),
        F.concat(raw, F.lit(" -> "), sev).alias("severity_note"))
