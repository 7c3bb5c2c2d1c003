"""Ingestion and data-quality queries over raw, partly broken export records.

The raw records are the source tables written out as text, the way an export would hold them:
mixed date styles, blank references, unknown labels, repeated records.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lacuna.functions import scalar as S
from lacuna.operators import ingest as I
from lacuna.operators import quality as QL
from lacuna.plans.ctes import AS_OF_SQL, IMPORT_SQL, cte, r
from lacuna.plans.lens import AS_OF, IMPORT_ID, Tables
from lacuna.plans.registry import query
from lacuna.plans.stages import scratch, written
from lacuna.sources import files as FS
from lacuna.sources import hash_trees as HT
from lacuna.sources import key_index as KI
from lacuna.sources import manifests as MF
from lacuna.sources import sinks as SK
from lacuna.sources import soc_logs as SL

KEY_CAPACITY = 1 << 12  # keys a bucket of the small indexes below
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def uid(kind: str, col):
    return S.uuid_text(F.md5(F.concat(F.lit(f"{kind}-"), col.cast("string"))))


def uid_sql(kind: str, expr: str) -> str:
    return f"regexp_replace(md5('{kind}-' || {expr}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _pick(col, options: dict, other):
    out = F.lit(other) if isinstance(other, str) else other
    for k, v in reversed(options.items()):
        out = F.when(col == k, F.lit(v) if isinstance(v, str) else v).otherwise(out)
    return out


def raw_alerts(spark, d):
    """One raw alert record per order line: orders repeat, and the first line wins. An order without lines is a record without a time."""
    t = Tables(spark, d)
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    stamp = F.col("o_orderdate").cast("timestamp")
    flag = F.coalesce(F.concat("l_returnflag", "l_linestatus"), F.lit(""))
    created = F.when(F.col("l_returnflag") == "N", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
        .when(F.col("l_returnflag") == "A", F.date_format(stamp, "MM/dd/yyyy")) \
        .when(flag == "RO", F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))).otherwise("not-a-date")
    k = F.col("o_orderkey")
    return rows.select(
        F.when(F.col("l_discount") == 0.1, "").when((F.col("l_discount") == 0.09) & (F.col("l_tax") == 0.08), "no-uuid").otherwise(uid("ALT", k)).alias("id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(uid("CSE", F.col("o_custkey") % 25)).alias("cse_id"), uid("AST", F.col("o_custkey")).alias("asset_id"),
        F.lit("SIEM").alias("source_system"), flag.alias("category"),
        _pick(F.substring("o_orderpriority", 1, 1), {"1": "P1", "2": " sev-2 ", "3": "med", "4": ""}, "weird").alias("severity"),
        F.col("o_orderpriority").alias("raw_severity"), F.lit("OPEN").alias("status"), created.alias("created_at"), *LINE_ORDER)


cte("raw_alerts", "", f"""SELECT CASE WHEN l_discount = 0.1::double THEN '' WHEN l_discount = 0.09::double AND l_tax = 0.08::double THEN 'no-uuid' ELSE {uid_sql('ALT', 'o_orderkey')} END AS id,
 CASE WHEN o_orderstatus = 'P' THEN '' ELSE {uid_sql('CSE', '(o_custkey % 25)')} END AS cse_id, {uid_sql('AST', 'o_custkey')} AS asset_id, coalesce(l_returnflag || l_linestatus, '') AS category,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P1' WHEN '2' THEN ' sev-2 ' WHEN '3' THEN 'med' WHEN '4' THEN '' ELSE 'weird' END AS severity, o_orderpriority AS raw_severity,
 CASE WHEN l_returnflag = 'N' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN l_returnflag = 'A' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN l_linestatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+02:00' ELSE 'not-a-date' END AS created_at,
 CASE WHEN l_returnflag IN ('N','A') THEN o_orderdate WHEN l_linestatus = 'O' THEN o_orderdate - INTERVAL 2 HOUR END AS parsed, {', '.join(LINE_ORDER)} FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
cte("first_alerts", "raw_alerts", f"""SELECT * FROM (SELECT *, CASE WHEN id = '' THEN sha256(concat_ws(':', 'alerts', cse_id, asset_id, created_at, category)) ELSE 'alerts:' || id END AS record_key FROM raw_alerts)
 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY {', '.join(LINE_ORDER)}) = 1""")
cte("checked_alerts", "first_alerts", """SELECT *, CASE WHEN id = 'no-uuid' THEN 'Malformed record identifier' WHEN cse_id = '' THEN 'Missing required Alert fields: cse_id or asset_id'
 WHEN parsed IS NULL THEN 'Invalid or unparseable alert created_at timestamp' END AS issue FROM first_alerts""")
_UU = "regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _alerts(spark, d, stage=None):
    return I.ingest(raw_alerts(spark, d), "alerts", LINE_ORDER, IMPORT_ID, AS_OF, stage)


@query("ingest_alerts", "checked_alerts", f"""SELECT CASE WHEN id = '' THEN {_UU.format('record_key')} ELSE id END AS id, cse_id, asset_id, category, CASE severity WHEN 'P1' THEN 'CRITICAL' WHEN ' sev-2 ' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 raw_severity, strftime(parsed, '%Y-%m-%dT%H:%M:%S') AS created_at FROM checked_alerts WHERE issue IS NULL""")
def ingest_alerts(spark, d):
    return _alerts(spark, d).valid.select("id", "cse_id", "asset_id", "category", "severity", "raw_severity", S.iso(F.col("created_at")).alias("created_at"))


@query("ingest_quarantine", "checked_alerts", f"SELECT {IMPORT_SQL} AS dataset_import_id, 'INVALID_ALERTS_RECORD' AS issue_type, id AS record_ref, issue AS description, record_key FROM checked_alerts WHERE issue IS NOT NULL")
def ingest_quarantine(spark, d):
    return _alerts(spark, d).quarantined.select("dataset_import_id", "issue_type", "record_ref", "description", "record_key")


@query("ingest_first_records", "first_alerts", "SELECT record_key, category, l_linenumber FROM first_alerts")
def ingest_first_records(spark, d):
    return I.first_records(raw_alerts(spark, d), "alerts", LINE_ORDER).select("record_key", "category", "l_linenumber")


cte("alert_counters", "checked_alerts raw_alerts", """SELECT (SELECT count(*) FROM raw_alerts) AS total, count(*) FILTER (issue IS NULL) AS accepted, count(*) FILTER (issue IS NOT NULL) AS quarantined, (SELECT count(*) FROM raw_alerts) - count(*) AS duplicates,
 count(*) FILTER (issue LIKE '%timestamp%') AS bad_ts, count(*) FILTER (issue LIKE '%cse%') AS bad_cse FROM checked_alerts""")


@query("import_record", "alert_counters", f"""SELECT 'alerts.csv' AS filename, 'FILE_INGEST_ALERTS' AS source, total AS row_count, accepted AS accepted_count, quarantined AS quarantined_count, CASE WHEN quarantined = 0 THEN 'COMPLETED' ELSE 'QUARANTINED' END AS status,
 {r('accepted / total * 100.0::double', 2)} AS completeness_score FROM alert_counters""")
def import_record(spark, d):
    return I.import_record(_alerts(spark, d).counters, "alerts.csv", "alerts", IMPORT_ID).drop("dataset_import_id")


@query("import_quality", "alert_counters", f"""SELECT *, {r('completeness_pct * 0.35::double + timestamp_validity_pct * 0.25::double + asset_mapping_pct * 0.2::double + cse_mapping_pct * 0.2::double', 2)} AS overall_quality_score,
 CASE WHEN completeness_pct >= 95 THEN 1.0::double WHEN completeness_pct >= 80 THEN 0.85::double WHEN completeness_pct >= 60 THEN 0.65::double ELSE 0.4::double END AS confidence_modifier FROM (SELECT total, accepted, quarantined, duplicates,
 {r('accepted / total * 100.0::double', 2)} AS completeness_pct, {r('(total - bad_ts) / total * 100.0::double', 2)} AS timestamp_validity_pct, 100.0::double AS asset_mapping_pct, {r('(total - bad_cse) / total * 100.0::double', 2)} AS cse_mapping_pct,
 {r('duplicates / total * 100.0::double', 2)} AS duplicate_rate_pct, {r('quarantined / total * 100.0::double', 2)} AS invalid_rate_pct FROM alert_counters)""")
def import_quality(spark, d):
    return QL.import_quality(_alerts(spark, d).counters)


# --- the other entity types ---------------------------------------------------------------
def _raw(spark, d, entity):
    t = Tables(spark, d)
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    if entity == "cses":
        return t.nation.select(uid("CSE", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "").otherwise("ENERGY").alias("sector"))
    if entity == "assets":
        return t.customer.select(uid("AST", c).alias("id"), uid("CSE", F.col("c_nationkey")).alias("cse_id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("name"),
                                 F.col("c_mktsegment").alias("asset_type"), _pick(F.col("c_mktsegment"), {"MACHINERY": "tier_1", "BUILDING": " High ", "AUTOMOBILE": "LOW"}, "other").alias("criticality"))
    if entity == "analysts":
        return t.supplier.select(uid("ANL", F.col("s_suppkey")).alias("id"), uid("CSE", F.col("s_nationkey")).alias("cse_id"),
                                 F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")).alias("handle"))
    if entity == "investigations":
        return t.lineitem.select(
            uid("INV", F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("id"), F.when(F.col("l_tax") == 0.08, "").otherwise(uid("ALT", F.col("l_orderkey"))).alias("alert_id"),
            F.when(F.col("l_discount") == 0.07, "nobody").when(F.col("l_discount") == 0.06, "").otherwise(uid("ANL", F.col("l_suppkey"))).alias("analyst_id"),
            F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy/MM/dd").alias("started_at"),
            F.when(F.col("l_discount") == 0.1, "0").when(F.col("l_discount") == 0.09, "12.5").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("duration_seconds"), *LINE_ORDER)
    if entity == "escalations":
        return t.orders.select(uid("ESC", o).alias("id"), F.when(F.col("o_orderstatus") == "O", "").otherwise(uid("INV", o)).alias("investigation_id"),
                               F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")).alias("escalated_at"))
    if entity == "cases":
        return t.orders.select(uid("CAS", o).alias("id"), F.when(F.col("o_orderstatus") == "P", "x").otherwise(uid("CSE", F.col("o_custkey") % 25)).alias("cse_id"),
                               F.date_format(F.col("o_orderdate").cast("timestamp"), "dd MMM yyyy").alias("opened_at"), F.lit("").alias("closed_at"))
    if entity == "closures":
        words = {"1": "True Positive", "2": "FALSE_POSITIVE", "3": "false alarm", "4": "benign"}
        return t.orders.select(uid("CLO", o).alias("id"), uid("CAS", o).alias("case_id"), _pick(F.substring("o_orderpriority", 1, 1), words, F.when(F.col("o_orderstatus") == "F", "dup").otherwise("")).alias("disposition_type"),
                               F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("closed_at"))
    return t.customer.select(uid("MNT", c).alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(uid("CSE", F.col("c_nationkey"))).alias("cse_id"),
                             F.when(F.col("c_acctbal") > 9000, "").otherwise(uid("AST", c)).alias("asset_id"), F.lit("2024-01-10T00:00:00Z").alias("start_time"))


def _valid(spark, d, entity):
    order = LINE_ORDER if entity == "investigations" else ["id"]
    return I.ingest(_raw(spark, d, entity), entity, order, IMPORT_ID, AS_OF)


_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
_ENTITY = {
    "cses": (["id", "name", "sector", "entity_type", "size_tier"], f"SELECT {uid_sql('CSE', 'n_nationkey')} AS id, n_name AS name, 'ENERGY' AS sector, 'OPERATOR' AS entity_type, 'TIER_1' AS size_tier FROM nation WHERE n_regionkey <> 0"),
    "assets": (["id", "cse_id", "name", "asset_type", "criticality", "status"], f"SELECT {uid_sql('AST', 'c_custkey')} AS id, {uid_sql('CSE', 'c_nationkey')} AS cse_id, c_name AS name, c_mktsegment AS asset_type, CASE c_mktsegment WHEN 'MACHINERY' THEN 'CRITICAL' WHEN 'BUILDING' THEN 'HIGH' WHEN 'AUTOMOBILE' THEN 'LOW' ELSE 'MEDIUM' END AS criticality, 'ACTIVE' AS status FROM customer WHERE c_acctbal >= 0"),
    "analysts": (["id", "cse_id", "handle", "role"], f"SELECT {uid_sql('ANL', 's_suppkey')} AS id, {uid_sql('CSE', 's_nationkey')} AS cse_id, s_name AS handle, 'ANALYST_L1' AS role FROM supplier WHERE s_acctbal >= 0"),
    "investigations": (["id", "alert_id", "analyst_id", "started_at", "duration_seconds", "outcome"], f"""SELECT {uid_sql('INV', "l_orderkey || '-' || l_linenumber")} AS id, {uid_sql('ALT', 'l_orderkey')} AS alert_id, CASE WHEN l_discount <> 0.06::double THEN {uid_sql('ANL', 'l_suppkey')} END AS analyst_id,
 {_ISO('l_shipdate')} AS started_at, CASE WHEN l_discount NOT IN (0.1::double, 0.09::double) AND l_quantity >= 1 THEN l_quantity::BIGINT END AS duration_seconds, 'CLOSED' AS outcome FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) = 1) WHERE l_tax <> 0.08::double AND l_discount <> 0.07::double"""),
    "escalations": (["id", "investigation_id", "escalated_to", "escalated_at"], f"SELECT {uid_sql('ESC', 'o_orderkey')} AS id, {uid_sql('INV', 'o_orderkey')} AS investigation_id, 'SOC_LEAD' AS escalated_to, {_ISO(f'CASE WHEN o_orderstatus = chr(80) THEN {AS_OF_SQL} ELSE o_orderdate END')} AS escalated_at FROM orders WHERE o_orderstatus <> 'O'"),
    "cases": (["id", "cse_id", "status", "opened_at", "closed_at"], f"SELECT {uid_sql('CAS', 'o_orderkey')} AS id, {uid_sql('CSE', '(o_custkey % 25)')} AS cse_id, 'OPEN' AS status, {_ISO('o_orderdate')} AS opened_at, NULL::varchar AS closed_at FROM orders WHERE o_orderstatus <> 'P'"),
    "closures": (["id", "case_id", "disposition_type", "closed_by", "closed_at"], f"SELECT {uid_sql('CLO', 'o_orderkey')} AS id, {uid_sql('CAS', 'o_orderkey')} AS case_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'TRUE_POSITIVE' WHEN '2' THEN 'TRUE_POSITIVE' WHEN '3' THEN 'FALSE_POSITIVE' WHEN '4' THEN 'BENIGN_POSITIVE' ELSE CASE WHEN o_orderstatus = 'F' THEN 'DUPLICATE' ELSE 'INCONCLUSIVE' END END AS disposition_type, 'SYSTEM' AS closed_by, {_ISO('o_orderdate')} AS closed_at FROM orders"),
    "maintenance_logs": (["id", "cse_id", "asset_id", "maintenance_ref", "start_time", "end_time"], f"SELECT {uid_sql('MNT', 'c_custkey')} AS id, {uid_sql('CSE', 'c_nationkey')} AS cse_id, CASE WHEN c_acctbal <= 9000 THEN {uid_sql('AST', 'c_custkey')} END AS asset_id, 'MAINT_REF_UNSPECIFIED' AS maintenance_ref, '2024-01-10T00:00:00' AS start_time, {_ISO(AS_OF_SQL)} AS end_time FROM customer WHERE c_acctbal >= 0"),
}
for _name, (_cols, _sql) in _ENTITY.items():
    def _run(spark, d, entity=_name, cols=_cols):
        out = _valid(spark, d, entity).valid
        times = {f.name for f in out.schema if f.dataType.typeName() == "timestamp"}
        return out.select(*[S.iso(F.col(c)).alias(c) if c in times else F.col(c) for c in cols])
    query(f"ingest_{_name}", "", _sql)(_run)


@query("ingest_issue_counts", "checked_alerts", """SELECT 'alerts' AS entity, issue AS description, count(*) AS n FROM checked_alerts WHERE issue IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'cses', 'Missing required CSE fields: name or sector', count(*) FROM nation WHERE n_regionkey = 0
 UNION ALL SELECT 'cases', 'Malformed reference identifier', count(*) FROM orders WHERE o_orderstatus = 'P'
 UNION ALL SELECT 'escalations', 'Missing required Escalation field: investigation_id', count(*) FROM orders WHERE o_orderstatus = 'O'""")
def ingest_issue_counts(spark, d):
    out = None
    for entity in ("alerts", "cses", "cases", "escalations"):
        bad = (_alerts(spark, d) if entity == "alerts" else _valid(spark, d, entity)).quarantined
        part = bad.select(F.lit(entity).alias("entity"), "description")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("entity", "description").agg(F.count(F.lit(1)).alias("n"))


def _arrived(batch, entity, *more):
    """The keys of a batch's valid rows, and ``more`` columns, stored: an import looks at them several times, and each would repeat the de-duplication."""
    keys = dict.fromkeys([name for kind in I.KNOWN_BY[entity] for name in kind])
    return written(batch.valid.select(*keys, *more), "arrived", scratch(batch.valid.sparkSession))


@query("ingest_only_new", "", f"""SELECT {uid_sql('CLO', 'o_orderkey')} AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus <> 'O'""")
def ingest_only_new(spark, d):
    """Closures of which some are known by id and some only by their case."""
    fresh = _arrived(_valid(spark, d, "closures"), "closures")
    orders = Tables(spark, d).orders
    by_id = orders.where("o_orderstatus = 'F'").select(uid("CLO", F.col("o_orderkey")).alias("id"), F.lit("-").alias("case_id"))
    by_case = orders.where("o_orderstatus = 'O'").select(F.lit("-").alias("id"), uid("CAS", F.col("o_orderkey")).alias("case_id"))
    index = KI.built(by_id.unionByName(by_case), I.KNOWN_BY["closures"], scratch(spark, "keys"), KEY_CAPACITY)
    return index.only_new(fresh, I.KNOWN_BY["closures"]).select("id")


@query("ingest_only_new_alerts", "checked_alerts", f"""SELECT CASE WHEN id = '' THEN {_UU.format('record_key')} ELSE id END AS id FROM checked_alerts WHERE issue IS NULL AND severity <> 'P1'""")
def ingest_only_new_alerts(spark, d):
    """A second import of the alerts of which the critical ones are known already."""
    fresh = _arrived(_alerts(spark, d), "alerts", "severity")
    index = KI.built(fresh.where("severity = 'CRITICAL'"), I.KNOWN_BY["alerts"], scratch(spark, "keys"), KEY_CAPACITY)
    return index.only_new(fresh, I.KNOWN_BY["alerts"]).select("id")


# --- profile and quality score -----------------------------------------------------------
RAW_COLUMNS = ["id", "cse_id", "asset_id", "category", "severity", "raw_severity", "created_at"]
cte("column_profile", "raw_alerts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (length(trim({c})) = 0) AS null_count, {r(f'count(*) FILTER (length(trim({c})) = 0) / count(*) * 100.0::double', 2)} AS null_pct FROM raw_alerts" for c in RAW_COLUMNS))
cte("table_profile", "raw_alerts", f"""SELECT n AS total_records, {len(RAW_COLUMNS)}::BIGINT AS total_columns, n - k AS duplicate_records, {r('(n - k) / n * 100.0::double', 2)} AS duplicate_pct, lo AS timestamp_min, hi AS timestamp_max FROM
 (SELECT count(*) AS n, min(created_at) AS lo, max(created_at) AS hi FROM raw_alerts), (SELECT count(*) AS k FROM (SELECT DISTINCT {', '.join(RAW_COLUMNS)} FROM raw_alerts))""")
cte("dist", "raw_alerts", "SELECT kind, value, count(*) AS n FROM (SELECT 'severity' AS kind, upper(severity) AS value FROM raw_alerts UNION ALL SELECT 'category', category FROM raw_alerts UNION ALL SELECT 'entity', cse_id FROM raw_alerts) WHERE value <> '' GROUP BY 1, 2")


@query("profile_columns", "column_profile", "SELECT * FROM column_profile")
def profile_columns(spark, d):
    return QL.column_profile(raw_alerts(spark, d), RAW_COLUMNS)


@query("profile_table", "table_profile", "SELECT * FROM table_profile")
def profile_table(spark, d):
    return QL.table_profile(raw_alerts(spark, d), RAW_COLUMNS, "created_at")


@query("profile_distributions", "dist", "SELECT * FROM dist")
def profile_distributions(spark, d):
    return QL.distributions(raw_alerts(spark, d))


@query("profile_top_entities", "dist", "SELECT kind, value, n FROM dist WHERE kind = 'entity' ORDER BY n DESC, value LIMIT 10")
def profile_top_entities(spark, d):
    return QL.top_entities(QL.distributions(raw_alerts(spark, d)))


@query("quality_score", "column_profile table_profile dist", f"""SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
 SELECT completeness, validity, consistency, uniqueness, timeliness, schema_conformity, {r('completeness * 0.25::double + validity * 0.2::double + consistency * 0.15::double + uniqueness * 0.15::double + timeliness * 0.1::double + schema_conformity * 0.15::double', 1)} AS overall_score,
 nulls > 5 AS advise_missing_fields, duplicate_pct > 2 AS advise_deduplication FROM (SELECT {r('100.0::double - nulls', 1)} AS completeness, {r('100.0::double - bad / n * 100.0::double', 1)} AS validity, 98.0::double AS consistency, {r('100.0::double - duplicate_pct', 1)} AS uniqueness,
 100.0::double AS timeliness, 100.0::double AS schema_conformity, nulls, duplicate_pct FROM (SELECT avg(null_pct) AS nulls FROM column_profile WHERE column_name IN ('created_at','severity','category','cse_id','asset_id')),
 (SELECT sum(n) AS n, coalesce(sum(n) FILTER (value NOT IN ('CRITICAL','HIGH','MEDIUM','LOW')), 0) AS bad FROM dist WHERE kind = 'severity'), table_profile))""")
def quality_score(spark, d):
    rows = raw_alerts(spark, d)
    return QL.quality_score(QL.column_profile(rows, RAW_COLUMNS), QL.table_profile(rows, RAW_COLUMNS, "created_at"), QL.distributions(rows), RAW_COLUMNS)


# --- external logs and file handling ---------------------------------------------------------
@query("soc_logs", "", """SELECT cast(event_id as varchar) AS alert_id, 'CSE-EXT-01' AS cse_id, 'host-' || user_id AS asset_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, event_type AS category,
 CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'CLOSED' AS status, props AS signature, 'DERIVED' AS severity_origin FROM events""")
def soc_logs(spark, d):
    e = Tables(spark, d).events
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                    F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host_id"), F.col("event_type").alias("category"),
                    _pick(F.col("event_type"), {"error": "very_high", "purchase": "2", "signup": "med"}, "SEV5").alias("severity"), F.col("props").alias("description"))
    out = SL.normalise(rows, AS_OF)
    return out.select("alert_id", "cse_id", "asset_id", S.iso(F.col("created_at")).alias("created_at"), "category", "severity", "status",
                      F.col("details.signature").alias("signature"), F.col("field_provenance")["severity"].alias("severity_origin"))


@query("file_entity_types", "", """SELECT doc_id, CASE WHEN lower(source) LIKE '%alert%' THEN 'alerts' WHEN lower(source) LIKE '%asset%' THEN 'assets' WHEN lower(source) LIKE '%cse%' THEN 'cses' WHEN lower(source) LIKE '%investigation%' THEN 'investigations'
 WHEN lower(source) LIKE '%escalation%' THEN 'escalations' WHEN lower(source) LIKE '%case%' THEN 'cases' WHEN lower(source) LIKE '%closure%' THEN 'closures' WHEN lower(source) LIKE '%analyst%' THEN 'analysts' ELSE 'unknown' END AS entity
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ALERTS_' WHEN 1 THEN 'case_asset_' WHEN 2 THEN 'closures-' ELSE 'maintenance_logs_' END || source AS source FROM documents)""")
def file_entity_types(spark, d):
    docs = Tables(spark, d).documents
    name = F.concat(_pick(F.col("doc_id") % 4, {0: "ALERTS_", 1: "case_asset_", 2: "closures-"}, "maintenance_logs_"), F.col("source"))
    return docs.select("doc_id", FS.entity_column(name).alias("entity"))


@query("json_array_records", "", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source, length(text)::BIGINT AS n FROM documents")
def json_array_records(spark, d):
    """Documents written as JSON arrays and read back by ranges; their texts hold quotes, brackets and line breaks."""
    folder = scratch(spark, "arrays")
    SK.export_json_arrays(Tables(spark, d).documents.select("doc_id", "text", "source"), folder)
    rows = FS.read_json_array(spark, folder, T.StructType.fromDDL("doc_id string, text string, source string"))
    return rows.select("doc_id", "text", "source", F.char_length("text").cast("long").alias("n"))


@query("file_checksums")
def file_checksums(spark, d):
    """Checksums of the source files against the manifest stored before; file bytes are not visible to SQL."""
    path, actual = f"{scratch(spark, 'manifest')}/files", MF.file_checksums(spark, f"{d}/*.parquet")
    SK.save_manifest(actual, path)
    return MF.verify(SK.load_manifest(spark, path, "file_name string, file_size_bytes long, sha256_checksum string"), actual)


def _customer_files(spark, d, folder, change):
    """A text file of customers per nation; files are written by nation, lines by key."""
    c = change(Tables(spark, d).customer.select("c_nationkey", "c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("balance")))
    first = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) == 1
    c = c.withColumn("first", first).select("c_nationkey", "c_custkey", F.concat_ws("|", "c_custkey", F.when(F.col("marked") & F.col("first"), F.upper("c_name")).otherwise(F.lower("c_name")), "balance").alias("value"))
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(folder)


@query("manifest_ranges", "", """SELECT CAST(c_nationkey AS VARCHAR) AS file_name, CASE WHEN c_nationkey = 5 THEN 'MISSING' WHEN c_nationkey = 7 THEN 'NEW' WHEN c_nationkey IN (2, 11) THEN 'TAMPERED' ELSE 'AUTHENTIC' END AS status,
 CASE WHEN c_nationkey IN (2, 11) THEN 1 ELSE 0 END::BIGINT AS changed_ranges, CASE WHEN c_nationkey IN (2, 11) THEN 0 END::BIGINT AS first_changed_byte FROM customer GROUP BY c_nationkey""")
def manifest_ranges(spark, d):
    """A stored manifest against files of which one is gone, one is new, and two have another first line of the same length."""
    root, size = scratch(spark, "manifest"), 256
    _customer_files(spark, d, f"{root}/before", lambda c: c.where("c_nationkey <> 7").withColumn("marked", F.lit(False)))
    _customer_files(spark, d, f"{root}/after", lambda c: c.where("c_nationkey <> 5").withColumn("marked", F.col("c_nationkey").isin(2, 11)))
    nation = lambda path: F.regexp_extract(path, "c_nationkey=(\\d+)/", 1)
    stored, now = (written(HT.tree_manifest(spark, f"{root}/{part}", nation, size), f"tree_{part}", root) for part in ("before", "after"))
    return HT.verify_tree(stored, now, size)
