"""Declared schemas: source tables of the lens and canonical tables of the estate."""

from __future__ import annotations

# Source tables, as DDL. Times in these files are naive and mean UTC.
SOURCE_DDL = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Canonical tables, as DDL.
CANONICAL_DDL = {
    "cses": "id string, name string, sector string, entity_type string, size_tier string",
    "assets": "id string, cse_id string, name string, asset_type string, criticality string, status string",
    "analysts": "id string, cse_id string, handle string, role string",
    "alerts": "id string, cse_id string, asset_id string, source_system string, category string, severity string, "
              "raw_severity string, status string, created_at timestamp",
    "investigations": "id string, alert_id string, analyst_id string, started_at timestamp, ended_at timestamp, "
                      "duration_seconds bigint, notes string, outcome string",
    "escalations": "id string, investigation_id string, escalated_to string, escalated_at timestamp, reason string",
    "cases": "id string, cse_id string, status string, opened_at timestamp, closed_at timestamp",
    "closures": "id string, case_id string, disposition_type string, closed_by string, closed_at timestamp, justification string",
    "maintenance_logs": "id string, cse_id string, asset_id string, maintenance_ref string, start_time timestamp, "
                        "end_time timestamp, reason string, approved_by string",
}

# Order in which the tables of one export are loaded, parents first.
LOAD_ORDER = ["cses", "assets", "analysts", "alerts", "investigations", "escalations", "cases", "closures", "maintenance_logs"]
