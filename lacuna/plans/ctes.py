"""The same estate as DuckDB common table expressions, for the SQL cross-checks."""

from __future__ import annotations

from lacuna.plans.lens import AS_OF, IMPORT_ID, RUN_ID

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    """Register a named subquery and the subqueries that it reads."""
    CTES[name] = (needs.split(), sql)


def with_ctes(needs: str, final: str) -> str:
    """``WITH`` clause holding what ``final`` needs, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][0]:
            visit(dep)
        done.append(name)

    for name in needs.split():
        visit(name)
    body = ",\n".join(f"\"{n}\" AS (\n{CTES[n][1]}\n)" for n in done)
    return f"WITH RECURSIVE {body}\n{final}" if body else final


def r(expr: str, digits: int) -> str:
    """Half-even rounding on the scaled double, as the Spark side does."""
    return f"(round_even(cast(({expr}) as double) * 1e{digits}::double, 0)::double / 1e{digits}::double)"


def one(expr: str) -> str:
    return f"cast({r(expr, 1)} as varchar)"


def key(*parts: str) -> str:
    return "sha256(concat_ws(':', " + ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts) + "))"


cte("entities", "", """SELECT 'CSE-' || n_nationkey AS id, n_name AS name, r_name AS sector, 'OPERATOR' AS entity_type,
 'TIER_' || (n_nationkey % 3 + 1) AS size_tier FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("assets", "", """SELECT 'AST-' || c_custkey AS id, 'CSE-' || c_nationkey AS cse_id, c_name AS name, c_mktsegment AS asset_type,
 CASE WHEN c_acctbal >= 7500 THEN 'CRITICAL' WHEN c_acctbal >= 3500 THEN 'HIGH' WHEN c_acctbal >= 0 THEN 'MEDIUM' ELSE 'LOW' END AS criticality,
 CASE WHEN c_custkey % 50 = 0 THEN 'DECOMMISSIONED' ELSE 'ACTIVE' END AS status FROM customer""")
cte("analysts", "", """SELECT 'ANL-' || s_suppkey AS id, 'CSE-' || s_nationkey AS cse_id, s_name AS handle, 'ANALYST_L1' AS role FROM supplier""")
cte("placed", "", """SELECT o.*, c_nationkey FROM (SELECT *, CASE WHEN o_custkey % 40 = 1 AND o_orderkey % 8 <> 0 THEN o_custkey - 1 ELSE o_custkey END AS asset_key
 FROM orders) o LEFT JOIN customer ON c_custkey = asset_key""")
cte("alerts", "placed", """SELECT 'ALT-' || o_orderkey AS id, 'CSE-' || c_nationkey AS cse_id, 'AST-' || asset_key AS asset_id, 'SIEM' AS source_system,
 ['AUTHENTICATION_FAILURE','MALWARE_DETECTION','PRIVILEGE_ESCALATION','EXFILTRATION_SUSPICION','RANSOMWARE'][CAST(o_orderkey % (3 + c_nationkey % 3) AS INT) + 1] AS category,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'INFO' ELSE 'LOW' END AS severity,
 o_orderpriority AS raw_severity, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status, o_orderdate AS created_at FROM placed""")
cte("first_lines", "", """SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
 l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_tax, l_linestatus, l_discount) = 1""")
cte("investigations", "first_lines", """SELECT 'INV-' || l_orderkey AS id, 'ALT-' || l_orderkey AS alert_id, 'ANL-' || l_suppkey AS analyst_id, l_shipdate AS started_at,
 CAST(l_quantity AS BIGINT) AS duration_seconds, CASE WHEN l_returnflag = 'R' THEN 'CLOSED' ELSE 'RESOLVED' END AS outcome FROM first_lines""")
cte("escalations", "first_lines", """SELECT 'ESC-' || l_orderkey AS id, 'INV-' || l_orderkey AS investigation_id, 'SOC_LEAD' AS escalated_to, l_shipdate AS escalated_at
 FROM first_lines WHERE l_tax >= 0.04""")
cte("case_rows", "placed first_lines", """SELECT * FROM placed LEFT JOIN first_lines ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
cte("cases", "case_rows", """SELECT 'CAS-' || o_orderkey AS id, 'CSE-' || c_nationkey AS cse_id, CASE WHEN l_linestatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status,
 o_orderdate AS opened_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS closed_at FROM case_rows""")
cte("closures", "case_rows", """SELECT 'CLO-' || o_orderkey AS id, 'CAS-' || o_orderkey AS case_id,
 CASE l_returnflag WHEN 'R' THEN 'FALSE_POSITIVE' WHEN 'A' THEN 'TRUE_POSITIVE' ELSE 'BENIGN_POSITIVE' END AS disposition_type,
 'ANL-' || l_suppkey AS closed_by, l_shipdate AS closed_at, CASE WHEN l_discount < 0.05 THEN 'reviewed' END AS justification
 FROM case_rows WHERE l_linestatus = 'F'""")
cte("maintenance", "", """SELECT 'MNT-' || c_custkey AS id, 'CSE-' || c_nationkey AS cse_id, 'AST-' || c_custkey AS asset_id FROM customer WHERE c_custkey % 20 = 0""")
cte("telemetry", "", """SELECT 'EVT-' || event_id AS id, 'CSE-' || c_nationkey AS cse_id, 'AST-' || user_id AS asset_id, upper(event_type) AS category, ts AS created_at
 FROM events LEFT JOIN customer ON c_custkey = user_id""")

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
RUN_SQL = f"'{RUN_ID}'"
IMPORT_SQL = f"'{IMPORT_ID}'"
