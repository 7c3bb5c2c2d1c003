"""The commerce test tables seen as a supervised estate.

Entities are nations, assets are customers, alerts are orders, an investigation is the
first line of an order, analysts are suppliers, and telemetry is the event stream. Every
row of every source table is kept; the mapping only renames and classifies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.schemas import SOURCE_DDL
from lacuna.session import use_row_sizes, use_utc

AS_OF = "2024-01-31 00:00:00"
RUN_ID = "RUN-1"
IMPORT_ID = "IMPORT-1"


@dataclass
class Estate:
    """Canonical tables of one supervised estate at one point in time."""

    entities: DataFrame
    assets: DataFrame
    analysts: DataFrame
    alerts: DataFrame
    investigations: DataFrame
    escalations: DataFrame
    cases: DataFrame
    closures: DataFrame
    maintenance: DataFrame
    telemetry: DataFrame
    as_of: str = AS_OF
    run_id: str = RUN_ID
    import_id: str = IMPORT_ID
    completeness: float = 100.0

    @property
    def owned_investigations(self) -> DataFrame:
        """Investigations with the entity of their alert."""
        owner = self.alerts.select(F.col("id").alias("alert_id"), F.col("cse_id").alias("inv_cse"), F.lit(True).alias("alert_known"))
        return self.investigations.join(owner, "alert_id", "left")

    @property
    def owned_escalations(self) -> DataFrame:
        """Escalations with the entity of their investigation's alert."""
        inv = self.owned_investigations.select(F.col("id").alias("investigation_id"), "inv_cse", F.lit(True).alias("inv_known"))
        return self.escalations.join(inv, "investigation_id", "left")

    @property
    def silent_assets(self) -> DataFrame:
        """Active critical assets that generated no alert."""
        return (self.assets.where("criticality = 'CRITICAL' AND status = 'ACTIVE'")
                .join(self.alerts.select(F.col("asset_id").alias("id")).distinct(), "id", "left_anti"))


class Tables:
    """Lazy access to one folder of source tables, each opened once with its declared schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = use_row_sizes(use_utc(spark))
        self.folder = folder
        self.opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.opened:
            reader = self.spark.read
            if name in SOURCE_DDL:
                reader = reader.schema(SOURCE_DDL[name])
            self.opened[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]


def tag(prefix: str, col):
    return F.concat(F.lit(f"{prefix}-"), col.cast("string"))


def entities(t: Tables) -> DataFrame:
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(tag("CSE", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"),
                    F.col("r_name").alias("sector"), F.lit("OPERATOR").alias("entity_type"),
                    F.concat(F.lit("TIER_"), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("size_tier")))


def assets(t: Tables) -> DataFrame:
    bal = F.col("c_acctbal")
    return t.customer.select(
        tag("AST", F.col("c_custkey")).alias("id"), tag("CSE", F.col("c_nationkey")).alias("cse_id"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("asset_type"),
        F.when(bal >= 7500, "CRITICAL").when(bal >= 3500, "HIGH").when(bal >= 0, "MEDIUM")
        .otherwise("LOW").alias("criticality"),
        F.when(F.col("c_custkey") % 50 == 0, "DECOMMISSIONED").otherwise("ACTIVE").alias("status"),
        F.lit(None).cast("timestamp").alias("decommissioned_at"))


def analysts(t: Tables) -> DataFrame:
    return t.supplier.select(tag("ANL", F.col("s_suppkey")).alias("id"),
                             tag("CSE", F.col("s_nationkey")).alias("cse_id"),
                             F.col("s_name").alias("handle"), F.lit("ANALYST_L1").alias("role"))


def _placed_orders(t: Tables) -> DataFrame:
    """Orders with the asset they concern. Most orders of every 40th customer are booked on
    its neighbour, which leaves that customer under-monitored without dropping a row."""
    thin = (F.col("o_custkey") % 40 == 1) & (F.col("o_orderkey") % 8 != 0)
    orders = t.orders.withColumn("asset_key", F.when(thin, F.col("o_custkey") - 1).otherwise(F.col("o_custkey")))
    owners = t.customer.select(F.col("c_custkey").alias("asset_key"), "c_nationkey")
    return orders.join(owners, "asset_key", "left")


def alerts(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("AUTHENTICATION_FAILURE", "MALWARE_DETECTION", "PRIVILEGE_ESCALATION",
                                         "EXFILTRATION_SUSPICION", "RANSOMWARE")])
    index = (F.col("o_orderkey") % (3 + F.col("c_nationkey") % 3)).cast("int")
    rank = F.substring("o_orderpriority", 1, 1)
    return _placed_orders(t).select(
        tag("ALT", F.col("o_orderkey")).alias("id"), tag("CSE", F.col("c_nationkey")).alias("cse_id"),
        tag("AST", F.col("asset_key")).alias("asset_id"), F.lit("SIEM").alias("source_system"),
        F.get(kinds, index).alias("category"),
        F.when(rank == "1", "CRITICAL").when(rank == "2", "HIGH").when(rank == "3", "MEDIUM")
        .when(rank == "4", "INFO").otherwise("LOW").alias("severity"),
        F.col("o_orderpriority").alias("raw_severity"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


#: Lines of a higher number are reduced where they are read. No usual order has as many, so file statistics skip that read.
MANY_LINES = 1024


def _first(lines: DataFrame) -> DataFrame:
    """The smallest line of every order, by ship date, then number, then the rest."""
    line = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                    "l_quantity", "l_returnflag", "l_tax", "l_linestatus", "l_discount")
    return lines.groupBy("l_orderkey").agg(F.min(line).alias("line")).select("l_orderkey", "line.*")


def first_lines(t: Tables) -> DataFrame:
    """The first line of every order. A min over a struct sorts its input, and orders scatter over the table, so sorting whole splits
    before the shuffle would spill them and save little; lines are shuffled first and sorted in parts of bounded size. Only an order with
    very many lines is reduced before, so it does not gather in one task."""
    many = (F.col("l_linenumber") > MANY_LINES) | F.col("l_linenumber").isNull()
    high = _first(t.lineitem.where(many))
    return _first(t.lineitem.where(~many).select(*high.columns).union(high).repartition("l_orderkey"))


def investigations(lines: DataFrame) -> DataFrame:
    return lines.select(
        tag("INV", F.col("l_orderkey")).alias("id"), tag("ALT", F.col("l_orderkey")).alias("alert_id"),
        tag("ANL", F.col("l_suppkey")).alias("analyst_id"),
        F.col("l_shipdate").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        F.col("l_quantity").cast("long").alias("duration_seconds"),
        F.when(F.col("l_returnflag") == "R", "CLOSED").otherwise("RESOLVED").alias("outcome"))


def escalations(lines: DataFrame) -> DataFrame:
    return (lines.where(F.col("l_tax") >= 0.04).select(
        tag("ESC", F.col("l_orderkey")).alias("id"), tag("INV", F.col("l_orderkey")).alias("investigation_id"),
        F.lit("SOC_LEAD").alias("escalated_to"), F.col("l_shipdate").cast("timestamp").alias("escalated_at"),
        F.lit("").alias("reason")))


def case_rows(t: Tables, lines: DataFrame) -> DataFrame:
    """Finished orders with their first line: what cases and closures are read from."""
    return (_placed_orders(t).where(F.col("o_orderstatus") == "F")
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select("o_orderkey", "o_orderdate", "c_nationkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_discount"))


def cases(rows: DataFrame) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    return rows.select(
        tag("CAS", F.col("o_orderkey")).alias("id"), tag("CSE", F.col("c_nationkey")).alias("cse_id"),
        F.when(done, "CLOSED").otherwise("OPEN").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("opened_at"),
        F.when(done, F.col("l_shipdate").cast("timestamp")).alias("closed_at"))


def closures(rows: DataFrame) -> DataFrame:
    return (rows.where(F.col("l_linestatus") == "F").select(
        tag("CLO", F.col("o_orderkey")).alias("id"), tag("CAS", F.col("o_orderkey")).alias("case_id"),
        F.when(F.col("l_returnflag") == "R", "FALSE_POSITIVE").when(F.col("l_returnflag") == "A", "TRUE_POSITIVE")
        .otherwise("BENIGN_POSITIVE").alias("disposition_type"),
        tag("ANL", F.col("l_suppkey")).alias("closed_by"),
        F.col("l_shipdate").cast("timestamp").alias("closed_at"),
        F.when(F.col("l_discount") < 0.05, "reviewed").alias("justification")))


def maintenance(t: Tables) -> DataFrame:
    return (t.customer.where(F.col("c_custkey") % 20 == 0).select(
        tag("MNT", F.col("c_custkey")).alias("id"), tag("CSE", F.col("c_nationkey")).alias("cse_id"),
        tag("AST", F.col("c_custkey")).alias("asset_id"), F.lit("CHANGE").alias("maintenance_ref"),
        F.to_timestamp(F.lit("2024-01-10 00:00:00")).alias("start_time"),
        F.to_timestamp(F.lit("2024-01-11 00:00:00")).alias("end_time"),
        F.lit("patching").alias("reason"), F.lit("SYSTEM").alias("approved_by")))


def telemetry(t: Tables) -> DataFrame:
    owners = t.customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return t.events.join(owners, "user_id", "left").select(
        tag("EVT", F.col("event_id")).alias("id"), tag("CSE", F.col("c_nationkey")).alias("cse_id"),
        tag("AST", F.col("user_id")).alias("asset_id"), F.upper("event_type").alias("category"),
        F.col("ts").cast("timestamp").alias("created_at"))


class LensEstate(Estate):
    """The estate of one source folder; tables are built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = Tables(spark, folder)

    first_lines = cached_property(lambda self: first_lines(self.tables))
    entities = cached_property(lambda self: entities(self.tables))
    assets = cached_property(lambda self: assets(self.tables))
    analysts = cached_property(lambda self: analysts(self.tables))
    alerts = cached_property(lambda self: alerts(self.tables))
    investigations = cached_property(lambda self: investigations(self.first_lines))
    escalations = cached_property(lambda self: escalations(self.first_lines))
    case_rows = cached_property(lambda self: case_rows(self.tables, self.first_lines))
    cases = cached_property(lambda self: cases(self.case_rows))
    closures = cached_property(lambda self: closures(self.case_rows))
    maintenance = cached_property(lambda self: maintenance(self.tables))
    telemetry = cached_property(lambda self: telemetry(self.tables))


class AssetEntityEstate(LensEstate):
    """Every asset as an entity of its own, for volume rules on fine-grained telemetry."""

    @cached_property
    def entities(self) -> DataFrame:
        return self.assets.select("id", "name", F.col("asset_type").alias("sector"),
                                  F.lit("OPERATOR").alias("entity_type"), F.lit("TIER_1").alias("size_tier"))

    @cached_property
    def telemetry(self) -> DataFrame:
        return telemetry(self.tables).withColumn("cse_id", F.col("asset_id"))

    @cached_property
    def maintenance(self) -> DataFrame:
        return maintenance(self.tables).withColumn("cse_id", F.col("asset_id"))


def estate(spark: SparkSession, folder: str) -> Estate:
    return LensEstate(spark, folder)


def asset_entities(spark: SparkSession, folder: str) -> Estate:
    return AssetEntityEstate(spark, folder)
