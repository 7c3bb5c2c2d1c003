"""Evidence graph as node and edge tables, its anomalies and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lacuna.functions import scalar as S
from lacuna.plans.lens import Estate

WORKFLOW_TYPES = ["INVESTIGATION", "ESCALATION", "CASE"]
NODE_TYPES = ["CSE", "ASSET", "ANALYST", "ALERT", "INVESTIGATION", "ESCALATION", "CASE", "CLOSURE", "MISSING_EXPECTED"]


def _node(df: DataFrame, kind: str, record: Column, *, cse: Column, status, ts: Column | None = None,
          criticality: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit(f"{kind}:"), record).alias("id"), F.lit(kind).alias("entity_type"),
        record.alias("canonical_record_id"), cse.alias("cse_id"),
        (S.iso(ts) if ts is not None else none).alias("timestamp"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (criticality if criticality is not None else none).alias("criticality"))


def nodes(est: Estate) -> DataFrame:
    """All entities as typed nodes, including explicit nodes for missing telemetry."""
    c = F.col
    owned_cases = est.cases.select(c("id").alias("case_id"), c("cse_id").alias("case_cse"))
    parts = [
        _node(est.entities, "CSE", c("id"), cse=c("id"), status="ACTIVE"),
        _node(est.assets, "ASSET", c("id"), cse=c("cse_id"), status=c("status"), criticality=c("criticality")),
        _node(est.analysts, "ANALYST", c("id"), cse=c("cse_id"), status="ACTIVE"),
        _node(est.alerts, "ALERT", c("id"), cse=c("cse_id"), status="REGISTERED", ts=c("created_at")),
        _node(est.owned_investigations, "INVESTIGATION", c("id"), cse=c("inv_cse"), status="COMPLETED"),
        _node(est.owned_escalations, "ESCALATION", c("id"), cse=c("inv_cse"), status="ESCALATED"),
        _node(est.cases, "CASE", c("id"), cse=c("cse_id"), status="OPEN"),
        _node(est.closures.join(owned_cases, "case_id", "left"), "CLOSURE", c("id"), cse=c("case_cse"), status="CLOSED"),
        _node(est.silent_assets, "MISSING_EXPECTED", c("id"), cse=c("cse_id"), status="ABSENT"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, src_kind: str, src: Column, dst_kind: str, dst: Column, rel: str, cse: Column,
          ts: Column | None = None) -> DataFrame:
    return df.select(F.concat(F.lit(f"{src_kind}:"), src).alias("src"), F.concat(F.lit(f"{dst_kind}:"), dst).alias("dst"),
                     F.lit(rel).alias("relationship"),
                     (S.iso(ts) if ts is not None else F.lit(None).cast("string")).alias("timestamp"), cse.alias("cse_id"))


def case_links(est: Estate, findings: DataFrame) -> DataFrame:
    """case_id with the source node of its RESULTS_IN edges.

    First choice: investigations of the findings that name the case, or their escalation. A case
    no finding names falls back to the first escalation of its entity, else the first investigation.
    """
    c = F.col
    esc = est.escalations.groupBy("investigation_id").agg(F.min("id").alias("escalation_id"))
    inv_of_alert = est.investigations.groupBy("alert_id").agg(F.min("id").alias("alert_inv"))
    refs = (findings.where("case_id is not null")
            .select("case_id", F.filter("evidence_refs", lambda x: x["source_table"] == "investigations")["source_record_id"].alias("invs"),
                    F.filter("evidence_refs", lambda x: x["source_table"] == "alerts")["source_record_id"].alias("alts"))
            .select("case_id", F.try_element_at("invs", F.lit(-1)).alias("ref_inv"), F.try_element_at("alts", F.lit(-1)).alias("alert_id")))
    named = (refs.join(inv_of_alert, "alert_id", "left")
             .select("case_id", F.coalesce("ref_inv", "alert_inv").alias("investigation_id"))
             .where("investigation_id is not null").distinct()
             .join(est.investigations.select(c("id").alias("investigation_id")), "investigation_id", "left_semi")
             .join(esc, "investigation_id", "left")
             .select("case_id", F.coalesce(F.concat(F.lit("ESCALATION:"), c("escalation_id")),
                                           F.concat(F.lit("INVESTIGATION:"), c("investigation_id"))).alias("src")).distinct())
    first_inv = est.owned_investigations.groupBy(c("inv_cse").alias("cse_id")).agg(F.min("id").alias("first_inv"))
    first_esc = est.owned_escalations.groupBy(c("inv_cse").alias("cse_id")).agg(F.min("id").alias("first_esc"))
    rest = (est.cases.select(c("id").alias("case_id"), "cse_id").join(named.select("case_id").distinct(), "case_id", "left_anti")
            .join(first_esc, "cse_id", "left").join(first_inv, "cse_id", "left")
            .select("case_id", F.coalesce(F.concat(F.lit("ESCALATION:"), c("first_esc")),
                                          F.concat(F.lit("INVESTIGATION:"), c("first_inv"))).alias("src"))
            .where("src is not null"))
    return named.unionByName(rest)


def edges(est: Estate, links: DataFrame) -> DataFrame:
    """All relationships whose two ends exist, one row per (src, dst). ``links`` is :func:`case_links`."""
    c = F.col
    known_cse = est.entities.select(c("id").alias("cse_id"), F.lit(True).alias("cse_known"))
    known_asset = est.assets.select(c("id").alias("asset_id"), F.lit(True).alias("asset_known"))
    owned = est.assets.join(known_cse.select("cse_id"), "cse_id", "left_semi")
    alerts = est.alerts.join(known_asset, "asset_id", "left").join(known_cse, "cse_id", "left")
    from_alert = F.coalesce(F.when(c("asset_known"), F.concat(F.lit("ASSET:"), c("asset_id"))),
                            F.when(c("cse_known"), F.concat(F.lit("CSE:"), c("cse_id"))))
    generated = (alerts.where(from_alert.isNotNull())
                 .select(from_alert.alias("src"), F.concat(F.lit("ALERT:"), c("id")).alias("dst"),
                         F.lit("GENERATES").alias("relationship"), S.iso(c("created_at")).alias("timestamp"), "cse_id"))
    inv = est.owned_investigations
    known_analyst = est.analysts.select(c("id").alias("analyst_id"))
    assigned = inv.join(known_analyst, "analyst_id", "left_semi")
    esc = est.owned_escalations.where("inv_known")
    cases = est.cases.select(c("id").alias("case_id"), "cse_id", "opened_at")
    linked = (links.join(cases, "case_id")
              .select("src", F.concat(F.lit("CASE:"), c("case_id")).alias("dst"), F.lit("RESULTS_IN").alias("relationship"),
                      S.iso(c("opened_at")).alias("timestamp"), "cse_id"))
    closed = est.closures.join(cases.select("case_id", "cse_id"), "case_id")
    parts = [
        _edge(owned, "CSE", c("cse_id"), "ASSET", c("id"), "OWNS", c("cse_id")),
        generated,
        _edge(inv.where("alert_known"), "ALERT", c("alert_id"), "INVESTIGATION", c("id"), "INVESTIGATES", c("inv_cse"), c("started_at")),
        _edge(assigned, "ANALYST", c("analyst_id"), "INVESTIGATION", c("id"), "ASSIGNED_TO", c("inv_cse")),
        _edge(esc, "INVESTIGATION", c("investigation_id"), "ESCALATION", c("id"), "ESCALATED_TO", c("inv_cse"), c("escalated_at")),
        linked,
        _edge(closed, "CASE", c("case_id"), "CLOSURE", c("id"), "CLOSED_BY", c("cse_id"), c("closed_at")),
        _edge(est.silent_assets, "ASSET", c("id"), "MISSING_EXPECTED", c("id"), "MISSING_EXPECTED", c("cse_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths(est: Estate, links: DataFrame) -> DataFrame:
    """Observed path per alert: investigation, then escalation or case, then closure.

    ``links`` is :func:`case_links`. Where several cases hang on one node the earliest
    (opened_at, id) is followed.
    """
    c = F.col
    cases = est.cases.select(c("id").alias("case_id"), "opened_at")
    first_case = (links.join(cases, "case_id").groupBy("src")
                  .agg(F.min(F.struct("opened_at", "case_id")).alias("hit"))
                  .select("src", c("hit.case_id").alias("case_id"), c("hit.opened_at").alias("opened_at")))
    inv = (est.investigations.groupBy("alert_id").agg(F.min(F.struct("id", "started_at")).alias("i"))
           .select("alert_id", c("i.id").alias("investigation_id"), c("i.started_at").alias("started_at")))
    esc = est.escalations.groupBy("investigation_id").agg(F.min("id").alias("escalation_id"))
    clo = est.closures.groupBy("case_id").agg(F.min("id").alias("closure_id"))
    direct = first_case.select(F.expr("substring(src, length('INVESTIGATION:') + 1)").alias("investigation_id"),
                               c("case_id").alias("direct_case"), c("opened_at").alias("direct_opened_at"), "src") \
        .where(c("src").startswith("INVESTIGATION:")).drop("src")
    behind = first_case.where(c("src").startswith("ESCALATION:")).select(
        F.expr("substring(src, length('ESCALATION:') + 1)").alias("escalation_id"), c("case_id").alias("escalated_case"))
    has_esc = c("escalation_id").isNotNull()
    # What follows an investigation is joined while it is narrow; the alert's own columns come last.
    chain = (inv.join(esc, "investigation_id", "left").join(direct, "investigation_id", "left").join(behind, "escalation_id", "left")
             .withColumn("case_id", F.when(has_esc, c("escalated_case")).otherwise(c("direct_case"))).drop("escalated_case")
             .join(clo, "case_id", "left"))
    rows = est.alerts.select(c("id").alias("alert_id"), "cse_id", "severity", "created_at").join(chain, "alert_id", "left")
    steps = F.filter(F.array(F.lit("ALERT"), F.when(c("investigation_id").isNotNull(), "INVESTIGATION"),
                             F.when(has_esc, "ESCALATION"), F.when(c("case_id").isNotNull(), "CASE"),
                             F.when(c("closure_id").isNotNull(), "CLOSURE")), lambda x: x.isNotNull())
    critical = c("severity") == "CRITICAL"
    expected = F.when(critical, F.lit("ALERT>INVESTIGATION>ESCALATION>CASE>CLOSURE")).otherwise(
        F.lit("ALERT>INVESTIGATION>CASE>CLOSURE"))
    return rows.select(
        "alert_id", "cse_id", "severity", expected.alias("expected_path"), F.array_join(steps, ">").alias("observed_path"),
        (critical & ~has_esc & c("direct_case").isNotNull()).alias("is_anomalous"),
        "created_at", "started_at", "direct_opened_at")


def temporal_checks(path_rows: DataFrame) -> DataFrame:
    """Timestamps along the path that run backwards, as booleans per alert."""
    early_inv = F.coalesce(F.col("started_at") < F.col("created_at"), F.lit(False))
    early_case = F.coalesce(F.col("direct_opened_at") < F.col("started_at"), F.lit(False))
    return path_rows.select("alert_id", "cse_id", early_inv.alias("investigation_before_alert"),
                            early_case.alias("case_before_investigation"), (~early_inv & ~early_case).alias("is_valid"))


def orphans(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Workflow nodes that nothing points to."""
    return (node_rows.where(F.col("entity_type").isin(WORKFLOW_TYPES))
            .join(edge_rows.select(F.col("dst").alias("id")), "id", "left_anti"))


def in_degrees(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    counted = edge_rows.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return node_rows.select("id", "entity_type").join(counted, "id", "left").fillna(0, ["in_degree"])


def analyst_shares(est: Estate) -> DataFrame:
    """Investigations per assigned analyst with the team totals beside them."""
    known = est.analysts.select(F.col("id").alias("analyst_id"))
    per = (est.investigations.join(known, "analyst_id", "left_semi")
           .groupBy("analyst_id").agg(F.count(F.lit(1)).alias("handled")))
    total, team = per.agg(F.sum("handled")).scalar(), per.agg(F.count(F.lit(1))).scalar()
    return (per.withColumn("total_handled", total).withColumn("team_size", team)
            .withColumn("share", F.col("handled") / F.col("total_handled")))


def anomalies(est: Estate, links: DataFrame, node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """The six detectors as one table."""
    c = F.col
    path_rows = paths(est, links)
    shape = lambda df, kind, severity, source, cse, detail, evidence: df.select(
        F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), source.alias("source_node"), cse.alias("cse_id"),
        detail.alias("detail"), F.lit(evidence).alias("evidence_type"))
    no_cse = F.lit(None).cast("string")
    missing = shape(path_rows.where("is_anomalous"), "MISSING_TRANSITION", "HIGH", F.concat(F.lit("ALERT:"), c("alert_id")),
                    c("cse_id"), F.lit("INVESTIGATION>ESCALATION"), "WORKFLOW_TRANSITION")
    checks = temporal_checks(path_rows).withColumn("what", F.explode(F.filter(F.array(
        F.when(c("investigation_before_alert"), F.lit("INVESTIGATION_BEFORE_ALERT")),
        F.when(c("case_before_investigation"), F.lit("CASE_BEFORE_INVESTIGATION"))), lambda x: x.isNotNull())))
    backwards = shape(checks, "TEMPORAL_VIOLATION", "HIGH", F.concat(F.lit("ALERT:"), c("alert_id")), c("cse_id"), c("what"), "DATA_QUALITY")
    loose = shape(orphans(node_rows, edge_rows), "ORPHAN_ENTITY", "MEDIUM", c("id"), c("cse_id"), c("entity_type"), "MISSING_EXPECTED_RECORD")
    n_esc = est.escalations.agg(F.count(F.lit(1))).scalar()
    counts = (est.investigations.agg(F.count(F.lit(1)).alias("inv")).withColumn("esc", n_esc)
              .withColumn("ratio", S.ratio(c("esc"), c("inv"))))
    bottleneck = shape(counts.where("inv >= 5 AND ratio < 0.15"), "WORKFLOW_BOTTLENECK", "HIGH", F.lit("GRAPH_AGGREGATE"), no_cse,
                       c("ratio").cast("string"), "STATISTICAL_DEVIATION")
    crowded = shape(analyst_shares(est).where("total_handled >= 10 AND team_size >= 3 AND share > 0.40"), "ANALYST_CONCENTRATION",
                    "MEDIUM", F.concat(F.lit("ANALYST:"), c("analyst_id")), no_cse, S.rounded(c("share"), 4).cast("string"), "PEER_COMPARISON")
    silent = shape(est.silent_assets, "MISSING_EXPECTED_ACTIVITY", "HIGH", F.concat(F.lit("MISSING_EXPECTED:"), c("id")), c("cse_id"),
                   F.lit("no alerts"), "MISSING_EXPECTED_RECORD")
    out = missing
    for p in (backwards, loose, bottleneck, crowded, silent):
        out = out.unionByName(p)
    return out


def type_counts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Node counts by type and edge counts by relationship."""
    n = node_rows.groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    e = edge_rows.groupBy(F.col("relationship").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "name", "n")


def metrics(node_rows: DataFrame, edge_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of graph-level numbers; ``labels`` are those of the components."""
    of = lambda kind: S.count_where(F.col("entity_type") == kind)
    n = node_rows.agg(F.count(F.lit(1)).alias("node_count"), of("INVESTIGATION").alias("inv"), of("ESCALATION").alias("esc"),
                      of("CASE").alias("cas"), of("CLOSURE").alias("clo"), of("MISSING_EXPECTED").alias("missing_expected_count"))
    n_edges = edge_rows.agg(F.count(F.lit(1))).scalar()
    n_orphans = orphans(node_rows, edge_rows).agg(F.count(F.lit(1))).scalar()
    n_parts = labels.where("id = label").agg(F.countDistinct("label")).scalar()
    return n.withColumn("edge_count", n_edges).withColumn("orphan_nodes_count", n_orphans).withColumn("component_count", n_parts).select(
        "node_count", "edge_count", S.ratio(F.col("esc"), F.col("inv")).alias("escalation_investigation_ratio"),
        S.ratio(F.col("clo"), F.col("cas")).alias("closure_case_ratio"), "orphan_nodes_count", "missing_expected_count", "component_count")


def induced(node_rows: DataFrame, edge_rows: DataFrame, entity_type: str = "ALL", cap: int = 40) -> tuple[DataFrame, DataFrame]:
    """The display subgraph: the first ``cap`` nodes of a type and the edges among them."""
    picked = node_rows if entity_type == "ALL" else node_rows.where(F.col("entity_type") == entity_type)
    place = F.array_position(F.array(*[F.lit(t) for t in NODE_TYPES]), F.col("entity_type"))
    picked = picked.orderBy(place, "id").limit(cap)
    ids = F.broadcast(picked.select("id"))  # at most ``cap`` rows
    inside = (edge_rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
              .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return picked, inside
