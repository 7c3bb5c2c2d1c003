"""Evaluation of detections against ground truth, rankings, ablations and reproducibility.

Truth is a table (scenario_id, scenario_class, target_id, target_type, expected_rule, is_exception).
Only this module reads it; no detector does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna import params as P
from lacuna.functions import scalar as S
from lacuna.functions.digest import multiset_digest, row_hash
from lacuna.operators.order_statistics import with_percentiles
from lacuna.operators.risk import is_active

# --- fixed values: classes that count as anomalies, and rules judged per asset ----------
ANOMALY_CLASSES = ["EXECUTION_GAP", "NEGATIVE_SPACE", "PEER_ANOMALY", "MIXED_SIGNAL"]
ASSET_SCOPED_RULES = ["NEG-01", "NEG-04", "NEG-05", "GAP-01", "GAP-02", "GAP-03", "GAP-04", "GAP-05", "GAP-06"]
K_VALUES = [1, 3, 5, 10, 20]


def graph_evaluation(anomalies: DataFrame, findings: DataFrame) -> DataFrame:
    """Anomalies by type, with the share and depth of findings that trace back to records."""
    traced = F.size(F.coalesce("evidence_refs", F.array())) > 0
    trace = findings.agg(S.count_where(traced).alias("traced"), F.count(F.lit(1)).alias("n"))
    pct = trace.select(F.when(F.col("n") > 0, S.rounded(F.col("traced") / F.col("n") * 100.0, 2)).otherwise(F.lit(100.0))).scalar()
    depth = trace.select(F.when(F.coalesce("traced", F.lit(0)) > 0, F.lit(3.0)).otherwise(F.lit(0.0))).scalar()
    return (anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("traceability_pct", pct).withColumn("mean_depth", depth))


def finding_keys(findings: DataFrame) -> DataFrame:
    """(finding_id, rule_id, place, key): entity first, asset second, then the references in order."""
    keys = F.concat(F.array("cse_id", "asset_id"), F.transform("evidence_refs", lambda x: x["source_record_id"]))
    return (findings.select("finding_id", "rule_id", F.posexplode(keys).alias("place", "key")).where("key is not null"))


def matched_by_rule(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Findings one of whose keys is a target expected for the finding's rule."""
    targets = truth.select(F.col("expected_rule").alias("rule_id"), F.col("target_id").alias("key")).distinct()
    return finding_keys(findings).join(targets, ["rule_id", "key"], "left_semi").select("finding_id", "rule_id").distinct()


def binary_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    nothing = (tp + fn) == 0
    return (df.withColumn("precision", F.when(tp + fp > 0, S.rounded(tp / (tp + fp), 4)).when(nothing & (fp == 0), 1.0).otherwise(0.0))
            .withColumn("recall", F.when(tp + fn > 0, S.rounded(tp / (tp + fn), 4)).otherwise(1.0))
            .withColumn("f1_score", S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .withColumn("false_positive_rate", S.ratio(fp, fp + tn)))


def _judged(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Findings and matched findings per rule."""
    hit = matched_by_rule(findings, truth).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matched"))
    total = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("found"))
    return total.join(hit, "rule_id", "left").fillna(0, ["matched"])


def truth_evaluation(findings: DataFrame, truth: DataFrame, assets: DataFrame, entities: DataFrame) -> DataFrame:
    """Per-rule confusion counts; true positives are counted per finding."""
    anomalies = truth.where(F.col("scenario_class").isin(ANOMALY_CLASSES) & ~F.col("is_exception"))
    wanted = anomalies.groupBy(F.coalesce("expected_rule", F.lit("UNKNOWN_RULE")).alias("rule_id")).agg(F.count(F.lit(1)).alias("expected"))
    n_assets, n_entities = assets.agg(F.count(F.lit(1))).scalar(), entities.agg(F.count(F.lit(1))).scalar()
    rows = _judged(findings, anomalies).join(wanted, "rule_id", "full").fillna(0, ["found", "matched", "expected"])
    scope = F.when(F.col("rule_id").isin(ASSET_SCOPED_RULES), n_assets).otherwise(n_entities)
    rows = (rows.withColumn("tp", F.col("matched")).withColumn("fp", F.col("found") - F.col("matched"))
            .withColumn("fn", F.greatest(F.lit(0), F.col("expected") - F.col("matched")))
            .withColumn("tn", F.greatest(F.lit(0), scope - (F.col("tp") + F.col("fp") + F.col("fn")))))
    return binary_metrics(rows.select("rule_id", "tp", "fp", "fn", "tn"))


def overall(per_rule: DataFrame) -> DataFrame:
    """Micro totals and macro means of a per-rule table."""
    sums = per_rule.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
                        *[S.rounded(S.exact_mean(F.col(c), 4), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1_score")])
    return binary_metrics(sums)


def scenario_matches(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Each anomaly scenario with a strict yes or no: the key that must match depends on the target type."""
    active = findings.where(is_active())
    keyed = finding_keys(active).select("rule_id", "key", F.when(F.col("place") == 0, "CSE").when(F.col("place") == 1, "Asset")
                                        .otherwise("Ref").alias("kind")).distinct()
    kinds = (F.when(F.col("target_type") == "Asset", F.array(F.lit("Asset"))).when(F.col("target_type") == "CSE", F.array(F.lit("CSE")))
             .when(F.col("target_type").isin("Alert", "Investigation", "MaintenanceLog"), F.array(F.lit("Ref")))
             .otherwise(F.array(F.lit("CSE"), F.lit("Asset"))))
    wanted = truth.where("NOT is_exception")
    hit = (wanted.select("scenario_id", F.col("expected_rule").alias("rule_id"), F.col("target_id").alias("key"), F.explode(kinds).alias("kind"))
           .join(keyed, ["rule_id", "kind", "key"], "left_semi").select("scenario_id").distinct().withColumn("hit", F.lit(True)))
    return (wanted.join(hit, "scenario_id", "left")
            .select("scenario_id", "scenario_class", "target_type", "target_id", "expected_rule", F.coalesce("hit", F.lit(False)).alias("is_detected")))


def scenario_rule_metrics(findings: DataFrame, truth: DataFrame, assets: DataFrame) -> DataFrame:
    """Per-rule metrics where positives are scenarios and false positives are unmatched findings."""
    active = findings.where(is_active())
    per = scenario_matches(findings, truth).groupBy(F.col("expected_rule").alias("rule_id")).agg(
        S.count_where(F.col("is_detected")).alias("tp"), S.count_where(~F.col("is_detected")).alias("fn"))
    judged = _judged(active, truth.where("NOT is_exception")).select("rule_id", (F.col("found") - F.col("matched")).alias("fp"))
    n_assets = assets.agg(F.count(F.lit(1))).scalar()
    rows = per.join(judged, "rule_id", "full").fillna(0, ["tp", "fn", "fp"])
    rows = rows.withColumn("tn", F.greatest(F.lit(0), n_assets - (F.col("tp") + F.col("fp") + F.col("fn"))))
    return binary_metrics(rows.select("rule_id", "tp", "fp", "fn", "tn"))


def exception_safety(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """How many legitimate exceptions were left alone."""
    active = findings.where(is_active())
    flagged = active.select(F.explode(F.array("cse_id", "asset_id")).alias("target_id")).where("target_id is not null").distinct()
    calm = truth.where("is_exception").join(flagged.withColumn("flagged", F.lit(True)), "target_id", "left")
    out = calm.agg(F.count(F.lit(1)).alias("exception_count"), S.count_where(F.col("flagged").isNull()).alias("suppressed_count"),
                   S.count_where(F.col("flagged")).alias("false_alarm_count"))
    n = F.col("exception_count")
    return (out.withColumn("suppression_rate", S.ratio(F.col("suppressed_count"), n, 4, 1.0))
            .withColumn("false_alarm_reduction", S.ratio((n - F.col("false_alarm_count")) * 100.0, n, 2, 100.0)))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k_values: list[int] = K_VALUES) -> DataFrame:
    """Precision, recall, average precision and NDCG at each k.

    ``ranked`` is (id, rank) and ``relevant`` is (id, grade). Only the first max(k) ranks can matter,
    so both sides are cut to that before any ordering.
    """
    depth = max(k_values)
    total = relevant.agg(F.count(F.lit(1))).scalar()
    top = (ranked.where(F.col("rank") <= depth).join(relevant, "id", "left")
           .select("rank", F.coalesce(F.col("grade").cast("double"), F.lit(0.0)).alias("grade"), F.col("grade").isNotNull().alias("hit")))
    so_far = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most max(k) rows
    top = (top.withColumn("hits", F.sum(F.col("hit").cast("int")).over(so_far))
           .withColumn("gain", (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)))
    best = relevant.orderBy(F.desc("grade")).limit(depth)
    ideal = (best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("grade"))))
             .withColumn("ideal_gain", (F.pow(F.lit(2.0), F.col("grade").cast("double")) - 1) / F.log2(F.col("place") + 1.0)))
    ks = F.explode(F.array(*[F.lit(k) for k in k_values]))
    per = (top.withColumn("k", ks).where("rank <= k").groupBy("k").agg(
        F.count(F.lit(1)).alias("cutoff"), S.count_where(F.col("hit")).alias("hits"),
        F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precision_sum"), F.sum("gain").alias("dcg")))
    perfect = ideal.withColumn("k", ks).where("place <= k").groupBy("k").agg(F.sum("ideal_gain").alias("idcg"))
    rows = per.join(perfect, "k", "left").withColumn("relevant_count", total)
    bound = F.least("cutoff", "relevant_count")
    return rows.select(
        "k", S.ratio(F.col("hits"), F.col("cutoff")).alias("precision_at_k"), S.ratio(F.col("hits"), F.col("relevant_count"), 4, 1.0).alias("recall_at_k"),
        S.ratio(F.col("precision_sum"), bound).alias("average_precision_at_k"),
        F.when(F.col("idcg") > 0, S.rounded(F.col("dcg") / F.col("idcg"), 4))
        .otherwise(F.when(F.col("relevant_count") == 0, 1.0).otherwise(0.0)).alias("ndcg_at_k"))


def reduction_metrics(findings: DataFrame, queue: DataFrame) -> DataFrame:
    """How far the queue shrinks the work and what it still covers. ``queue`` is (finding_id, cse_id, rule_id)."""
    picked = queue.select("finding_id").distinct().withColumn("queued", F.lit(True))
    severe = F.col("severity").isin("CRITICAL", "HIGH")
    critical = F.col("severity") == "CRITICAL"
    queued = F.coalesce("queued", F.lit(False))
    base = findings.join(picked, "finding_id", "left").agg(
        F.count(F.lit(1)).alias("total_candidates"), S.count_where(critical).alias("critical_total"),
        S.count_where(critical & queued).alias("critical_in_queue"), S.count_where(severe).alias("high_total"),
        S.count_where(severe & queued).alias("high_in_queue"), F.countDistinct("cse_id").alias("cses_in_candidates"),
        F.countDistinct("rule_id").alias("types_in_candidates"))
    size = queue.agg(F.count(F.lit(1))).scalar()
    share = queue.groupBy("cse_id").agg(F.count(F.lit(1)).alias("n"))
    squares = share.agg(F.sum(F.col("n") * F.col("n"))).scalar()
    rows = (base.withColumn("queue_size", size).withColumn("cses_in_queue", share.agg(F.count("cse_id")).scalar())
            .withColumn("types_in_queue", queue.agg(F.countDistinct("rule_id")).scalar()).withColumn("squares", squares))
    c = F.col
    return rows.select(
        "total_candidates", "queue_size", F.when(c("total_candidates") > 0, S.rounded(1.0 - c("queue_size") / c("total_candidates"), 4)).otherwise(0.0).alias("review_reduction"),
        "critical_total", "critical_in_queue", S.ratio(c("critical_in_queue"), c("critical_total"), 4, 1.0).alias("critical_coverage"),
        "high_total", "high_in_queue", S.ratio(c("high_in_queue"), c("high_total"), 4, 1.0).alias("high_coverage"),
        "cses_in_candidates", "cses_in_queue", S.ratio(c("cses_in_queue"), c("cses_in_candidates"), 4, 1.0).alias("cse_coverage"),
        "types_in_candidates", "types_in_queue", S.ratio(c("types_in_queue"), c("types_in_candidates"), 4, 1.0).alias("type_coverage"),
        S.ratio(c("squares"), c("queue_size") * c("queue_size")).alias("herfindahl_index"))


EXPLAINED = ["why_flagged", "expected_behaviour", "observed_behaviour", "evidence", "peer_comparison", "confidence", "risk_contribution", "recommendation"]


def explained_fields(with_evidence: bool | Column = True) -> dict[str, Column]:
    """One boolean per mandatory explanation field."""
    told = lambda name: ~F.upper(F.trim(F.coalesce(F.col(name), F.lit("")))).isin(P.PLACEHOLDERS)
    evidence = F.size(F.coalesce("evidence_refs", F.array())) > 0
    switch = F.lit(with_evidence) if isinstance(with_evidence, bool) else with_evidence
    return {"why_flagged": told("reason"), "expected_behaviour": told("expected_behaviour"), "observed_behaviour": told("observed_behaviour"),
            "evidence": evidence & switch, "peer_comparison": F.lit(True), "confidence": F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
            "risk_contribution": F.coalesce(S.or_default(F.col("risk_score"), None), F.col("supervisory_priority"), F.lit(-1.0)) >= 0.0,
            "recommendation": told("recommendation")}


def explainability(findings: DataFrame) -> DataFrame:
    """Share of findings whose eight explanation fields are all filled with something real."""
    fields = explained_fields()
    valid = findings.select("reason", *[c.alias(f"ok_{n}") for n, c in fields.items()])
    score = sum((F.col(f"ok_{n}").cast("int") for n in EXPLAINED), F.lit(0))
    raw = F.upper(F.trim(F.coalesce("reason", F.lit(""))))
    out = valid.withColumn("score", score).agg(
        F.count(F.lit(1)).alias("total"), S.count_where(F.col("score") == len(EXPLAINED)).alias("full"),
        S.count_where((F.col("score") > 0) & (F.col("score") < len(EXPLAINED))).alias("partial"),
        S.count_where(F.col("score") == 0).alias("unexplained"), S.count_where(raw.isin(P.PLACEHOLDERS) & (raw != "")).alias("placeholder_rejections"),
        *[S.count_where(F.col(f"ok_{n}")).alias(f"n_{n}") for n in EXPLAINED])
    return out.select("total", "full", "partial", "unexplained", "placeholder_rejections",
                      S.ratio(F.col("full") * 100.0, F.col("total"), 2, 100.0).alias("completeness_pct"),
                      *[S.ratio(F.col(f"n_{n}"), F.col("total")).alias(f"rate_{n}") for n in EXPLAINED])


def first_detected(findings: DataFrame, relevant: DataFrame) -> DataFrame:
    """finding_id with the first of its keys that is a relevant target."""
    return (finding_keys(findings).join(relevant, "key", "left_semi")
            .groupBy("finding_id").agg(F.min_by("key", "place").alias("detected")))


ABLATIONS = ["A0", "A1", "A2", "A3", "A4", "A5", "A6", "A7"]


def baseline_findings(est, like: DataFrame) -> DataFrame:
    """Plain alert filter without any workflow logic: closed critical alerts on critical assets."""
    crit = est.assets.where("criticality = 'CRITICAL'").select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"))
    rows = est.alerts.where("severity = 'CRITICAL' AND status = 'CLOSED'").join(crit, "asset_id")
    made = rows.select(
        S.key_hash(F.lit("BASELINE"), F.col("id")).alias("finding_id"), F.lit("BASELINE-ALERT-FILTER").alias("rule_id"), "cse_id", "asset_id",
        F.lit("CRITICAL").alias("severity"), F.lit(0.80).alias("confidence"), F.lit(0.0).alias("risk_score"), F.lit(0.0).alias("supervisory_priority"),
        F.concat(F.lit("Closed critical alert on "), F.col("asset_name")).alias("reason"), F.lit("Alerts are investigated").alias("expected_behaviour"),
        F.lit("Alert was closed").alias("observed_behaviour"), F.lit("Review the alert").alias("recommendation"),
        F.array().cast(like.schema["evidence_refs"].dataType).alias("evidence_refs"))
    return made


def ablation(est, findings: DataFrame, queue: DataFrame, truth: DataFrame) -> DataFrame:
    """Eight configurations judged from one findings table.

    Each finding is tagged once with the configurations it belongs to and matched once against
    the targets; everything else is one grouped aggregate per configuration.
    """
    c = F.col
    cols = ["finding_id", "rule_id", "cse_id", "asset_id", "severity", "confidence", "risk_score", "supervisory_priority", "reason",
            "expected_behaviour", "observed_behaviour", "recommendation", "evidence_refs"]
    pool = (findings.select(*cols, F.lit(False).alias("is_baseline"))
            .unionByName(baseline_findings(est, findings).withColumn("is_baseline", F.lit(True))))
    relevant = truth.where("NOT is_exception").select(c("target_id").alias("key")).distinct()
    n_relevant = relevant.agg(F.count(F.lit(1))).scalar()
    n_assets = est.assets.agg(F.count(F.lit(1))).scalar()
    lit_array = lambda *names: F.array(*[F.lit(n) for n in names])
    configs = (F.when(c("is_baseline"), lit_array("A0", "A1", "A2", "A3")).when(c("rule_id").startswith("GAP"), lit_array("A1", "A4", "A5", "A6", "A7"))
               .when(c("rule_id").isin("NEG-04", "PEER-01"), lit_array("A3", "A4", "A5", "A6", "A7"))
               .otherwise(lit_array("A2", "A4", "A5", "A6", "A7")))
    seen = first_detected(pool, relevant)
    ranks = queue.select("finding_id", c("rank").alias("queue_rank"))
    explained = explained_fields()
    everything = sum((x.cast("int") for n, x in explained.items()), F.lit(0)) == len(EXPLAINED)
    tagged = (pool.join(seen, "finding_id", "left").join(ranks, "finding_id", "left").withColumn("is_explained", everything)
              .withColumn("config", F.explode(configs))
              .select("config", "finding_id", "cse_id", "detected", "risk_score", "confidence", "is_baseline", "queue_rank",
                      (c("is_explained") & (c("config") >= "A4")).alias("is_explained")))
    judged = tagged.groupBy("config").agg(
        F.count(F.lit(1)).alias("findings_count"), F.countDistinct("detected").alias("tp"), S.count_where(c("detected").isNull()).alias("fp"),
        S.count_where(c("is_explained")).alias("explained"))
    judged = (judged.withColumn("fn", F.greatest(F.lit(0), n_relevant - c("tp")))
              .withColumn("tn", F.greatest(F.lit(0), n_assets - (c("tp") + c("fp") + c("fn")))))
    by_risk = F.when(c("config") == "A5", c("risk_score"))
    by_conf = F.when(c("config") == "A5", c("confidence"))
    ranked_only = ~c("config").isin("A6", "A7") | c("queue_rank").isNotNull()
    order = Window.partitionBy("config").orderBy(F.asc_nulls_last(F.when(c("config").isin("A6", "A7"), c("queue_rank"))), F.desc_nulls_last(by_risk),
                                                 F.desc_nulls_last(by_conf), F.desc("is_baseline"), F.asc("finding_id"))
    top = tagged.where(ranked_only).withColumn("place", F.row_number().over(order)).where("place <= 10")
    shares = top.groupBy("config", "cse_id").agg(F.count(F.lit(1)).alias("n"), S.count_where(c("detected").isNotNull()).alias("hits"))
    view = shares.groupBy("config").agg(F.sum("n").alias("queue_size"), F.sum("hits").alias("hits"), F.count("cse_id").alias("cses_in_queue"),
                                        F.sum(c("n") * c("n")).alias("squares"))
    return (binary_metrics(judged).join(view, "config", "left").select(
        "config", "findings_count", "precision", "recall", "f1_score", "false_positive_rate",
        S.ratio(c("hits"), n_relevant, 4, 1.0).alias("top_k_recall"), S.ratio(c("explained") * 100.0, c("findings_count"), 2, 100.0).alias("explainability_pct"),
        S.rounded(1.0 - c("queue_size") / c("findings_count"), 4).alias("review_reduction"), "cses_in_queue",
        S.ratio(c("squares"), c("queue_size") * c("queue_size")).alias("herfindahl_index")))


# --- fixed values: which configuration isolates which component ---------------------------
DELTAS = [("Negative space", "A1"), ("Evidence", "A3"), ("Risk", "A4"), ("Diversity", "A5")]


def ablation_deltas(table: DataFrame) -> DataFrame:
    """The full configuration minus the one without a component. Eight rows in, four out."""
    names = F.create_map(*[x for name, cfg in DELTAS for x in (F.lit(cfg), F.lit(name))])
    full = table.where("config = 'A7'")
    diff = lambda m, digits: S.rounded(full.select(m).scalar() - F.col(m), digits).alias(f"delta_{m}")
    return (table.where(F.col("config").isin([cfg for _, cfg in DELTAS]))
            .select(names[F.col("config")].alias("component"), "config", diff("f1_score", 4), diff("false_positive_rate", 4), diff("top_k_recall", 4),
                    diff("explainability_pct", 2), diff("review_reduction", 4),
                    (full.select("cses_in_queue").scalar() - F.col("cses_in_queue")).alias("delta_cses_in_queue")))


def threshold_counts(rows: DataFrame, rule: str, parameter: str, applicable: Column, hit, thresholds: list[float]) -> DataFrame:
    """How many subjects a rule would flag at each threshold; one scan, one conditional count per value."""
    wide = rows.agg(S.count_where(applicable).alias("subjects"),
                    *[S.count_where(applicable & hit(F.lit(float(t)))).alias(f"t{i}") for i, t in enumerate(thresholds)])
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("flagged")) for i, t in enumerate(thresholds)])
    return wide.select(F.lit(rule).alias("rule_id"), F.lit(parameter).alias("parameter"), "subjects", F.explode(points).alias("p")).select(
        "rule_id", "parameter", "subjects", "p.*")


def run_statistics(values: DataFrame, group: str = "metric", value: str = "value") -> DataFrame:
    """Mean, median, sample deviation, range and a 95% interval of one metric over repeated runs."""
    v = F.col(value)
    base = values.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"),
                                     F.min(v).alias("low"), F.max(v).alias("high"))
    base = with_percentiles(base, values, [group], value, {"med": 0.5})
    table = F.create_map(*[x for df, t in P.T_CRITICAL_95.items() for x in (F.lit(df), F.lit(t))])
    degrees = F.greatest(F.lit(1), F.col("n") - 1).cast("int")
    base = (base.withColumn("degrees_of_freedom", degrees).withColumn("t_critical", F.coalesce(F.try_element_at(table, F.col("degrees_of_freedom")), F.lit(1.96)))
            .withColumn("sd", F.when(F.col("n") > 1, F.col("sd")).otherwise(0.0)))
    margin = F.when(F.col("n") > 1, F.col("t_critical") * F.col("sd") / F.sqrt(F.col("n").cast("double"))).otherwise(0.0)
    upper = F.col("m") + margin
    return base.select(group, "n", S.rounded(F.col("m"), 4).alias("mean"), S.rounded(F.col("med").cast("double"), 4).alias("median"), S.rounded(F.col("sd"), 4).alias("std"),
                       S.rounded(F.col("low"), 4).alias("min"), S.rounded(F.col("high"), 4).alias("max"),
                       S.rounded(F.greatest(F.lit(0.0), F.col("m") - margin), 4).alias("ci_95_lower"),
                       S.rounded(F.when(F.col("high") <= 1.0, F.least(F.lit(1.0), upper)).otherwise(upper), 4).alias("ci_95_upper"),
                       "degrees_of_freedom", "t_critical")


def state_digest(findings: DataFrame, risk: DataFrame, queue: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One digest per result table, independent of row order, partitioning and run ids."""
    c = F.col
    two = lambda name: S.rounded(c(name), 2)
    parts = {
        "findings": findings.select(row_hash(c("rule_id"), c("cse_id"), c("asset_id"), c("severity"), two("confidence"), F.trim("reason")).alias("row_hash")),
        "risk": risk.select(row_hash(c("cse_id"), two("normalized_score"), c("risk_band"), two("overall_confidence")).alias("row_hash")),
        "queue": queue.select(row_hash(c("rank"), c("cse_id"), c("rule_id"), c("severity"), c("priority_band"), two("priority_score")).alias("row_hash")),
        "graph": anomalies.select(row_hash(c("anomaly_type"), c("severity")).alias("row_hash"))}
    out = None
    for name, rows in parts.items():
        one = multiset_digest(rows).select(F.lit(name).alias("state"), "row_count", "digest")
        out = one if out is None else out.unionByName(one)
    return out
