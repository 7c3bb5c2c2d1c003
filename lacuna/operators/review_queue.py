"""Ranked, diversity-constrained review queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.functions import scalar as S
from lacuna.params import QUEUE, QueueParams
from lacuna.plans.lens import Estate

FACTORS = ["risk_significance", "finding_severity", "asset_criticality", "evidence_completeness",
           "evidence_confidence", "novelty", "peer_deviation", "review_urgency"]
ORDER = [F.desc, F.desc, F.desc, F.desc, F.asc]
SORT_KEYS = ["priority_score", "entity_risk", "sort_confidence", "found_at", "finding_id"]


def rank_order() -> list[Column]:
    return [way(key) for way, key in zip(ORDER, SORT_KEYS)]


def candidates(findings: DataFrame, risk: DataFrame, assets: DataFrame, params: QueueParams = QUEUE) -> DataFrame:
    """Eight factors and the priority of every finding still open."""
    open_ = findings.where(~F.col("status").isin("SUPPRESSED", "DISMISSED"))
    scores = risk.select("cse_id", "risk_score_id", F.col("normalized_score").alias("entity_score"))
    owners = assets.select(F.col("id").alias("asset_id"), F.col("criticality").alias("asset_level"))
    rows = open_.join(scores, "cse_id", "left").join(owners, "asset_id", "left")
    rows = rows.withColumn("entity_risk", F.coalesce("entity_score", F.lit(0.0)))
    level, sev = F.col("asset_level"), F.col("severity")
    factor = {
        "risk_significance": S.clamp(F.greatest("entity_risk", F.coalesce("risk_score", F.lit(0.0)))),
        "finding_severity": F.when(sev == "CRITICAL", 100.0).when(sev == "HIGH", 80.0).when(sev == "MEDIUM", 50.0).otherwise(25.0),
        "asset_criticality": F.when(level == "CRITICAL", 100.0).when(level == "HIGH", 70.0).when(level == "MEDIUM", 40.0).otherwise(20.0),
        "evidence_completeness": S.clamp(S.or_default(F.col("evidence_completeness"), 100.0)),
        "evidence_confidence": S.clamp(S.or_default(F.col("confidence"), 1.0) * 100.0),
        "novelty": F.when(F.col("status") == "NEW", 100.0).otherwise(40.0),
        "peer_deviation": F.when(F.col("rule_id").contains("NEG-04"), 100.0).otherwise(0.0),
        "review_urgency": S.clamp(S.or_default(F.col("anomaly_score"), 0.5) * 100.0),
    }
    rows = rows.select("analysis_run_id", "finding_id", "rule_id", "cse_id", "asset_id", "severity", "risk_score_id",
                       "entity_risk", "found_at", S.or_default(F.col("confidence"), 1.0).alias("sort_confidence"),
                       *[S.rounded(factor[f], 2).alias(f"factor_{f}") for f in FACTORS])
    weighted = [F.col(f"factor_{f}") * params.weights[f] for f in FACTORS]
    raw = sum(weighted[1:], weighted[0])
    thin = F.col("factor_evidence_completeness") < params.low_completeness
    penalised = F.when(thin, F.greatest(F.lit(0.0), raw - params.low_completeness_penalty)).otherwise(raw)
    return (rows.withColumn("priority_score", S.rounded(S.clamp(penalised), 2)).withColumn("is_penalised", thin)
            .withColumn("rule_category", S.rule_category(F.col("rule_id"))))


def _select(limits: QueueParams):
    """Both passes on an already pruned, tiny group of one run.

    Pass 1 walks down the priority order and takes a row while neither cap is reached. Pass 2
    fills up to the target with the best rows that pass 1 left out.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("finding_id").sort_values(
            SORT_KEYS, ascending=[False, False, False, False, True], kind="stable").reset_index(drop=True)
        entity_left = dict.fromkeys(rows["cse_id"], limits.max_per_entity)
        category_left = dict.fromkeys(rows["rule_category"], limits.max_per_category)
        passes = pd.Series(0, index=rows.index)
        for i, pair in enumerate(zip(rows["cse_id"], rows["rule_category"])):
            if entity_left[pair[0]] > 0 and category_left[pair[1]] > 0:
                entity_left[pair[0]] -= 1
                category_left[pair[1]] -= 1
                passes[i] = 1
        room = max(0, limits.target_size - int((passes == 1).sum()))
        passes[rows.index[passes == 0][:room]] = 2
        out = rows[passes > 0].copy()
        out["selection_pass"] = passes[passes > 0].astype("int32")
        out["rank"] = range(1, len(out) + 1)
        return out
    return run


def _best(df: DataFrame, keys: list[str], n: int, spread: int = 64) -> DataFrame:
    """The first ``n`` rows of each group in rank order, whatever ``n`` is: first of ``spread`` parts of a group, then of what is left."""
    ranked = lambda rows, by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*rank_order()))).where(F.col("r") <= n).drop("r")
    parts = df.withColumn("part", F.pmod(F.xxhash64("finding_id"), F.lit(spread)))
    return ranked(ranked(parts, [*keys, "part"]).drop("part"), keys)


def selected(cands: DataFrame, params: QueueParams = QUEUE) -> DataFrame:
    """Rows of both passes with their rank.

    Three exact prunings come first. Counters only grow, so inside one (entity, category) pair the
    rows of pass 1 are a prefix of at most m = min(both caps). At most Q rows per category are chosen,
    so only F entities can fill up, and a row is passed over while its category is open only if
    its entity is full; hence no row of pass 1 lies deeper than Q + m*F in its category. Pass 2 only
    reaches into the overall first (target + rows of pass 1). Each pruning first works on parts of a group, so a
    hot category or entity never gathers in one place, however large the limits are.
    """
    p, q = params.max_per_entity, params.max_per_category
    categories = cands.agg(F.count_distinct("rule_category")).first()[0]  # one number
    m, full = min(p, q), q * categories // p
    one = _best(_best(cands, ["analysis_run_id", "cse_id", "rule_category"], m), ["analysis_run_id", "rule_category"], q + m * full)
    two = _best(cands, ["analysis_run_id"], params.target_size + q * categories)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cands.schema) + ", selection_pass int, rank int"
    return one.unionByName(two).groupBy("analysis_run_id").applyInPandas(_select(params), schema)


def review_queue(cands: DataFrame, params: QueueParams = QUEUE) -> DataFrame:
    """The ranked queue with bands, rationale and factor values."""
    band = S.priority_band(F.col("priority_score"))
    note = F.when(F.col("selection_pass") == 1, "Pass 1: diversity selection").otherwise("Pass 2: concentration fallback")
    return selected(cands, params).select(
        S.key_hash(F.col("analysis_run_id"), F.col("finding_id")).alias("queue_item_id"), "analysis_run_id", "finding_id",
        "cse_id", "rule_id", "rule_category", "severity", "risk_score_id", "priority_score", "rank", band.alias("priority_band"),
        F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.lit(", priority "), S.one_decimal(F.col("priority_score")),
                 F.lit(" ("), band, F.lit(")")).alias("rationale"),
        *[f"factor_{f}" for f in FACTORS], "selection_pass", note.alias("diversity_notes"), F.lit("NEW").alias("status"))


def diversity_metrics(cands: DataFrame, queue: DataFrame) -> DataFrame:
    """Counts that describe how the caps shaped the queue, one row per run."""
    total = cands.groupBy("analysis_run_id").agg(F.count(F.lit(1)).alias("candidates_processed"))
    per_entity = queue.groupBy("analysis_run_id", "cse_id").agg(F.count(F.lit(1)).alias("n"))
    crowd = per_entity.groupBy("analysis_run_id").agg(
        F.bool_or(F.col("n") >= 3).alias("systemic_concentration_detected"), F.count(F.lit(1)).alias("cse_diversity_count"))
    sums = queue.groupBy("analysis_run_id").agg(
        F.count(F.lit(1)).alias("queue_items_generated"),
        S.count_where(F.col("selection_pass") == 1).alias("pass1"), S.count_where(F.col("selection_pass") == 2).alias("pass2"),
        F.countDistinct("rule_category").alias("category_diversity_count"))
    return (total.join(sums, "analysis_run_id").join(crowd, "analysis_run_id").select(
        "analysis_run_id", "candidates_processed", "queue_items_generated",
        (F.col("candidates_processed") - F.col("pass1") - F.col("pass2")).alias("candidates_excluded_by_diversity"),
        F.col("pass2").alias("candidates_reintroduced_by_fallback"), "systemic_concentration_detected",
        "cse_diversity_count", "category_diversity_count"))


def status_changes(queue: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply status events (queue_item_id, changed_at, new_status, user_id, notes).

    Returns the queue with its latest status and one audit row per event with before and after.
    """
    known = queue.select("queue_item_id", "finding_id", "cse_id", F.col("status").alias("initial_status"))
    # Two grains, so that one busy item is spread over the hours it was busy in: inside the hour
    # the event before, otherwise the last event of the latest earlier hour.
    stamp = F.struct("changed_at", "event_id")
    hourly = changes.withColumn("hour", F.date_trunc("hour", "changed_at"))
    ends = hourly.groupBy("queue_item_id", "hour").agg(F.max_by("new_status", stamp).alias("end_status"))
    by_hour = Window.partitionBy("queue_item_id").orderBy("hour")
    carried = ends.withColumn("carried", F.lag("end_status").over(by_hour)).drop("end_status")
    inside = Window.partitionBy("queue_item_id", "hour").orderBy("changed_at", "event_id")
    steps = (hourly.withColumn("before", F.lag("new_status").over(inside))
             .join(carried, ["queue_item_id", "hour"]).join(known, "queue_item_id")
             .withColumn("previous_status", F.coalesce("before", "carried", "initial_status")))
    audit = steps.select("event_id", F.lit("UPDATE_QUEUE_ITEM_STATUS").alias("action"), F.lit("ReviewQueueItem").alias("entity_type"),
                         F.col("queue_item_id").alias("entity_id"), "user_id", "changed_at", "previous_status", "new_status",
                         "notes", "finding_id", "cse_id")
    last = changes.groupBy("queue_item_id").agg(F.max_by("new_status", F.struct("changed_at", "event_id")).alias("latest"))
    now = (queue.join(last, "queue_item_id", "left")
           .withColumn("status", F.coalesce("latest", "status")).drop("latest"))
    return now, audit


def search(queue: DataFrame, term: str = "", status: str = "ALL", band: str = "ALL", severity: str = "ALL",
           sort_by: str = "rank", ascending: bool = True) -> DataFrame:
    """Free-text and exact filters of the queue view, sorted."""
    out = queue
    if term:
        fields = ["queue_item_id", "cse_id", "finding_id", "rationale"]
        hits = [F.lower(F.col(f)).contains(term.lower()) for f in fields]
        cond = hits[0]
        for h in hits[1:]:
            cond = cond | h
        out = out.where(cond)
    for col, want in (("status", status), ("priority_band", band)):
        if want != "ALL":
            out = out.where(F.col(col) == want)
    if severity != "ALL":
        out = out.where(F.upper("severity") == severity)
    return out.orderBy(F.asc(sort_by) if ascending else F.desc(sort_by))
