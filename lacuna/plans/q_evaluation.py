"""Evaluation queries. Ground truth is derived from balances, prices and priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import scalar as S
from lacuna.operators import evaluation as V
from lacuna.operators import negative_space as N
from lacuna.operators import sensitivity as SN
from lacuna.operators.gap_rules import gap03
from lacuna.operators.workflow import workflow
from lacuna.params import T_CRITICAL_95
from lacuna.plans.ctes import cte, r
from lacuna.plans.lens import asset_entities, estate, tag
from lacuna.plans.registry import query
from lacuna.plans.stages import analysis, written


def truth(spark, d):
    """Scenarios: rich customers should be silent assets, pricey orders unescalated alerts, and so on."""
    t = estate(spark, d).tables
    row = lambda df, kind, cls, target, ttype, rule, exc: df.select(
        tag(f"SCN-{kind}", target).alias("scenario_id"), F.lit(cls).alias("scenario_class"),
        tag({"Asset": "AST", "CSE": "CSE", "Alert": "ALT", "Investigation": "INV", "Host": "AST"}[ttype], target).alias("target_id"),
        F.lit(ttype).alias("target_type"), F.lit(rule).alias("expected_rule"), F.lit(exc).alias("is_exception"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    parts = [row(t.customer.where("c_acctbal >= 9000"), "1", "NEGATIVE_SPACE", c, "Asset", "NEG-01", False),
             row(t.customer.where("c_acctbal >= 8500 AND c_acctbal < 9000"), "2", "PEER_ANOMALY", c, "Asset", "NEG-04", False),
             row(t.customer.where("c_acctbal < -500"), "3", "MIXED_SIGNAL", c, "Host", "NEG-05", False),
             row(t.nation, "4", "NEGATIVE_SPACE", F.col("n_nationkey"), "CSE", "NEG-03", False),
             row(t.orders.where("o_totalprice >= 300000"), "5", "EXECUTION_GAP", o, "Alert", "GAP-01", False),
             row(t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"), "6", "EXECUTION_GAP", o, "Investigation", "GAP-03", False),
             row(t.customer.where("c_custkey % 20 = 0"), "7", "NEGATIVE_SPACE", c, "Asset", "NEG-05", True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_T = lambda kind, cls, pre, k, tt, rule, exc, src: f"SELECT 'SCN-{kind}-' || {k} AS scenario_id, '{cls}' AS scenario_class, '{pre}-' || {k} AS target_id, '{tt}' AS target_type, '{rule}' AS expected_rule, {exc} AS is_exception FROM {src}"
cte("truth", "", " UNION ALL ".join([
    _T("1", "NEGATIVE_SPACE", "AST", "c_custkey", "Asset", "NEG-01", "false", "customer WHERE c_acctbal >= 9000"),
    _T("2", "PEER_ANOMALY", "AST", "c_custkey", "Asset", "NEG-04", "false", "customer WHERE c_acctbal >= 8500 AND c_acctbal < 9000"),
    _T("3", "MIXED_SIGNAL", "AST", "c_custkey", "Host", "NEG-05", "false", "customer WHERE c_acctbal < -500"),
    _T("4", "NEGATIVE_SPACE", "CSE", "n_nationkey", "CSE", "NEG-03", "false", "nation"),
    _T("5", "EXECUTION_GAP", "ALT", "o_orderkey", "Alert", "GAP-01", "false", "orders WHERE o_totalprice >= 300000"),
    _T("6", "EXECUTION_GAP", "INV", "o_orderkey", "Investigation", "GAP-03", "false", "orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
    _T("7", "NEGATIVE_SPACE", "AST", "c_custkey", "Asset", "NEG-05", "true", "customer WHERE c_custkey % 20 = 0")]))
cte("fkeys", "findings refs", """SELECT finding_id, rule_id, 0 AS place, cse_id AS key FROM findings WHERE cse_id IS NOT NULL UNION ALL SELECT finding_id, rule_id, 1, asset_id FROM findings WHERE asset_id IS NOT NULL
 UNION ALL SELECT r.finding_id, f.rule_id, 2 + position, source_record_id FROM refs r JOIN findings f ON f.finding_id = r.finding_id""")
cte("judged", "findings fkeys truth", """SELECT f.finding_id, f.rule_id, f.finding_id IN (SELECT finding_id FROM fkeys k JOIN truth t ON t.expected_rule = k.rule_id AND t.target_id = k.key AND NOT t.is_exception) AS matched FROM findings f""")


def _binary(src: str, keys: str = "rule_id, ") -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN {r('2 * precision * recall / (precision + recall)', 4)} ELSE 0.0::double END AS f1_score FROM (SELECT {keys}tp, fp, fn, tn,
 CASE WHEN tp + fp > 0 THEN {r('tp / (tp + fp)', 4)} WHEN tp + fn = 0 AND fp = 0 THEN 1.0::double ELSE 0.0::double END AS precision,
 CASE WHEN tp + fn > 0 THEN {r('tp / (tp + fn)', 4)} ELSE 1.0::double END AS recall, CASE WHEN fp + tn > 0 THEN {r('fp / (fp + tn)', 4)} ELSE 0.0::double END AS false_positive_rate FROM ({src}))"""


cte("truth_counts", "judged truth assets entities", """SELECT rule_id, tp, fp, fn, greatest(0, (CASE WHEN rule_id IN ('NEG-01','NEG-04','NEG-05') OR rule_id LIKE 'GAP-%' THEN (SELECT count(*) FROM assets) ELSE (SELECT count(*) FROM entities) END) - (tp + fp + fn)) AS tn FROM (
 SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(m, 0)::BIGINT AS tp, coalesce(n - m, 0)::BIGINT AS fp, greatest(0, coalesce(g, 0) - coalesce(m, 0))::BIGINT AS fn FROM
 (SELECT rule_id, count(*) AS n, count(*) FILTER (matched) AS m FROM judged GROUP BY 1) a FULL JOIN (SELECT expected_rule AS rule_id, count(*) AS g FROM truth WHERE NOT is_exception GROUP BY 1) b ON a.rule_id = b.rule_id)""")
cte("truth_rules", "truth_counts", _binary("SELECT * FROM truth_counts"))


def _found(spark, d):
    run = analysis(spark, d)
    return run.estate, run.findings, truth(spark, d)


@query("truth_evaluation", "truth_rules", "SELECT * FROM truth_rules")
def truth_evaluation(spark, d):
    est, found, gt = _found(spark, d)
    return V.truth_evaluation(found, gt, est.assets, est.entities)


@query("truth_evaluation_overall", "truth_rules", _binary(f"""SELECT {r('sum(round_even(precision * 10000, 0)::BIGINT)::double / count(*) / 10000', 4)} AS macro_precision, {r('sum(round_even(recall * 10000, 0)::BIGINT)::double / count(*) / 10000', 4)} AS macro_recall,
 {r('sum(round_even(f1_score * 10000, 0)::BIGINT)::double / count(*) / 10000', 4)} AS macro_f1_score, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM truth_rules""", "macro_precision, macro_recall, macro_f1_score, "))
def truth_evaluation_overall(spark, d):
    est, found, gt = _found(spark, d)
    return V.overall(V.truth_evaluation(found, gt, est.assets, est.entities))


cte("scenario_hits", "truth fkeys", """SELECT scenario_id, scenario_class, target_type, target_id, expected_rule, EXISTS (SELECT 1 FROM fkeys k WHERE k.rule_id = t.expected_rule AND k.key = t.target_id AND
 CASE t.target_type WHEN 'Asset' THEN place = 1 WHEN 'CSE' THEN place = 0 WHEN 'Alert' THEN place >= 2 WHEN 'Investigation' THEN place >= 2 ELSE place <= 1 END) AS is_detected FROM truth t WHERE NOT is_exception""")


@query("scenario_matches", "scenario_hits", "SELECT * FROM scenario_hits")
def scenario_matches(spark, d):
    _, found, gt = _found(spark, d)
    return V.scenario_matches(found, gt)


@query("scenario_rule_metrics", "scenario_hits judged assets", _binary("""SELECT rule_id, tp, fp, fn, greatest(0, (SELECT count(*) FROM assets) - (tp + fp + fn)) AS tn FROM (SELECT coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM
 (SELECT expected_rule AS rule_id, count(*) FILTER (is_detected) AS tp, count(*) FILTER (NOT is_detected) AS fn FROM scenario_hits GROUP BY 1) a FULL JOIN (SELECT rule_id, count(*) FILTER (NOT matched) AS fp FROM judged GROUP BY 1) b ON a.rule_id = b.rule_id)"""))
def scenario_rule_metrics(spark, d):
    est, found, gt = _found(spark, d)
    return V.scenario_rule_metrics(found, gt, est.assets)


@query("exception_safety", "truth findings", f"""SELECT n AS exception_count, n - f AS suppressed_count, f AS false_alarm_count, {r('(n - f) / n', 4)} AS suppression_rate, {r('(n - f) * 100.0::double / n', 2)} AS false_alarm_reduction FROM
 (SELECT count(*) AS n, count(*) FILTER (target_id IN (SELECT cse_id FROM findings WHERE cse_id IS NOT NULL UNION SELECT asset_id FROM findings WHERE asset_id IS NOT NULL)) AS f FROM truth WHERE is_exception)""")
def exception_safety(spark, d):
    _, found, gt = _found(spark, d)
    return V.exception_safety(found, gt)


def _queued(spark, d):
    run = analysis(spark, d)
    return run.estate, run.findings, truth(spark, d), run.candidates, run.queue


cte("relevant", "judged findings", "SELECT j.finding_id AS id, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END AS grade FROM judged j JOIN findings f ON f.finding_id = j.finding_id WHERE matched")
cte("ranked", "queue relevant", "SELECT rank, coalesce(grade, 0) AS grade, grade IS NOT NULL AS hit, sum((grade IS NOT NULL)::INT) OVER (ORDER BY rank) AS hits FROM queue LEFT JOIN relevant ON id = finding_id")


@query("ranking_metrics", "ranked relevant", f"""SELECT k, {r('h / c', 4)} AS precision_at_k, {r('h / t', 4)} AS recall_at_k, {r('ps / least(c, t)', 4)} AS average_precision_at_k, {r('dcg / idcg', 4)} AS ndcg_at_k FROM (
 SELECT k, count(*) AS c, count(*) FILTER (hit) AS h, sum(CASE WHEN hit THEN hits / rank ELSE 0 END) AS ps, sum((pow(2.0, grade) - 1) / log2(rank + 1.0)) AS dcg, (SELECT count(*) FROM relevant) AS t,
 (SELECT sum((pow(2.0, grade) - 1) / log2(p + 1.0)) FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC) AS p FROM relevant) WHERE p <= k) AS idcg
 FROM ranked, (SELECT unnest([1, 3, 5, 10, 20]) AS k) WHERE rank <= k GROUP BY k)""")
def ranking_metrics(spark, d):
    _, found, gt, _, queue = _queued(spark, d)
    grade = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).otherwise(1)
    hits = V.matched_by_rule(found, gt.where("NOT is_exception"))
    relevant = found.join(hits.select("finding_id"), "finding_id", "left_semi").select(F.col("finding_id").alias("id"), grade.alias("grade"))
    return V.ranking_metrics(queue.select(F.col("finding_id").alias("id"), "rank"), relevant)


@query("queue_reduction", "findings queue", f"""SELECT n AS total_candidates, q AS queue_size, {r('1.0::double - q / n', 4)} AS review_reduction, ct AS critical_total, cq AS critical_in_queue, {r('cq / ct', 4)} AS critical_coverage, ht AS high_total, hq AS high_in_queue, {r('hq / ht', 4)} AS high_coverage,
 ec AS cses_in_candidates, eq AS cses_in_queue, {r('eq / ec', 4)} AS cse_coverage, tc AS types_in_candidates, tq AS types_in_queue, {r('tq / tc', 4)} AS type_coverage, {r('hh / (q * q)', 4)} AS herfindahl_index FROM (
 SELECT count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS ct, count(*) FILTER (severity IN ('CRITICAL','HIGH')) AS ht, count(DISTINCT cse_id) AS ec, count(DISTINCT rule_id) AS tc FROM findings),
 (SELECT count(*) AS q, count(*) FILTER (severity = 'CRITICAL') AS cq, count(*) FILTER (severity IN ('CRITICAL','HIGH')) AS hq, count(DISTINCT cse_id) AS eq, count(DISTINCT rule_id) AS tq FROM queue), (SELECT sum(n * n) AS hh FROM (SELECT count(*) AS n FROM queue GROUP BY cse_id))""")
def queue_reduction(spark, d):
    _, found, _, _, queue = _queued(spark, d)
    return V.reduction_metrics(found, queue)


@query("explainability", "findings", "SELECT count(*) AS total, count(*) AS full, 0::BIGINT AS partial, 0::BIGINT AS unexplained, 0::BIGINT AS placeholder_rejections, 100.0::double AS completeness_pct, "
       + ", ".join(f"1.0::double AS rate_{n}" for n in V.EXPLAINED) + " FROM findings")
def explainability(spark, d):
    return V.explainability(analysis(spark, d).findings)


cte("base_findings", "alerts assets", "SELECT sha256('BASELINE:' || a.id) AS finding_id, a.cse_id, a.asset_id FROM alerts a JOIN assets s ON s.id = a.asset_id WHERE severity = 'CRITICAL' AND a.status = 'CLOSED' AND s.criticality = 'CRITICAL'")
cte("targets", "truth", "SELECT DISTINCT target_id AS key FROM truth WHERE NOT is_exception")
cte("pool", "findings base_findings fkeys targets queue", """SELECT f.*, d.detected FROM (SELECT finding_id, rule_id, cse_id, risk_score, confidence, false AS is_baseline FROM findings UNION ALL SELECT finding_id, 'BASELINE-ALERT-FILTER', cse_id, 0.0, 0.8, true FROM base_findings) f LEFT JOIN
 (SELECT finding_id, arg_min(key, place) AS detected FROM (SELECT finding_id, place, key FROM fkeys UNION ALL SELECT finding_id, 0, cse_id FROM base_findings UNION ALL SELECT finding_id, 1, asset_id FROM base_findings) WHERE key IN (SELECT key FROM targets) GROUP BY 1) d ON d.finding_id = f.finding_id""")
cte("tagged", "pool queue", """SELECT p.*, config, q.rank AS queue_rank FROM pool p LEFT JOIN queue q ON q.finding_id = p.finding_id, (SELECT unnest(['A0','A1','A2','A3','A4','A5','A6','A7']) AS config) WHERE
 CASE WHEN is_baseline THEN config <= 'A3' WHEN p.rule_id LIKE 'GAP%' THEN config = 'A1' OR config >= 'A4' WHEN p.rule_id IN ('NEG-04','PEER-01') THEN config = 'A3' OR config >= 'A4' ELSE config = 'A2' OR config >= 'A4' END""")
cte("ablation_top", "tagged", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY CASE WHEN config >= 'A6' THEN queue_rank END NULLS LAST, CASE WHEN config = 'A5' THEN risk_score END DESC NULLS LAST,
 CASE WHEN config = 'A5' THEN confidence END DESC NULLS LAST, is_baseline DESC, finding_id) AS place FROM tagged WHERE config < 'A6' OR queue_rank IS NOT NULL) WHERE place <= 10""")
cte("ablation_counts", "tagged targets assets", """SELECT config, n, tp, fp, fn, greatest(0, (SELECT count(*) FROM assets) - (tp + fp + fn)) AS tn FROM (SELECT config, count(*) AS n, count(DISTINCT detected) AS tp, count(*) FILTER (detected IS NULL) AS fp,
 greatest(0, (SELECT count(*) FROM targets) - count(DISTINCT detected)) AS fn FROM tagged GROUP BY config)""")
cte("ablation", "ablation_counts ablation_top targets", f"""SELECT b.config, n AS findings_count, precision, recall, f1_score, false_positive_rate, {r('hits / (SELECT count(*) FROM targets)', 4)} AS top_k_recall, CASE WHEN b.config >= 'A4' THEN 100.0::double ELSE 0.0::double END AS explainability_pct,
 {r('1.0::double - q / n', 4)} AS review_reduction, cses AS cses_in_queue, {r('hh / (q * q)', 4)} AS herfindahl_index FROM ({_binary('SELECT * FROM ablation_counts', 'config, n, ')}) b JOIN
 (SELECT config, sum(c) AS q, sum(h) AS hits, count(*) AS cses, sum(c * c) AS hh FROM (SELECT config, cse_id, count(*) AS c, count(detected) AS h FROM ablation_top GROUP BY 1, 2) GROUP BY 1) v ON v.config = b.config""")


def _ablation(spark, d):
    est, found, gt, _, queue = _queued(spark, d)
    return V.ablation(est, found, queue, gt)


def _written_ablation(spark, d):
    """The eight-row table, written once because the deltas read it several times."""
    return written(_ablation(spark, d), "ablation", analysis(spark, d).root)


@query("ablation", "ablation", "SELECT * FROM ablation")
def ablation(spark, d):
    return _ablation(spark, d)


_D = lambda m, k: f"{r(f'f.{m} - a.{m}', k)} AS delta_{m}"


@query("ablation_deltas", "ablation", f"""SELECT CASE a.config WHEN 'A1' THEN 'Negative space' WHEN 'A3' THEN 'Evidence' WHEN 'A4' THEN 'Risk' ELSE 'Diversity' END AS component, a.config, {_D('f1_score', 4)}, {_D('false_positive_rate', 4)}, {_D('top_k_recall', 4)},
 {_D('explainability_pct', 2)}, {_D('review_reduction', 4)}, f.cses_in_queue - a.cses_in_queue AS delta_cses_in_queue FROM ablation a, ablation f WHERE f.config = 'A7' AND a.config IN ('A1','A3','A4','A5')""")
def ablation_deltas(spark, d):
    return V.ablation_deltas(_written_ablation(spark, d))


_GRID = {"NEG-01": [24.0, 36.0, 47.9, 48.0, 48.1, 72.0], "NEG-04": [0.05, 0.1, 0.2, 0.25, 0.5], "GAP-03": [5.0, 8.0, 15.0, 16.0, 30.0]}


def _grid_sql(rule, parameter, src, applicable, hit):
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, '{parameter}' AS parameter, count(*) FILTER ({applicable}) AS subjects, {t}::double AS threshold, count(*) FILTER ({applicable} AND {hit.format(t=t)}) AS flagged FROM {src}"
                              for t in _GRID[rule])


@query("threshold_sensitivity", "asset_base investigations", " UNION ALL ".join([
    _grid_sql("NEG-01", "silence_hours", "asset_base", "asset_criticality = 'CRITICAL' AND silence_hours IS NOT NULL", "silence_hours >= {t}"),
    _grid_sql("NEG-04", "density_ratio", "asset_base", "asset_criticality IN ('CRITICAL','HIGH') AND asset_status = 'ACTIVE' AND density_ratio IS NOT NULL", "density_ratio < {t}"),
    _grid_sql("GAP-03", "duration_seconds", "investigations", "duration_seconds IS NOT NULL", "duration_seconds < {t}")]))
def threshold_sensitivity(spark, d):
    est = estate(spark, d)
    rows = N.asset_rows(est)
    c = F.col
    one = V.threshold_counts(rows, "NEG-01", "silence_hours", (c("asset_criticality") == "CRITICAL") & c("silence_hours").isNotNull(), lambda t: c("silence_hours") >= t, _GRID["NEG-01"])
    two = V.threshold_counts(rows, "NEG-04", "density_ratio", c("asset_criticality").isin("CRITICAL", "HIGH") & (c("asset_status") == "ACTIVE") & c("density_ratio").isNotNull(),
                             lambda t: c("density_ratio") < t, _GRID["NEG-04"])
    three = V.threshold_counts(est.investigations, "GAP-03", "duration_seconds", c("duration_seconds").isNotNull(), lambda t: c("duration_seconds") < t, _GRID["GAP-03"])
    return one.unionByName(two).unionByName(three)


def _turns(rule, parameter, src, ever, always, value, at_least):
    return f"SELECT '{rule}' AS rule_id, '{parameter}' AS parameter, {at_least} AS at_least, CASE WHEN NOT ({always}) THEN {value}::double END AS threshold FROM {src} WHERE {ever}"


_LOUD = "asset_criticality IN ('CRITICAL','HIGH') AND asset_status = 'ACTIVE' AND peer_median IS NOT NULL AND density_ratio IS NOT NULL"
cte("turns", "asset_base asset_entity_base flow", " UNION ALL ".join([
    _turns("NEG-02", "drop_pct", "asset_entity_base", "maintenance_count = 0 AND (total_count IS NULL OR z_score >= 1.5)", "total_count IS NULL", "drop_pct", "true"),
    _turns("NEG-02", "drop_z", "asset_entity_base", "maintenance_count = 0 AND (total_count IS NULL OR drop_pct >= 70)", "total_count IS NULL", "z_score", "true"),
    _turns("NEG-04", "density_ratio", "asset_base", _LOUD, "false", "density_ratio", "false"),
    _turns("NEG-05", "maintenance_silence_hours", "asset_base", "asset_status <> 'DECOMMISSIONED' AND maintenance_count = 0", "silence_hours IS NULL", "silence_hours", "true"),
    _turns("GAP-03", "hasty_seconds", "flow", "investigation_id IS NOT NULL AND duration_seconds IS NOT NULL", "false", "duration_seconds", "false")]))
cte("turn_counts", "turns", "SELECT rule_id, parameter, at_least, threshold, count(*) AS n FROM turns GROUP BY ALL")
cte("steps", "turn_counts", """SELECT t.rule_id, t.parameter, threshold, t.n, coalesce(a.n, 0) AS always, coalesce(a.n, 0) + (CASE WHEN at_least THEN sum(t.n) OVER (PARTITION BY t.rule_id, t.parameter ORDER BY threshold DESC)
 ELSE sum(t.n) OVER (PARTITION BY t.rule_id, t.parameter ORDER BY threshold) - t.n END)::BIGINT AS flagged FROM turn_counts t
 LEFT JOIN (SELECT rule_id, parameter, n FROM turn_counts WHERE threshold IS NULL) a ON a.rule_id = t.rule_id AND a.parameter = t.parameter WHERE threshold IS NOT NULL""")


def sweeps(est, by_asset):
    """The rows of each rule and the thresholds to vary; NEG-02 reads assets in the role of entities, so its curve has many points."""
    k, c = est.completeness, F.col
    two = lambda parameter, measure: SN.Sweep("NEG-02", parameter, lambda p: N.neg02(k, p), c(measure), True)
    return [(N.entity_rows(by_asset), [two("drop_pct", "drop_pct"), two("drop_z", "z_score")]),
            (N.asset_rows(est), [SN.Sweep("NEG-04", "density_ratio", lambda p: N.neg04(k, p), c("density_ratio"), False),
                                 SN.Sweep("NEG-05", "maintenance_silence_hours", lambda p: N.neg05(k, p), c("silence_hours"), True)]),
            (workflow(est), [SN.Sweep("GAP-03", "hasty_seconds", lambda p: gap03(k, p), c("duration_seconds"), False)])]


@query("threshold_steps", "steps", f"SELECT rule_id, parameter, {r('threshold', 6)} AS threshold, n, always, flagged FROM steps")
def threshold_steps(spark, d):
    return SN.steps(sweeps(analysis(spark, d).estate, asset_entities(spark, d))).drop("at_least").withColumn("threshold", S.rounded(F.col("threshold"), 6))


_TC = "CASE greatest(1, n - 1) " + " ".join(f"WHEN {k} THEN {v}::double" for k, v in T_CRITICAL_95.items()) + " ELSE 1.96::double END"
cte("run_values", "risk entities", """SELECT 'entity.' || m AS metric, v AS value FROM (SELECT unnest(['execution_gap','negative_space','asset_criticality','normalized_score']) AS m, unnest([execution_gap, negative_space, asset_criticality, normalized_score]) AS v FROM risk)
 UNION ALL SELECT 'sector.share' AS metric, count(*) / (SELECT count(*) FROM entities) AS value FROM entities GROUP BY sector""")


@query("run_statistics", "run_values", f"""SELECT metric, n, {r('m', 4)} AS mean, {r('med', 4)} AS median, {r('sd', 4)} AS std, {r('low', 4)} AS min, {r('high', 4)} AS max, {r('greatest(0, m - mar)', 4)} AS ci_95_lower,
 {r('CASE WHEN high <= 1 THEN least(1, m + mar) ELSE m + mar END', 4)} AS ci_95_upper, greatest(1, n - 1)::INT AS degrees_of_freedom, {_TC} AS t_critical FROM (SELECT *, {_TC} * sd / sqrt(n::double) AS mar FROM (
 SELECT metric, count(*) AS n, avg(value) AS m, median(value) AS med, stddev_samp(value) AS sd, min(value) AS low, max(value) AS high FROM run_values GROUP BY metric))""")
def run_statistics(spark, d):
    run = analysis(spark, d)
    est, risk = run.estate, run.risk
    names = ["execution_gap", "negative_space", "asset_criticality", "normalized_score"]
    values = risk.select(F.explode(F.array(*[F.struct(F.lit(f"entity.{n}").alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    total = est.entities.agg(F.count(F.lit(1))).scalar()
    share = est.entities.groupBy("sector").agg(F.count(F.lit(1)).alias("k")).select(F.lit("sector.share").alias("metric"), (F.col("k") / total).alias("value"))
    return V.run_statistics(values.unionByName(share))


def _hash_sql(*parts):
    return "sha256(concat_ws('|', " + ", ".join(f"coalesce('=' || cast({p} as varchar), '-')" for p in parts) + "))"


def _digest_sql(name, src, *parts):
    lanes = ", ".join(f"':' || coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT), 0)" for i in range(4))
    return f"SELECT '{name}' AS state, count(*) AS row_count, sha256(concat(count(*), {lanes})) AS digest FROM (SELECT {_hash_sql(*parts)} AS h FROM {src})"


@query("state_digest", "findings risk queue anomalies", " UNION ALL ".join([
    _digest_sql("findings", "findings", "rule_id", "cse_id", "asset_id", "severity", r("confidence", 2), "trim(reason)"),
    _digest_sql("risk", "risk", "cse_id", r("normalized_score", 2), "risk_band", r("overall_confidence", 2)),
    _digest_sql("queue", "queue", "rank", "cse_id", "rule_id", "severity", "priority_band", r("priority_score", 2)),
    _digest_sql("graph", "anomalies", "anomaly_type", "severity")]))
def state_digest(spark, d):
    run = analysis(spark, d)
    return V.state_digest(run.findings, run.risk, run.queue, run.anomalies)
