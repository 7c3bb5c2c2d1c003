"""Negative-space rules: evidence that should exist and does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.functions import scalar as S
from lacuna.operators.evaluations import evaluate, text, verdict
from lacuna.params import RULES, RuleParams
from lacuna.plans.lens import Estate


def _c(name: str) -> Column:
    return F.col(name)


def asset_activity(alerts: DataFrame) -> DataFrame:
    """Alert count and latest alert per asset."""
    return alerts.groupBy("asset_id").agg(F.count(F.lit(1)).alias("alert_count"), F.max("created_at").alias("last_seen"))


def maintenance_counts(logs: DataFrame, key: str, as_of: str, params: RuleParams = RULES) -> DataFrame:
    """Number of logs per key. By default any log counts, whatever its time window."""
    if params.strict_maintenance_overlap:
        now = F.to_timestamp(F.lit(as_of))
        logs = logs.where((F.col("start_time") <= now) & (F.col("end_time") >= now))
    return logs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("maintenance_count"))


def peer_medians(assets: DataFrame, counts: DataFrame) -> DataFrame:
    """Per asset: own alert count and the median count of its *other* active peers.

    Peers share type and criticality across all entities. Leaving one member out of a sorted
    group only shifts later positions by one, so three neighbouring order statistics per group
    answer every member. They are read off a histogram of counts; there is no self join and
    no sort of the members.
    """
    group = ["asset_type", "criticality"]
    sized = (assets.select(F.col("id").alias("asset_id"), *group, "status")
             .join(counts, "asset_id", "left")
             .withColumn("density", F.coalesce("alert_count", F.lit(0)).cast("long"))
             .select("asset_id", *group, "status", "density"))
    hist = sized.where("status = 'ACTIVE'").groupBy(*group, "density").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*group).orderBy("density").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    ranked = (hist.withColumn("hi", F.sum("n").over(upto)).withColumn("members", F.sum("n").over(whole))
              .withColumn("lo", F.col("hi") - F.col("n")))
    peers = F.col("members") - 1
    first = F.when(peers % 2 == 1, (peers - 1) / 2).otherwise(peers / 2 - 1).cast("long")
    stat = lambda k: F.max(F.when((F.col("lo") <= first + k) & (first + k < F.col("hi")), F.col("density")))
    stats = ranked.groupBy(*group).agg(F.max("members").alias("members"),
                                       stat(0).alias("s0"), stat(1).alias("s1"), stat(2).alias("s2"))
    own = F.col("density")
    in_group = F.col("status") == "ACTIVE"
    # Position k of the list without the asset itself; s_k moves up by one from the own value on.
    left_out = lambda a, b: F.when(a < own, a).otherwise(b)
    odd = (F.col("members") - 1) % 2 == 1
    median = (F.when(F.col("members") <= 1, F.lit(None).cast("double"))
              .when(odd, left_out(F.col("s0"), F.col("s1")).cast("double"))
              .otherwise((left_out(F.col("s0"), F.col("s1")) + left_out(F.col("s1"), F.col("s2"))) / 2.0))
    return (sized.join(stats, group, "left")
            .select("asset_id", "density", F.when(in_group, F.col("members") - 1).alias("peer_count"),
                    F.when(in_group, median).alias("peer_median")))


def telemetry_window(criticality: Column, asset_type: Column, params: RuleParams = RULES) -> Column:
    """Hours of silence an asset may show, from the expectation matrix."""
    out = F.lit(params.default_silence_hours)
    for e in reversed([e for e in params.expectations if e.category is None]):
        match = F.lit(True)
        if e.criticality is not None:
            match = match & (criticality == e.criticality)
        if e.asset_type is not None:
            match = match & (asset_type == e.asset_type)
        out = F.when(match, F.lit(e.window_hours)).otherwise(out)
    return out


def asset_rows(est: Estate, params: RuleParams = RULES) -> DataFrame:
    """One row per asset with everything the asset rules look at."""
    seen = asset_activity(est.telemetry).select("asset_id", F.col("alert_count").alias("telemetry_count"), "last_seen")
    dens = peer_medians(est.assets, asset_activity(est.alerts).select("asset_id", "alert_count"))
    maint = maintenance_counts(est.maintenance, "asset_id", est.as_of, params)
    base = est.assets.select(F.col("id").alias("asset_id"), "cse_id", F.col("name").alias("asset_name"), "asset_type",
                             F.col("criticality").alias("asset_criticality"), F.col("status").alias("asset_status"),
                             "decommissioned_at")
    silent = (S.seconds(F.to_timestamp(F.lit(est.as_of))) - S.seconds(F.col("last_seen"))) / 3600.0
    return (base.join(seen, "asset_id", "left").join(dens, "asset_id", "left").join(maint, "asset_id", "left")
            .withColumns({"maintenance_count": F.coalesce("maintenance_count", F.lit(0)).cast("long"), "silence_hours": silent,
                          "density_ratio": F.when(_c("peer_median") > 0, _c("density") / _c("peer_median"))
                          .when(_c("peer_median").isNotNull(), F.lit(1.0))}))


def _retired() -> Column:
    return (_c("asset_status") == "DECOMMISSIONED") | _c("decommissioned_at").isNotNull()


def neg01(completeness: float, params: RuleParams = RULES) -> Column:
    """A critical asset has gone silent."""
    window = telemetry_window(_c("asset_criticality"), _c("asset_type"), params)
    silence = F.coalesce(_c("silence_hours"), window + 1.0)
    status = (F.when(_c("asset_criticality") != "CRITICAL", "NOT_APPLICABLE")
              .when(F.lit(completeness < params.min_completeness), "UNKNOWN")
              .when(_retired() | (_c("maintenance_count") > 0), "SUPPRESSED")
              .when(silence >= window, "CONFIRMED").otherwise("PASS"))
    return verdict("NEG-01", "Asset", _c("asset_id"), status, severity="HIGH",
                   confidence=round(0.95 * S.confidence_modifier_value(completeness), 2), risk=25.0,
                   expected="Active critical assets report without long gaps.",
                   observed=text("No telemetry for ", S.one_decimal(silence), " h."),
                   reason=text("Complete telemetry silence of ", S.one_decimal(silence), " h on critical asset ", _c("asset_name"), "."),
                   recommendation="Check log forwarding, connectivity and the collector.")


def neg04(completeness: float, params: RuleParams = RULES) -> Column:
    """An important asset is watched far less than its peers."""
    applicable = _c("asset_criticality").isin("CRITICAL", "HIGH") & (_c("asset_status") == "ACTIVE")
    status = (F.when(~applicable, "NOT_APPLICABLE")
              .when(F.lit(completeness < params.min_completeness), "UNKNOWN")
              .when(_c("decommissioned_at").isNotNull(), "SUPPRESSED")
              .when(_c("peer_median").isNull(), "INSUFFICIENT_DATA")
              .when(_c("density_ratio") < params.density_ratio, "CONFIRMED").otherwise("PASS"))
    share = S.one_decimal(_c("density_ratio") * 100.0)
    return verdict("NEG-04", "Asset", _c("asset_id"), status, severity="MEDIUM",
                   confidence=round(0.85 * S.confidence_modifier_value(completeness), 2), risk=15.0,
                   expected=text("Alert volume near the peer median of ", S.one_decimal(_c("peer_median")), "."),
                   observed=text(_c("density"), " alerts, ", share, "% of the peer median."),
                   reason=text("Asset ", _c("asset_name"), " shows only ", share, "% of its peers' telemetry."),
                   recommendation="Audit the collection agent and sensor placement.")


def neg05(completeness: float, params: RuleParams = RULES) -> Column:
    """An asset is silent and no maintenance explains it."""
    limit = params.maintenance_silence_hours
    silence = F.coalesce(_c("silence_hours"), F.lit(limit + 1.0))
    status = (F.when(F.lit(completeness < params.min_completeness), "UNKNOWN")
              .when(_retired(), "SUPPRESSED")
              .when(silence < limit, "PASS")
              .when(_c("maintenance_count") > 0, "SUPPRESSED").otherwise("CONFIRMED"))
    return verdict("NEG-05", "Asset", _c("asset_id"), status, severity="HIGH",
                   confidence=round(0.90 * S.confidence_modifier_value(completeness), 2), risk=25.0,
                   expected="Silence is covered by an approved maintenance record.",
                   observed=text("Silent for ", S.one_decimal(silence), " h with no maintenance record."),
                   reason=text("Unexplained silence of ", S.one_decimal(silence), " h on asset ", _c("asset_name"), "."),
                   recommendation="Review change records for an unannounced outage.")


def daily_volume(telemetry: DataFrame, as_of: str, days: int) -> DataFrame:
    """Per entity: total count, recent 24 h count, and sum and sum of squares of the daily bins.

    Empty days add nothing to either sum, so bins never have to be filled with zeros. The recent
    count has no upper bound and the last bin ends at ``as_of``.
    """
    now = F.unix_micros(F.to_timestamp(F.lit(as_of)))
    t = F.unix_micros("created_at")
    start = now - F.lit(days * 86_400_000_000)
    day = F.floor((t - start) / F.lit(86_400_000_000))
    in_bins = (t >= start) & (day < days)
    per_day = (telemetry.withColumn("day", F.when(in_bins, day).otherwise(F.lit(-1)))
               .groupBy("cse_id", "day")
               .agg(F.count(F.lit(1)).alias("n"), S.count_where(t >= now - F.lit(86_400_000_000)).alias("recent")))
    binned = F.when(F.col("day") >= 0, F.col("n")).otherwise(0)
    return per_day.groupBy("cse_id").agg(
        F.sum("n").alias("total_count"), F.sum("recent").alias("recent_count"),
        F.sum(binned).cast("long").alias("bin_sum"), F.sum(binned * binned).cast("long").alias("bin_sum_sq"))


def volume_stats(volume: DataFrame, days: int) -> DataFrame:
    """Mean, population deviation, drop and z-score from exact integer sums."""
    s, q, n = F.col("bin_sum"), F.col("bin_sum_sq"), F.lit(days)
    mean = s / n
    std = F.sqrt((n * q - s * s).cast("double")) / n
    spread = F.when(std < 1e-6, 0.10 * mean).otherwise(std)
    gap = mean - F.col("recent_count")
    return (volume.withColumn("mean_daily", mean)
            .withColumn("std_daily", F.when(mean > 0, std).otherwise(F.lit(0.0)))
            .withColumn("drop_pct", F.when(mean > 0, S.rounded(gap / mean * 100.0, 2)).otherwise(F.lit(0.0)))
            .withColumn("z_score", F.when(mean > 0, S.rounded(gap / spread, 2)).otherwise(F.lit(0.0))))


def entity_rows(est: Estate, params: RuleParams = RULES) -> DataFrame:
    """One row per entity with its volume statistics and maintenance count."""
    stats = volume_stats(daily_volume(est.telemetry, est.as_of, params.baseline_days), params.baseline_days)
    maint = maintenance_counts(est.maintenance, "cse_id", est.as_of, params)
    base = est.entities.select(F.col("id").alias("cse_id"), F.col("name").alias("cse_name"), "sector", "size_tier")
    return (base.join(stats, "cse_id", "left").join(maint, "cse_id", "left")
            .withColumn("maintenance_count", F.coalesce("maintenance_count", F.lit(0)).cast("long")))


def neg02(completeness: float, params: RuleParams = RULES) -> Column:
    """An entity's alert volume collapsed against its own baseline."""
    silent = _c("total_count").isNull()
    status = (F.when(F.lit(completeness < params.min_completeness), "UNKNOWN")
              .when(_c("maintenance_count") > 0, "SUPPRESSED")
              .when(silent, "CONFIRMED")
              .when(F.lit(params.baseline_days < 7), "INSUFFICIENT_DATA")
              .when((_c("drop_pct") >= params.drop_pct) & (_c("z_score") >= params.drop_z), "CONFIRMED")
              .otherwise("PASS"))
    mean = S.one_decimal(_c("mean_daily"))
    return verdict("NEG-02", "CSE", _c("cse_id"), status, severity="CRITICAL",
                   confidence=round(0.95 * S.confidence_modifier_value(completeness), 2), risk=30.0,
                   calm_severity="INSUFFICIENT_DATA",
                   expected="Daily alert volume stays near its baseline.",
                   observed=F.when(silent, F.lit("No alerts at all.")).otherwise(
                       text(_c("recent_count"), " alerts in 24 h against a mean of ", mean, " a day.")),
                   reason=F.when(silent, text("Entity ", _c("cse_name"), " sent no alerts.")).otherwise(
                       text("Alert volume of ", _c("cse_name"), " fell by ", _c("drop_pct"), "% (z ", _c("z_score"), ").")),
                   recommendation="Check forwarders, firewall rules and the ingestion path.")


def category_rows(est: Estate, params: RuleParams = RULES) -> DataFrame:
    """(entity, expected category) with a flag for whether it was ever seen.

    The matrix is a short literal list, so expectations are exploded per entity; the alerts
    are reduced to distinct (entity, category) before they meet them.
    """
    wanted = [e for e in params.expectations if e.category is not None and e.applicable]
    options = []
    for e in wanted:
        match = F.lit(True)
        if e.sector is not None:
            match = match & (F.col("sector") == e.sector)
        if e.size_tier is not None:
            match = match & (F.col("size_tier") == e.size_tier)
        options.append(F.when(match, F.lit(e.category)))
    expected = (est.entities.select(F.col("id").alias("cse_id"), F.col("name").alias("cse_name"), "sector", "size_tier")
                .withColumn("expected_category", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull()))))
    observed = (est.alerts.groupBy("cse_id", F.col("category").alias("expected_category"))
                .agg(F.count(F.lit(1)).alias("category_count")))
    return expected.join(observed, ["cse_id", "expected_category"], "left")


def neg03(completeness: float, params: RuleParams = RULES) -> Column:
    """A mandatory alert category never shows up."""
    status = (F.when(F.lit(completeness < params.min_completeness), "UNKNOWN")
              .when(_c("category_count").isNull(), "CONFIRMED").otherwise("PASS"))
    return verdict("NEG-03", "CSE", _c("cse_id"), status, severity="HIGH", qualifier=_c("expected_category"),
                   confidence=round(0.90 * S.confidence_modifier_value(completeness), 2), risk=20.0,
                   expected=text("Category ", _c("expected_category"), " is part of the detection portfolio."),
                   observed=text("No ", _c("expected_category"), " alert recorded."),
                   reason=text("Mandatory category ", _c("expected_category"), " is absent at ", _c("cse_name"), "."),
                   recommendation="Review detection rules and endpoint coverage for the category.")


def asset_evaluations(est: Estate, params: RuleParams = RULES) -> DataFrame:
    c = est.completeness
    return evaluate(asset_rows(est, params), [neg01(c, params), neg04(c, params), neg05(c, params)])


def entity_evaluations(est: Estate, params: RuleParams = RULES) -> DataFrame:
    return evaluate(entity_rows(est, params), [neg02(est.completeness, params)])


def category_evaluations(est: Estate, params: RuleParams = RULES) -> DataFrame:
    return evaluate(category_rows(est, params), [neg03(est.completeness, params)])
