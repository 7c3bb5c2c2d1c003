"""Threat-intelligence matching and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lacuna import params as P
from lacuna.functions import scalar as S

CPE_FIELDS = ["part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other"]


def cpe_parts(cpe: Column) -> Column:
    """Struct of the eleven CPE 2.3 attributes, short names padded with ``*``; null if not a CPE."""
    bits = F.split(cpe, ":")
    ok = cpe.startswith("cpe:2.3:") & (F.size(bits) >= 5)
    return F.when(ok, F.struct(*[F.lower(F.coalesce(F.get(bits, F.lit(i + 2)), F.lit("*"))).alias(n) for i, n in enumerate(CPE_FIELDS)]))


def cpe_satisfies(own: Column, wanted: Column) -> Column:
    """Whether a CPE meets criteria; a ``*`` in the criteria accepts anything, and so does an unknown version."""
    same = lambda f: (wanted[f] == "*") | (own[f] == wanted[f])
    return same("part") & same("vendor") & same("product") & (same("version") | (own["version"] == "*"))


def cpe_entries(nvd: DataFrame) -> DataFrame:
    """One row per (CVE, criterion) with vendor, product and version split out."""
    rows = nvd.select("cve_id", F.posexplode("cpe_match_criteria").alias("place", "cpe")).withColumn("p", cpe_parts(F.col("cpe")))
    return rows.where("p is not null").select("cve_id", "place", "cpe", "p.vendor", "p.product", "p.version")


def cpe_index(nvd: DataFrame) -> DataFrame:
    """CVE count and smallest CVE per criterion."""
    return cpe_entries(nvd).groupBy("cpe").agg(F.countDistinct("cve_id").alias("cve_count"), F.min("cve_id").alias("first_cve"))


def match_software(software: DataFrame, entries: DataFrame) -> DataFrame:
    """Match (vendor, product, version) rows against the index, one verdict row each.

    An equi join on vendor and product; exactness is a residual condition and everything else one
    aggregate, so no list of CVEs is gathered. :func:`matched_cves` gives the CVEs as rows.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    want = software.select("*", norm(F.col("vendor")).alias("v"), norm(F.col("product")).alias("q"), S.text_or_default(norm(F.col("version")), "*").alias("w"))
    pairs = want.select("v", "q", "w").distinct().join(
        entries.select(F.col("vendor").alias("v"), F.col("product").alias("q"), F.col("version").alias("ev"), "cve_id", "cpe"), ["v", "q"])
    exact = (F.col("ev") == F.col("w")) & (F.col("w") != "*")
    loose = (F.col("ev") == "*") | (F.col("w") == "*")
    hit = F.struct("cve_id", "cpe")
    seen = pairs.groupBy("v", "q", "w").agg(
        F.countDistinct(F.when(exact, F.col("cve_id"))).alias("n_exact"), F.min(F.when(exact, hit)).alias("exact_hit"),
        F.countDistinct(F.when(~exact & loose, F.col("cve_id"))).alias("n_loose"), F.min(F.when(~exact & loose, hit)).alias("loose_hit"))
    rows = want.join(seen, ["v", "q", "w"], "left")
    is_exact, is_loose = F.coalesce(F.col("n_exact") > 0, F.lit(False)), F.coalesce(F.col("n_loose") > 0, F.lit(False))
    best = F.when(is_exact, F.col("exact_hit")).when(is_loose, F.col("loose_hit"))
    count = F.when(is_exact, F.col("n_exact")).when(is_loose, F.col("n_loose")).otherwise(F.lit(0))
    status = F.when(is_exact, "EXACT_MATCH").when(is_loose & (F.col("n_loose") > 5), "AMBIGUOUS_MATCH").when(is_loose, "VERSION_MATCH").otherwise("UNMAPPED")
    conf = F.when(is_exact, 1.0).when(is_loose & (F.col("n_loose") > 5), 0.5).when(is_loose, 0.85).otherwise(0.0)
    return rows.select(*software.columns, status.alias("match_status"), conf.alias("match_confidence"), count.cast("long").alias("cve_count"),
                       best["cve_id"].alias("primary_cve"), best["cpe"].alias("matched_cpe"))


def matched_cves(software: DataFrame, entries: DataFrame) -> DataFrame:
    """(vendor, product, version, cve_id) rows behind each verdict: exact ones where any exist, else loose ones."""
    verdicts = match_software(software, entries).where("match_status <> 'UNMAPPED'").select("vendor", "product", "version", "match_status").distinct()
    e = entries.select("vendor", "product", F.col("version").alias("ev"), "cve_id")
    exact = (F.col("ev") == F.lower("version")) & (F.col("version") != "*")
    loose = (F.col("ev") == "*") | (F.col("version") == "*")
    keep = F.when(F.col("match_status") == "EXACT_MATCH", exact).otherwise(loose)
    return verdicts.join(e, ["vendor", "product"]).where(keep).select("vendor", "product", "version", "cve_id").distinct()


def asset_profiles(spark: SparkSession) -> DataFrame:
    """The fixed software profile per asset type: seven rows."""
    return spark.createDataFrame(P.ASSET_PROFILES, "asset_type string, vendor string, product string, version string, threat_group string")


def enrich_types(spark: SparkSession, nvd: DataFrame, kev: DataFrame) -> DataFrame:
    """Threat context per known asset type. Matching works on the profile rows, not on every asset."""
    matched = match_software(asset_profiles(spark), cpe_entries(nvd))
    scores = nvd.select(F.col("cve_id").alias("primary_cve"), "cvss_v3_base_score", "cvss_v3_severity")
    exploited = kev.select(F.col("cve_id").alias("primary_cve"), F.lit(True).alias("in_kev"), "known_ransomware_campaign_use")
    rows = matched.join(scores, "primary_cve", "left").join(exploited, "primary_cve", "left")
    is_kev = F.coalesce("in_kev", F.lit(False))
    ransom = F.when(is_kev, F.col("known_ransomware_campaign_use")).otherwise("Unknown")
    mapped = F.col("match_status") != "UNMAPPED"
    score = F.col("cvss_v3_base_score")
    modifier = (F.when(score >= 9.0, 10.0).when(score >= 7.0, 5.0).otherwise(0.0) + F.when(is_kev, 15.0).otherwise(0.0)
                + F.when(ransom == "Known", 5.0).otherwise(0.0))
    return rows.select("asset_type", "match_status", "matched_cpe", "primary_cve", F.col("cvss_v3_base_score").alias("cvss_base_score"),
                       F.col("cvss_v3_severity").alias("cvss_severity"), is_kev.alias("is_kev"), F.when(mapped, ransom).alias("ransomware_use"),
                       F.when(mapped, F.col("threat_group")).alias("threat_group"), F.when(mapped, modifier).otherwise(0.0).alias("threat_score_modifier"))


def enrich_assets(assets: DataFrame, types: DataFrame) -> DataFrame:
    """Every asset with the context of its type; unknown types stay unmapped."""
    known = F.broadcast(types.withColumnRenamed("asset_type", "known_type"))  # one row per fixed profile
    return (assets.join(known, F.upper("asset_type") == F.col("known_type"), "left").drop("known_type")
            .withColumn("match_status", F.coalesce("match_status", F.lit("UNMAPPED"))).withColumn("is_kev", F.coalesce("is_kev", F.lit(False)))
            .withColumn("threat_score_modifier", F.coalesce("threat_score_modifier", F.lit(0.0))))


def rule_techniques(spark: SparkSession, techniques: DataFrame) -> DataFrame:
    """Rule to technique with the catalogue's name and tactics: eleven rows."""
    rules = spark.createDataFrame(P.RULE_TECHNIQUES, "rule_id string, technique_id string, mapping_type string, mapping_confidence double")
    names = techniques.select(F.col("id").alias("technique_id"), F.col("name").alias("technique_name"), "tactics")
    bonus = F.when(F.col("mapping_type") == "DIRECT", 5.0).when(F.col("mapping_type") == "SUPPORTED_INFERENCE", 2.5).otherwise(0.0)
    return (rules.join(names, "technique_id", "left").withColumn("technique_name", F.coalesce("technique_name", "technique_id"))
            .withColumn("threat_score_modifier", bonus))


def enrich_findings(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Findings with technique, tactics and modifier; rules without a mapping stay unmapped."""
    return (findings.join(F.broadcast(mapping), "rule_id", "left")  # fixed rule table
            .withColumn("mapping_type", F.coalesce("mapping_type", F.lit("UNMAPPED")))
            .withColumn("mapping_confidence", F.coalesce("mapping_confidence", F.lit(0.0)))
            .withColumn("threat_score_modifier", F.coalesce("threat_score_modifier", F.lit(0.0))))


def overlap(nvd: DataFrame, kev: DataFrame) -> DataFrame:
    """Every CVE of either catalogue with where it appears and what disagrees, from one full join."""
    left = nvd.select("cve_id", F.lit(True).alias("in_nvd"), "cvss_v3_base_score", F.lower("description").alias("text"))
    right = kev.select("cve_id", F.lit(True).alias("in_kev"), F.lower("product").alias("product"), F.lower("vendor_project").alias("vendor"))
    rows = left.join(right, "cve_id", "full").withColumn("in_nvd", F.coalesce("in_nvd", F.lit(False))).withColumn("in_kev", F.coalesce("in_kev", F.lit(False)))
    both = F.col("in_nvd") & F.col("in_kev")
    diverges = (F.col("product") != "") & ~F.col("text").contains(F.col("product")) & ~F.col("text").contains(F.col("vendor"))
    return rows.select("cve_id", "in_nvd", "in_kev", (both & F.col("cvss_v3_base_score").isNull()).alias("missing_cvss"), (both & diverges).alias("name_diverges"))


def overlap_summary(rows: DataFrame) -> DataFrame:
    both = F.col("in_nvd") & F.col("in_kev")
    return rows.agg(
        S.count_where(F.col("in_nvd")).alias("total_nvd_records"), S.count_where(F.col("in_kev")).alias("total_kev_records"), S.count_where(both).alias("overlap_count"),
        S.count_where(F.col("in_nvd") & ~F.col("in_kev")).alias("nvd_only_count"), S.count_where(F.col("in_kev") & ~F.col("in_nvd")).alias("kev_only_count"),
        S.count_where(both & ~F.col("name_diverges")).alias("consistent_overlap_count"),
        (S.count_where(F.col("missing_cvss")) + S.count_where(F.col("name_diverges"))).alias("conflict_count"))


def overlap_conflicts(rows: DataFrame) -> DataFrame:
    kinds = F.filter(F.array(F.when(F.col("missing_cvss"), F.lit("MISSING_NVD_CVSS")), F.when(F.col("name_diverges"), F.lit("PRODUCT_NAME_DIVERGENCE"))), lambda x: x.isNotNull())
    return rows.select("cve_id", F.explode(kinds).alias("issue_type"))


def shared_ids(nvd: DataFrame, kev: DataFrame) -> DataFrame:
    return nvd.select("cve_id").intersect(kev.select("cve_id"))


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("cve_id").subtract(right.select("cve_id"))
