"""Threat-intelligence queries. Parts play the vulnerability feeds, geography and suppliers the technique bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import intel as IN
from lacuna.params import ASSET_PROFILES, RULE_TECHNIQUES
from lacuna.plans.ctes import cte
from lacuna.plans.lens import Tables, assets as lens_assets
from lacuna.plans.registry import query
from lacuna.plans.stages import analysis
from lacuna.sources import catalogs as C

TECHNIQUES = ["T1562", "T1562.001", "T1078", "T1070", "T1068", "T1486", "T1562.002", "T1070.001", "T1190"]
# Asset types of the estate as the profile table names them.
TYPE_NAMES = {"MACHINERY": "WEB_SERVER", "BUILDING": "DOMAIN_CONTROLLER", "AUTOMOBILE": "REMOTE_ACCESS_VPN", "HOUSEHOLD": "EMAIL_GATEWAY"}
_CPES = [f"{v}:{p}" for _, v, p, _, _ in ASSET_PROFILES]
_VERSIONS = [w for _, _, _, w, _ in ASSET_PROFILES]


def nvd_items(spark, d):
    """One feed item per part; two neighbouring parts share an id, sizes 49 and 50 have none or a bad one."""
    p = Tables(spark, d).part
    half = F.floor(F.col("p_partkey") / 2)
    good = F.concat(F.lit("CVE-"), (F.lit(2000) + half % 20).cast("string"), F.lit("-"), F.lpad(half.cast("string"), 5, "0"))
    size, kind = F.col("p_size"), F.col("p_type")
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 8
    names, versions = F.array(*[F.lit(x) for x in _CPES]), F.array(*[F.lit(x) for x in _VERSIONS])
    software = F.coalesce(F.get(names, brand), F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(":"), F.substring_index("p_name", " ", -1)))
    version = F.when(size % 3 == 0, "*").when(size % 3 == 1, F.coalesce(F.get(versions, brand), F.lit("1.0"))).otherwise(F.concat(F.lit("1."), size.cast("string")))
    score = ((size % 10) + 0.5).cast("double")
    cvss = lambda ok: F.when(ok, F.array(F.struct(F.struct(F.lit("x").alias("version"), F.lit("AV:N").alias("vectorString"), score.alias("baseScore"),
                                                           F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").otherwise("MEDIUM").alias("baseSeverity")).alias("cvssData"))))
    say = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    texts = F.when(kind == "PROMO", F.array(say("fr", F.col("p_name")))).otherwise(
        F.array(say("es", F.concat(F.lit("es "), F.col("p_name"))), say("en", F.concat("p_name", F.lit(" by "), "p_brand"))))
    weak = lambda v: F.struct(F.array(say("en", v)).alias("description"))
    cve = F.struct(
        F.when(size == 50, "CVE-BAD").when(size == 49, "").otherwise(good).alias("id"), texts.alias("descriptions"), F.lit("2024-01-01").alias("published"),
        F.lit("2024-01-02").alias("lastModified"),
        F.struct(cvss(kind.isin("ECONOMY", "LARGE")).alias("cvssMetricV31"), cvss(kind.isin("STANDARD", "LARGE")).alias("cvssMetricV30"), cvss(kind.isin("SMALL", "LARGE")).alias("cvssMetricV2")).alias("metrics"),
        F.array(weak(F.concat(F.lit("CWE-"), size.cast("string"))), weak(F.lit("NVD-CWE-noinfo"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit(True).alias("vulnerable"), F.concat(F.lit("cpe:2.3:a:"), software, F.lit(":"), version).alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
        F.array(F.struct(F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("url"))).alias("references")).cast(C.NVD_ITEM)
    return p.select(F.col("p_partkey").alias("pos"), cve.alias("cve"))


def kev_items(spark, d):
    """Parts up to size 30 are exploited; those above 45 under ids the feed does not know, the rest under ids no parser takes."""
    p = Tables(spark, d).part
    half = F.floor(F.col("p_partkey") / 2)
    known = F.concat(F.lit("CVE-"), (F.lit(2000) + half % 20).cast("string"), F.lit("-"), F.lpad(half.cast("string"), 5, "0"))
    item = F.struct(
        F.when((F.col("p_size") == 50) | F.col("p_size").between(31, 45), "bad id").when(F.col("p_size") > 45, F.concat(F.lit("CVE-2024-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))).otherwise(known).alias("cveID"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_brand")).alias("vendorProject"),
        F.when(F.col("p_type") == "SMALL", F.lit("router")).otherwise(F.substring_index("p_name", " ", -1)).alias("product"),
        F.lit("").alias("vulnerabilityName"), F.lit("2024-01-01").alias("dateAdded"), F.lit("x").alias("shortDescription"), F.lit("").alias("requiredAction"),
        F.lit("2024-02-01").alias("dueDate"), F.when(F.col("p_type") == "ECONOMY", "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"), F.lit("").alias("notes")).cast(C.KEV_ITEM)
    return p.select(F.col("p_partkey").alias("pos"), item.alias("item"))


cte("nvd_all", "", f"""SELECT p_partkey AS pos, CASE WHEN p_size = 50 THEN 'CVE-BAD' WHEN p_size = 49 THEN '' ELSE 'CVE-' || (2000 + (p_partkey // 2) % 20) || '-' || lpad(cast(p_partkey // 2 as varchar), 5, '0') END AS cve_id,
 CASE WHEN p_type = 'PROMO' THEN p_name ELSE p_name || ' by ' || p_brand END AS description, CASE WHEN p_type IN ('ECONOMY','LARGE','STANDARD') THEN (p_size % 10 + 0.5)::double END AS cvss_v3_base_score, CASE WHEN p_type IN ('SMALL','LARGE') THEN (p_size % 10 + 0.5)::double END AS cvss_v2_base_score,
 'CWE-' || p_size AS cwes, coalesce({_CPES!r}[cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) % 8 + 1], lower(replace(p_brand, '#', '')) || ':' || split_part(p_name, ' ', -1)) AS software,
 CASE WHEN p_size % 3 = 0 THEN '*' WHEN p_size % 3 = 1 THEN coalesce({_VERSIONS!r}[cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) % 8 + 1], '1.0') ELSE '1.' || p_size END AS version FROM part""")
cte("nvd", "nvd_all", """SELECT *, CASE WHEN cvss_v3_base_score >= 9 THEN 'CRITICAL' WHEN cvss_v3_base_score >= 7 THEN 'HIGH' WHEN cvss_v3_base_score IS NOT NULL THEN 'MEDIUM' END AS cvss_v3_severity, 'cpe:2.3:a:' || software || ':' || version AS cpe
 FROM nvd_all WHERE cve_id LIKE 'CVE-2%' QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY pos) = 1""")
cte("kev_all", "", """SELECT p_partkey AS pos, CASE WHEN p_size = 50 OR p_size BETWEEN 31 AND 45 THEN 'bad id' WHEN p_size > 45 THEN 'CVE-2024-' || lpad(cast(p_partkey as varchar), 6, '0') ELSE 'CVE-' || (2000 + (p_partkey // 2) % 20) || '-' || lpad(cast(p_partkey // 2 as varchar), 5, '0') END AS cve_id,
 CASE WHEN p_type = 'PROMO' THEN 'Unknown' ELSE p_brand END AS vendor_project, CASE WHEN p_type = 'SMALL' THEN 'router' ELSE split_part(p_name, ' ', -1) END AS product, CASE WHEN p_type = 'ECONOMY' THEN 'Known' ELSE 'Unknown' END AS known_ransomware_campaign_use, p_type FROM part""")
cte("kev", "kev_all", "SELECT * FROM kev_all WHERE cve_id LIKE 'CVE-2%' QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY pos) = 1")


@query("nvd_records", "nvd", "SELECT cve_id, description, cvss_v3_base_score, cvss_v3_severity, cvss_v2_base_score, cwes, cpe, 'https://example.org/' || pos AS refs FROM nvd")
def nvd_records(spark, d):
    return C.parse_nvd(nvd_items(spark, d)).select("cve_id", "description", "cvss_v3_base_score", "cvss_v3_severity", "cvss_v2_base_score", F.array_join("cwe_ids", ",").alias("cwes"),
                                                   F.array_join("cpe_match_criteria", ",").alias("cpe"), F.array_join("references", ",").alias("refs"))


@query("kev_records", "kev", "SELECT cve_id, vendor_project, product, 'Vulnerability ' || cve_id AS vulnerability_name, 'Apply vendor updates.' AS required_action, known_ransomware_campaign_use FROM kev")
def kev_records(spark, d):
    return C.parse_kev(kev_items(spark, d)).select("cve_id", "vendor_project", "product", "vulnerability_name", "required_action", "known_ransomware_campaign_use")


_QUAL = lambda name, src, lacks: f"""SELECT '{name}' AS source_name, count(*) AS total_records, (SELECT count(*) FROM {src}) AS valid_records, count(*) FILTER (cve_id NOT LIKE 'CVE-2%') AS rejected_records,
 count(*) FILTER (cve_id LIKE 'CVE-2%') - (SELECT count(*) FROM {src}) AS duplicate_records, count(*) FILTER (cve_id NOT LIKE 'CVE-2%' AND cve_id <> '') AS malformed_ids, count(*) FILTER (cve_id = '') + {lacks} AS missing_required_fields FROM {src}_all"""


@query("vulnerability_parse_quality", "nvd kev", _QUAL("NVD", "nvd", "0") + " UNION ALL " + _QUAL("KEV", "kev", "(SELECT count(*) FROM kev WHERE p_type = 'PROMO')"))
def vulnerability_parse_quality(spark, d):
    return C.nvd_quality(nvd_items(spark, d)).unionByName(C.kev_quality(kev_items(spark, d)))


def stix_items(spark, d):
    t = Tables(spark, d)
    text, none = lambda v: F.lit(v).cast("string"), F.lit(None)

    def obj(df, pos, kind, ident, name, external=None, phase=None, revoked=None, src=None, dst=None, rel=None):
        refs = F.array(F.struct(F.lit("mitre").alias("source_name"), external.alias("external_id"))) if external is not None else none
        phases = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), phase.alias("phase_name"))) if phase is not None else none
        fields = [kind if not isinstance(kind, str) else F.lit(kind), ident, name, text(""), refs, none, none, phases, none, none, none, revoked if revoked is not None else none, none,
                  src if src is not None else none, dst if dst is not None else none, rel if rel is not None else none]
        names = ["type", "id", "name", "description", "external_references", "x_mitre_shortname", "x_mitre_version", "kill_chain_phases", "x_mitre_is_subtechnique", "x_mitre_platforms", "aliases", "revoked",
                 "x_mitre_deprecated", "source_ref", "target_ref", "relationship_type"]
        return df.select(pos.cast("long").alias("pos"), F.struct(*[f.alias(n) for f, n in zip(fields, names)]).cast(C.STIX_ITEM).alias("item"))

    n, s, o, g = F.col("n_nationkey"), F.col("s_suppkey"), F.col("o_orderkey"), F.col("r_regionkey")
    ids = F.array(*[F.lit(x) for x in TECHNIQUES])
    tech = F.when(n == 23, F.concat(F.lit("X"), n.cast("string"))).otherwise(F.coalesce(F.get(ids, n), F.concat(F.lit("T"), (n + 2000).cast("string"))))
    named = t.nation.join(t.region, F.col("n_regionkey") == g)
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    parts = [obj(t.region, g, "x-mitre-tactic", cat("x-mitre-tactic--", g), F.col("r_name"), cat("TA000", g)),
             obj(named, n, "attack-pattern", cat("attack-pattern--", n), F.when(n == 13, "").otherwise(F.concat(F.lit("Technique "), F.col("n_name"))), tech, F.lower("r_name"), n == 19),
             obj(t.supplier, s, "intrusion-set", cat("intrusion-set--", s), F.col("s_name"), cat("G", s % 60)),
             obj(t.supplier, s, F.when(s % 2 == 0, "malware").otherwise("tool"), cat("malware--", s), F.col("s_name"), cat("S", s)),
             obj(t.region, g, "course-of-action", cat("course-of-action--", g), F.col("r_name"), cat("M", g)),
             obj(t.orders, o, "relationship", cat("relationship--", o), none, src=cat("intrusion-set--", F.col("o_custkey")), dst=F.when(F.col("o_orderstatus") == "P", "").otherwise(cat("malware--", o)), rel=text("uses")),
             obj(t.nation, n, "identity", cat("identity--", n), F.col("n_name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


cte("techniques", "", f"""SELECT CASE WHEN n_nationkey = 23 THEN 'X23' ELSE coalesce({TECHNIQUES!r}[n_nationkey + 1], 'T' || (n_nationkey + 2000)) END AS id, 'Technique ' || n_name AS name, lower(r_name) AS tactics FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey NOT IN (13, 19)""")


@query("attack_techniques", "techniques", "SELECT id, name, tactics FROM techniques")
def attack_techniques(spark, d):
    return C.stix_table(stix_items(spark, d), "technique").select("id", "name", F.array_join("tactics", ",").alias("tactics"))


@query("attack_groups", "", "SELECT 'G' || (s_suppkey % 60) AS id, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1")
def attack_groups(spark, d):
    return C.stix_table(stix_items(spark, d), "group").select("id", "name")


@query("attack_tactics", "", "SELECT 'TA000' || r_regionkey AS id, r_name AS name, replace(lower(r_name), ' ', '-') AS shortname FROM region")
def attack_tactics(spark, d):
    return C.stix_table(stix_items(spark, d), "tactic").select("id", "name", "shortname")


@query("attack_relationships", "", "SELECT 'relationship--' || o_orderkey AS id, 'intrusion-set--' || o_custkey AS source_ref, 'malware--' || o_orderkey AS target_ref, 'uses' AS relationship_type FROM orders WHERE o_orderstatus <> 'P'")
def attack_relationships(spark, d):
    return C.stix_table(stix_items(spark, d), "relationship")


@query("attack_parse_quality", "", """SELECT (SELECT 2 * count(*) FROM region) + (SELECT 2 * count(*) FROM nation) + (SELECT 2 * count(*) FROM supplier) + (SELECT count(*) FROM orders) AS total_records,
 (SELECT 2 * count(*) FROM region) + (SELECT count(*) - 2 FROM nation) + (SELECT 2 * count(*) FROM supplier) + (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS valid_records, (SELECT count(*) + 1 FROM nation) AS rejected_records, 1::BIGINT AS malformed_ids,
 (SELECT count(*) + 1 FROM orders WHERE o_orderstatus = 'P') AS missing_required_fields, 1::BIGINT AS deprecated_or_revoked""")
def attack_parse_quality(spark, d):
    return C.stix_quality(stix_items(spark, d))


@query("catalogue_counts", "techniques", """SELECT 'tactic' AS kind, count(*) AS n FROM region UNION ALL SELECT 'technique', count(*) FROM techniques UNION ALL SELECT 'group', count(DISTINCT s_suppkey % 60) FROM supplier
 UNION ALL SELECT 'software', count(*) FROM supplier UNION ALL SELECT 'relationship', count(*) FROM orders WHERE o_orderstatus <> 'P'""")
def catalogue_counts(spark, d):
    return C.catalogue_counts(stix_items(spark, d))


def _nvd(spark, d):
    return C.parse_nvd(nvd_items(spark, d))


def _kev(spark, d):
    return C.parse_kev(kev_items(spark, d))


@query("cpe_index", "nvd", "SELECT cpe, count(DISTINCT cve_id) AS cve_count, min(cve_id) AS first_cve FROM nvd GROUP BY 1")
def cpe_index(spark, d):
    return IN.cpe_index(_nvd(spark, d))


@query("cpe_entries", "nvd", "SELECT cve_id, split_part(software, ':', 1) AS vendor, split_part(software, ':', 2) AS product, version FROM nvd")
def cpe_entries(spark, d):
    return IN.cpe_entries(_nvd(spark, d)).select("cve_id", "vendor", "product", "version")


@query("cpe_wildcards", "nvd", """SELECT cve_id, software LIKE 'apache:log4j' AND version IN ('*', '2.14.1') AS accepts_log4j, software LIKE 'apache:%' AS accepts_any_apache FROM nvd""")
def cpe_wildcards(spark, d):
    rows = _nvd(spark, d).select("cve_id", IN.cpe_parts(F.element_at("cpe_match_criteria", 1)).alias("p"))
    log4j = IN.cpe_parts(F.lit("cpe:2.3:a:apache:log4j:2.14.1"))
    apache = IN.cpe_parts(F.lit("cpe:2.3:a:apache:*"))
    return rows.select("cve_id", IN.cpe_satisfies(F.col("p"), log4j).alias("accepts_log4j"), IN.cpe_satisfies(F.col("p"), apache).alias("accepts_any_apache"))


_VALUES = ", ".join(f"('{t}', '{v}', '{p}', '{w}', '{g}')" for t, v, p, w, g in ASSET_PROFILES)
cte("software", "", f"SELECT * FROM (VALUES {_VALUES}) x(asset_type, vendor, product, version, threat_group)")
cte("cpe_hits", "software nvd", """SELECT s.asset_type, n.cve_id, n.cpe, n.version = s.version AND s.version <> '*' AS exact FROM software s JOIN nvd n ON n.software = s.vendor || ':' || s.product WHERE n.version = s.version OR n.version = '*' OR s.version = '*'""")
cte("cpe_match", "software cpe_hits", """SELECT s.*, CASE WHEN ne > 0 THEN 'EXACT_MATCH' WHEN nl > 5 THEN 'AMBIGUOUS_MATCH' WHEN nl > 0 THEN 'VERSION_MATCH' ELSE 'UNMAPPED' END AS match_status, CASE WHEN ne > 0 THEN 1.0::double WHEN nl > 5 THEN 0.5::double WHEN nl > 0 THEN 0.85::double ELSE 0.0::double END AS match_confidence,
 coalesce(CASE WHEN ne > 0 THEN ne ELSE nl END, 0) AS cve_count, CASE WHEN ne > 0 THEN ce ELSE cl END AS primary_cve FROM software s LEFT JOIN (SELECT asset_type, count(DISTINCT cve_id) FILTER (exact) AS ne, count(DISTINCT cve_id) FILTER (NOT exact) AS nl,
 min(cve_id) FILTER (exact) AS ce, min(cve_id) FILTER (NOT exact) AS cl FROM cpe_hits GROUP BY 1) h ON h.asset_type = s.asset_type""")


@query("cpe_match", "cpe_match", "SELECT asset_type, vendor, product, version, match_status, match_confidence, cve_count, primary_cve FROM cpe_match")
def cpe_match(spark, d):
    return IN.match_software(IN.asset_profiles(spark), IN.cpe_entries(_nvd(spark, d))).select("asset_type", "vendor", "product", "version", "match_status", "match_confidence", "cve_count", "primary_cve")


@query("cpe_matched_cves", "cpe_hits cpe_match", "SELECT DISTINCT vendor, product, version, cve_id FROM cpe_hits h JOIN cpe_match m ON m.asset_type = h.asset_type WHERE match_status <> 'EXACT_MATCH' OR exact")
def cpe_matched_cves(spark, d):
    return IN.matched_cves(IN.asset_profiles(spark), IN.cpe_entries(_nvd(spark, d)))


def typed_assets(spark, d):
    a = lens_assets(Tables(spark, d))
    name = F.create_map(*[x for k, v in TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return a.withColumn("asset_type", F.coalesce(F.try_element_at(name, F.col("asset_type")), F.lit("WORKSTATION")))


_TYPES = "CASE asset_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items()) + " ELSE 'WORKSTATION' END"
cte("enriched", "assets cpe_match nvd kev", f"""SELECT *, CASE WHEN match_status = 'UNMAPPED' THEN 0.0::double ELSE CASE WHEN cvss_base_score >= 9 THEN 10.0::double WHEN cvss_base_score >= 7 THEN 5.0::double ELSE 0.0::double END + CASE WHEN is_kev THEN 15.0::double ELSE 0.0::double END + CASE WHEN ransomware_use = 'Known' THEN 5.0::double ELSE 0.0::double END END AS threat_score_modifier FROM (
 SELECT a.id, a.cse_id, a.name, a.t AS asset_type, a.criticality, a.status, coalesce(match_status, 'UNMAPPED') AS match_status, primary_cve, n.cvss_v3_base_score AS cvss_base_score, k.cve_id IS NOT NULL AS is_kev,
 CASE WHEN coalesce(match_status, 'UNMAPPED') <> 'UNMAPPED' THEN coalesce(k.known_ransomware_campaign_use, 'Unknown') END AS ransomware_use, CASE WHEN coalesce(match_status, 'UNMAPPED') <> 'UNMAPPED' THEN threat_group END AS threat_group
 FROM (SELECT *, {_TYPES} AS t FROM assets) a LEFT JOIN cpe_match m ON m.asset_type = a.t LEFT JOIN nvd n ON n.cve_id = m.primary_cve LEFT JOIN kev k ON k.cve_id = m.primary_cve)""")
_E = "id, asset_type, match_status, primary_cve, cvss_base_score, is_kev, ransomware_use, threat_group, threat_score_modifier"


def enriched(spark, d):
    return IN.enrich_assets(typed_assets(spark, d), IN.enrich_types(spark, _nvd(spark, d), _kev(spark, d)))


def technique_map(spark, d):
    return IN.rule_techniques(spark, C.stix_table(stix_items(spark, d), "technique"))


@query("asset_enrichment", "enriched", f"SELECT {_E} FROM enriched")
def asset_enrichment(spark, d):
    return enriched(spark, d).select(*_E.split(", "))


_RT = ", ".join(f"('{a}', '{b}', '{c}', {e}::double)" for a, b, c, e in RULE_TECHNIQUES)
cte("technique_map", "techniques", f"""SELECT m.*, coalesce(name, technique_id) AS technique_name, coalesce(tactics, '') AS tactics, CASE mapping_type WHEN 'DIRECT' THEN 5.0::double ELSE 2.5::double END AS threat_score_modifier
 FROM (VALUES {_RT}) m(rule_id, technique_id, mapping_type, mapping_confidence) LEFT JOIN techniques t ON t.id = technique_id""")


@query("finding_enrichment", "findings technique_map", "SELECT finding_id, f.rule_id, technique_id, technique_name, tactics, mapping_type, mapping_confidence, threat_score_modifier FROM findings f JOIN technique_map t ON t.rule_id = f.rule_id")
def finding_enrichment(spark, d):
    out = IN.enrich_findings(analysis(spark, d).findings, technique_map(spark, d))
    return out.select("finding_id", "rule_id", "technique_id", "technique_name", F.array_join("tactics", ",").alias("tactics"), "mapping_type", "mapping_confidence", "threat_score_modifier")


cte("cross", "nvd kev", """SELECT coalesce(n.cve_id, k.cve_id) AS cve_id, n.cve_id IS NOT NULL AS in_nvd, k.cve_id IS NOT NULL AS in_kev, n.cve_id IS NOT NULL AND k.cve_id IS NOT NULL AND cvss_v3_base_score IS NULL AS missing_cvss,
 coalesce(n.cve_id IS NOT NULL AND k.cve_id IS NOT NULL AND NOT contains(lower(description), lower(product)) AND NOT contains(lower(description), lower(vendor_project)), false) AS name_diverges FROM nvd n FULL JOIN kev k ON k.cve_id = n.cve_id""")


@query("cross_source_summary", "cross", """SELECT count(*) FILTER (in_nvd) AS total_nvd_records, count(*) FILTER (in_kev) AS total_kev_records, count(*) FILTER (in_nvd AND in_kev) AS overlap_count, count(*) FILTER (in_nvd AND NOT in_kev) AS nvd_only_count,
 count(*) FILTER (in_kev AND NOT in_nvd) AS kev_only_count, count(*) FILTER (in_nvd AND in_kev AND NOT name_diverges) AS consistent_overlap_count, count(*) FILTER (missing_cvss) + count(*) FILTER (name_diverges) AS conflict_count FROM cross""".replace("FROM cross", 'FROM "cross"'))
def cross_source_summary(spark, d):
    return IN.overlap_summary(IN.overlap(_nvd(spark, d), _kev(spark, d)))


@query("cross_source_conflicts", "cross", "SELECT cve_id, 'MISSING_NVD_CVSS' AS issue_type FROM \"cross\" WHERE missing_cvss UNION ALL SELECT cve_id, 'PRODUCT_NAME_DIVERGENCE' FROM \"cross\" WHERE name_diverges")
def cross_source_conflicts(spark, d):
    return IN.overlap_conflicts(IN.overlap(_nvd(spark, d), _kev(spark, d)))


@query("cve_shared", "nvd kev", "SELECT cve_id FROM nvd INTERSECT SELECT cve_id FROM kev")
def cve_shared(spark, d):
    return IN.shared_ids(_nvd(spark, d), _kev(spark, d))


@query("cve_nvd_only", "nvd kev", "SELECT cve_id FROM nvd EXCEPT SELECT cve_id FROM kev")
def cve_nvd_only(spark, d):
    return IN.only_in(_nvd(spark, d), _kev(spark, d))


@query("cve_kev_only", "nvd kev", "SELECT cve_id FROM kev EXCEPT SELECT cve_id FROM nvd")
def cve_kev_only(spark, d):
    return IN.only_in(_kev(spark, d), _nvd(spark, d))
