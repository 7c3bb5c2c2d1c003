"""Public vulnerability and attack-technique catalogues, flattened to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lacuna.functions import scalar as S
from lacuna.params import CVE_PATTERN, TECHNIQUE_PATTERN
from lacuna.sources.json_arrays import json_records

_CVSS = "array<struct<cvssData:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>>>"
NVD_ITEM = ("struct<id:string,descriptions:array<struct<lang:string,value:string>>,published:string,lastModified:string,"
            f"metrics:struct<cvssMetricV31:{_CVSS},cvssMetricV30:{_CVSS},cvssMetricV2:{_CVSS}>,"
            "weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,"
            "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,"
            "references:array<struct<url:string>>>")
KEV_ITEM = ("struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,"
            "requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string>")
STIX_ITEM = ("struct<type:string,id:string,name:string,description:string,external_references:array<struct<source_name:string,external_id:string>>,"
             "x_mitre_shortname:string,x_mitre_version:string,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
             "x_mitre_is_subtechnique:boolean,x_mitre_platforms:array<string>,aliases:array<string>,revoked:boolean,x_mitre_deprecated:boolean,"
             "source_ref:string,target_ref:string,relationship_type:string>")


def _items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(pos, item) for the objects in the array of a feed document, found in parallel; ``pos`` rises in the order of the file."""
    records = json_records(spark, path, level=2)
    return records.select(F.col("place").alias("pos"), F.from_json("record", item).alias("item"))


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cve) of an NVD 2.0 feed file."""
    return _items(spark, path, f"struct<cve:{NVD_ITEM}>").select("pos", F.col("item.cve").alias("cve"))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """(pos, item) of a KEV catalogue file."""
    return _items(spark, path, KEV_ITEM)


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """(pos, item) of a STIX 2.1 bundle file."""
    return _items(spark, path, STIX_ITEM)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _verdict(cve_id: Column) -> Column:
    return F.when(cve_id == "", "MISSING_ID").when(~cve_id.rlike(CVE_PATTERN), "MALFORMED_ID").otherwise("VALID")


def _first_per_id(rows: DataFrame) -> DataFrame:
    """Well-formed records, the first of each id."""
    order = Window.partitionBy("cve_id").orderBy("pos")
    return rows.where("verdict = 'VALID'").withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy", "verdict")


def parse_nvd(items: DataFrame) -> DataFrame:
    """One row per CVE. CVSS 3.1 is preferred to 3.0; version 2 stays separate."""
    c = F.col
    rows = items.withColumn("cve_id", _text(c("cve.id"))).withColumn("verdict", _verdict(c("cve_id")))
    english = F.filter("cve.descriptions", lambda x: x["lang"] == "en")
    at = lambda arr: F.try_element_at(arr, F.lit(1))
    v31, v30, v2 = (at(c(f"cve.metrics.cvssMetric{v}"))["cvssData"] for v in ("V31", "V30", "V2"))
    has31, has30 = v31.isNotNull(), v30.isNotNull()
    pick = lambda field, missing: F.when(has31, F.coalesce(v31[field], F.lit(missing))).when(has30, F.coalesce(v30[field], F.lit(missing)))
    cwes = F.filter(F.flatten(F.transform("cve.weaknesses", lambda w: F.transform(w["description"], lambda x: x["value"]))),
                    lambda v: v.isNotNull() & (v != "") & (v != "NVD-CWE-noinfo"))
    criteria = F.flatten(F.transform("cve.configurations", lambda g: F.flatten(F.transform(g["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    empty = F.array().cast("array<string>")
    return _first_per_id(rows).select(
        "cve_id", F.coalesce(F.when(at(english)["value"] != "", at(english)["value"]), at(c("cve.descriptions"))["value"], F.lit("")).alias("description"),
        F.coalesce(c("cve.published"), F.lit("")).alias("published_date"), F.coalesce(c("cve.lastModified"), F.lit("")).alias("last_modified_date"),
        pick("baseScore", 0.0).alias("cvss_v3_base_score"), pick("baseSeverity", "UNKNOWN").alias("cvss_v3_severity"),
        pick("vectorString", "").alias("cvss_v3_vector"), F.when(v2.isNotNull(), F.coalesce(v2["baseScore"], F.lit(0.0))).alias("cvss_v2_base_score"),
        F.coalesce(cwes, empty).alias("cwe_ids"), F.coalesce(F.filter(criteria, lambda x: x != ""), empty).alias("cpe_match_criteria"),
        F.coalesce(F.filter(F.transform("cve.references", lambda x: x["url"]), lambda u: u != ""), empty).alias("references"))


def parse_kev(items: DataFrame) -> DataFrame:
    """One row per exploited CVE with defaults filled in."""
    t = lambda name: _text(F.col(f"item.{name}"))
    rows = items.withColumn("cve_id", t("cveID")).withColumn("verdict", _verdict(F.col("cve_id")))
    return _first_per_id(rows).select(
        "cve_id", S.text_or_default(t("vendorProject"), "Unknown").alias("vendor_project"), S.text_or_default(t("product"), "Unknown").alias("product"),
        F.when(t("vulnerabilityName") == "", F.concat(F.lit("Vulnerability "), F.col("cve_id"))).otherwise(t("vulnerabilityName")).alias("vulnerability_name"),
        t("dateAdded").alias("date_added"), t("shortDescription").alias("short_description"),
        S.text_or_default(t("requiredAction"), "Apply vendor updates.").alias("required_action"),
        F.trim(F.coalesce("item.knownRansomwareCampaignUse", F.lit("Unknown"))).alias("known_ransomware_campaign_use"), t("notes").alias("notes"),
        F.col("item.dueDate").alias("due_date"))


def vulnerability_quality(ids: DataFrame, source: str) -> DataFrame:
    """Parse counters from (cve_id, lacks_fields) of every record, in two aggregation steps."""
    rows = ids.withColumn("verdict", _verdict(F.col("cve_id")))
    per = rows.groupBy("cve_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(-F.col("pos"), "lacks_fields"))["lacks_fields"].alias("lacks"))
    valid, missing, bad = (F.col("verdict") == v for v in ("VALID", "MISSING_ID", "MALFORMED_ID"))
    num = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(num(F.col("n")).alias("total_records"), num(F.when(valid, 1)).alias("valid_records"), num(F.when(~valid, F.col("n"))).alias("rejected_records"),
                   num(F.when(valid, F.col("n") - 1)).alias("duplicate_records"), num(F.when(bad, F.col("n"))).alias("malformed_ids"),
                   num(F.when(missing, F.col("n")).when(valid & F.col("lacks"), 1)).alias("missing_required_fields")).select(F.lit(source).alias("source_name"), "*")


def nvd_quality(items: DataFrame) -> DataFrame:
    return vulnerability_quality(items.select("pos", _text(F.col("cve.id")).alias("cve_id"), F.lit(False).alias("lacks_fields")), "NVD")


def kev_quality(items: DataFrame) -> DataFrame:
    lacks = (_text(F.col("item.vendorProject")) == "") | (_text(F.col("item.product")) == "")
    return vulnerability_quality(items.select("pos", _text(F.col("item.cveID")).alias("cve_id"), lacks.alias("lacks_fields")), "KEV")


# --- fixed values: STIX object types and the table each one becomes ----------------------
STIX_KINDS = {"x-mitre-tactic": "tactic", "attack-pattern": "technique", "intrusion-set": "group", "malware": "software", "tool": "software",
              "course-of-action": "mitigation", "relationship": "relationship"}


def classify_stix(items: DataFrame) -> DataFrame:
    """Each object with its kind and a verdict: valid, missing fields, withdrawn or of no interest."""
    i = lambda n: F.col(f"item.{n}")
    kinds = F.create_map(*[x for k, v in STIX_KINDS.items() for x in (F.lit(k), F.lit(v))])
    withdrawn = F.coalesce(i("revoked"), F.lit(False)) | F.coalesce(i("x_mitre_deprecated"), F.lit(False))
    linked = (_text(i("source_ref")) != "") & (_text(i("target_ref")) != "") & (_text(i("relationship_type")) != "")
    rows = items.withColumn("kind", F.try_element_at(kinds, i("type"))).withColumn(
        "external_id", F.try_element_at(i("external_references"), F.lit(1))["external_id"])
    complete = F.when(F.col("kind") == "relationship", linked).otherwise(F.coalesce(i("name"), F.lit("")) != "")
    malformed = (F.col("kind") == "technique") & ~F.coalesce(F.col("external_id").rlike(TECHNIQUE_PATTERN), F.lit(False))
    verdict = F.when(withdrawn, "WITHDRAWN").when(F.col("kind").isNull(), "OTHER_TYPE").when(complete, "VALID").otherwise("MISSING_FIELDS")
    return rows.withColumn("verdict", verdict).withColumn("malformed_id", malformed & ~withdrawn)


def stix_table(items: DataFrame, kind: str) -> DataFrame:
    """Objects of one kind; the last object of an id wins, as in a keyed catalogue."""
    i = lambda n: F.col(f"item.{n}")
    rows = classify_stix(items).where((F.col("verdict") == "VALID") & (F.col("kind") == kind))
    if kind == "relationship":
        return rows.select(i("id").alias("id"), i("source_ref").alias("source_ref"), i("target_ref").alias("target_ref"), i("relationship_type").alias("relationship_type"))
    own = S.text_or_default(F.col("external_id"), None)
    short = F.coalesce(i("x_mitre_shortname"), F.replace(F.lower(i("name")), F.lit(" "), F.lit("-")))
    phases = F.transform(F.filter(F.coalesce(i("kill_chain_phases"), F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")),
                                  lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    key = short if kind == "tactic" else F.coalesce(own, i("id"))
    kept = rows.withColumn("key", key).withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pos")))).where("copy = 1")
    return kept.select(F.coalesce(own, i("id")).alias("id"), i("id").alias("stix_id"), i("name").alias("name"), i("type").alias("object_type"),
                       F.when(F.lit(kind == "tactic"), short).alias("shortname"), F.when(F.lit(kind == "technique"), phases).alias("tactics"),
                       F.coalesce(i("x_mitre_is_subtechnique"), F.lit(False)).alias("is_subtechnique"), F.coalesce(i("x_mitre_version"), F.lit("1.0")).alias("version"))


def stix_quality(items: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return classify_stix(items).agg(
        F.count(F.lit(1)).alias("total_records"), S.count_where(v == "VALID").alias("valid_records"), S.count_where(v.isin("WITHDRAWN", "OTHER_TYPE")).alias("rejected_records"),
        S.count_where(F.col("malformed_id")).alias("malformed_ids"), S.count_where(v == "MISSING_FIELDS").alias("missing_required_fields"),
        S.count_where(v == "WITHDRAWN").alias("deprecated_or_revoked"))


def catalogue_counts(items: DataFrame) -> DataFrame:
    """Distinct catalogue entries per kind; relationships are counted as they come."""
    rows = classify_stix(items).where("verdict = 'VALID'")
    i = lambda n: F.col(f"item.{n}")
    short = F.coalesce(i("x_mitre_shortname"), F.replace(F.lower(i("name")), F.lit(" "), F.lit("-")))
    key = F.when(F.col("kind") == "relationship", F.col("pos").cast("string")).when(F.col("kind") == "tactic", short) \
        .otherwise(F.coalesce(S.text_or_default(F.col("external_id"), None), i("id")))
    return rows.where("kind <> 'mitigation'").groupBy("kind").agg(F.countDistinct(key).alias("n"))
