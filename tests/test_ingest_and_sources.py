import json
import uuid

import pytest
from pyspark.sql import functions as F

from lacuna.operators import ingest as I
from lacuna.operators import quality as QL
from lacuna.functions import scalar as S
from lacuna.sources import catalogs as C
from lacuna.sources import files as FS
from lacuna.sources import manifests as MF
from lacuna.sources import sinks as SK
from lacuna.sources import soc_logs as SL
from lacuna.streaming import ingest_stream as IS
from lacuna.operators import intel as IN

AS_OF = "2024-01-31 00:00:00"
A, B, X = (str(uuid.UUID(int=i)) for i in (1, 2, 3))


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def run(spark, path):
    entity, raw = FS.read_export(spark, path)
    return entity, raw, I.ingest(raw, entity, ["src_file", "src_pos"], "IMP", AS_OF)


def test_malformed_alerts_are_quarantined(spark, tmp_path):
    path = write(tmp_path / "alerts.csv", "id,cse_id,asset_id,source_system,category,severity,created_at\n"
                 f"{A},{X},{X},SIEM,MALWARE,P1,2024-01-01T00:00:00Z\n{B},,,SIEM,MALWARE,P2,2024-01-01\n{A},{X},{X},SIEM,AGAIN,P3,2024-01-01\n")
    entity, _, out = run(spark, path)
    assert entity == "alerts"
    good, bad, c = out.valid.collect(), out.quarantined.collect(), out.counters.first()
    assert len(good) == 1 and good[0]["severity"] == "CRITICAL" and good[0]["category"] == "MALWARE" and good[0]["raw_severity"] == "P1"
    assert bad[0]["description"].startswith("Missing required Alert fields") and bad[0]["record_ref"] == B
    assert (c["total"], c["accepted"], c["quarantined"], c["duplicates"], c["unmapped_cses"]) == (3, 1, 1, 1, 1)
    assert I.import_record(out.counters, "alerts.csv", entity, "IMP").first()["status"] == "QUARANTINED"
    assert I.only_new(out.valid, out.valid, "alerts").count() == 0


@pytest.mark.parametrize("as_lines", [False, True])
def test_json_array_and_lines(spark, tmp_path, as_lines):
    rows = [{"id": A, "name": "One", "sector": "ENERGY", "entity_type": "GRID", "size_tier": "TIER_2"}, {"id": B, "name": "Two", "sector": "BANKING"}]
    text = "\n".join(map(json.dumps, rows)) if as_lines else json.dumps(rows, indent=1)
    entity, _, out = run(spark, write(tmp_path / ("cses.jsonl" if as_lines else "test_cses.json"), text))
    got = {r["name"]: r for r in out.valid.collect()}
    assert entity == "cses" and got["One"]["size_tier"] == "TIER_2" and got["Two"]["entity_type"] == "OPERATOR"


def test_entity_detection_and_formats(spark, tmp_path):
    assert FS.entity_of_name("/x/ALERTS_2024.csv") == "alerts" and FS.entity_of_name("maintenance_logs.csv") is None
    assert FS.entity_of_header(["Started_At", "x"]) == "investigations" and FS.entity_of_header(["x"]) == "unknown"
    path = write(tmp_path / "maintenance_logs.csv", f"id,cse_id\n{A},{X}\n")
    entity, _, out = run(spark, path)
    assert entity == "unknown" and out.quarantined.count() == 1 and out.valid.count() == 0
    with pytest.raises(ValueError):
        FS.read_export(spark, str(tmp_path / "alerts.xml"))


def test_directory_order_and_export_round_trip(spark, tmp_path):
    write(tmp_path / "alerts.csv", "id,cse_id\n1,2\n")
    write(tmp_path / "cses.csv", "id,name\n1,n\n")
    write(tmp_path / "ground_truth.json", "{}")
    assert list(FS.read_directory(spark, str(tmp_path))) == ["cses", "alerts"]
    df = spark.createDataFrame([("1", None, "a,b")], "id string, blank string, text string")
    SK.export_csv({"t": df}, str(tmp_path / "out"))
    back = FS.read_csv(spark, str(tmp_path / "out" / "t")).first()
    assert back["blank"] == "" and back["text"] == "a,b"


def test_normalisers(spark):
    one = lambda fn, values: [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(fn(F.col("v"))).collect()]
    assert one(S.severity, [" p1 ", "5", "sev-5", "SEV5", "", None]) == ["CRITICAL", "CRITICAL", "INFO", "MEDIUM", "MEDIUM", "MEDIUM"]
    assert one(S.criticality, ["tier_1", "LOW", "?"]) == ["CRITICAL", "LOW", "MEDIUM"]
    assert one(S.disposition, ["FALSE_POSITIVE", "false", "benign", "dup", ""]) == ["TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN_POSITIVE", "DUPLICATE", "INCONCLUSIVE"]
    assert one(lambda c: S.disposition(c, fixed=True), ["FALSE_POSITIVE"]) == ["FALSE_POSITIVE"]
    assert one(S.digits_to_int, ["12", "0", "1.5", None]) == [12, None, None, None]
    assert one(lambda c: S.iso(S.timestamp(c)), ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05+02:00", "01/02/2024", "junk", ""]) == [
        "2024-01-02T03:04:05", "2024-01-02T01:04:05", "2024-01-02T00:00:00", None, None]


def test_profile_and_score(spark, tmp_path):
    path = write(tmp_path / "p.csv", "cse_id,asset_id,created_at,severity,category\nc,a,2024-01-01,CRITICAL,x\nc,b,2024-01-02,HIGH,x\nc,d,2024-01-03,LOW,y\nc,d,2024-01-03,LOW,y\n")
    rows = FS.read_csv(spark, path)
    cols = ["cse_id", "asset_id", "created_at", "severity", "category"]
    table, dist = QL.table_profile(rows, cols, "created_at"), QL.distributions(rows)
    t = table.first()
    assert (t["total_records"], t["duplicate_records"], t["timestamp_min"]) == (4, 1, "2024-01-01")
    assert dist.where("kind = 'severity' AND value = 'CRITICAL'").first()["n"] == 1
    score = QL.quality_score(QL.column_profile(rows, cols), table, dist, cols).first()
    assert score["overall_score"] >= 80 and score["grade"] in ("A", "B") and score["advise_deduplication"]


def test_soc_log(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "x", "1", "10.0.0.1", "10.0.0.2", "d"), ("bad", "x", "2", "10.0.0.3", "", "")],
                                 "timestamp string, category string, severity string, src_ip string, dest_ip string, description string")
    assert SL.has_required_header([" Timestamp", "category", "SEVERITY"]) and not SL.has_required_header(["timestamp"])
    got = SL.normalise(rows, AS_OF).orderBy("severity").collect()
    assert [r["severity"] for r in got] == ["CRITICAL", "HIGH"] and got[0]["asset_id"] == "10.0.0.1" and got[0]["details"]["signature"] == "d"


def test_catalogues_from_documents(spark, tmp_path):
    cve = {"id": "CVE-2021-44228", "descriptions": [{"lang": "en", "value": "Apache Log4j2"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 10.0, "baseSeverity": "CRITICAL"}}]},
           "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:apache:log4j:2.14.1:*:*:*:*:*:*:*"}]}]}]}
    nvd = C.parse_nvd(C.read_nvd(spark, write(tmp_path / "n.json", json.dumps({"vulnerabilities": [{"cve": cve}, {"cve": cve}, {"cve": {"id": "nope"}}]}, indent=1))))
    kev_items = C.read_kev(spark, write(tmp_path / "k.json", json.dumps({"vulnerabilities": [{"cveID": "CVE-2021-44228", "vendorProject": "Apache", "product": "Log4j2", "knownRansomwareCampaignUse": "Known"}]})))
    kev = C.parse_kev(kev_items)
    got = IN.match_software(IN.asset_profiles(spark), IN.cpe_entries(nvd)).where("asset_type = 'WEB_SERVER'").first()
    assert got["match_status"] == "EXACT_MATCH" and got["primary_cve"] == "CVE-2021-44228"
    web = IN.enrich_types(spark, nvd, kev).where("asset_type = 'WEB_SERVER'").first()
    assert web["cvss_base_score"] == 10.0 and web["is_kev"] and web["threat_score_modifier"] == 30.0
    assert IN.overlap_summary(IN.overlap(nvd, kev)).first()["consistent_overlap_count"] == 1
    bundle = {"objects": [{"type": "attack-pattern", "id": "a1", "name": "Impair", "external_references": [{"external_id": "T1562"}],
                           "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "defense-evasion"}]}, {"type": "attack-pattern", "id": "a2", "name": "Old", "revoked": True}]}
    items = C.read_stix(spark, write(tmp_path / "s.json", json.dumps(bundle)))
    assert [(r["id"], r["tactics"]) for r in C.stix_table(items, "technique").collect()] == [("T1562", ["defense-evasion"])]
    assert C.stix_quality(items).first()["deprecated_or_revoked"] == 1
    long = spark.createDataFrame([("cpe:2.3:a:Apache:log4j",), ("cpe:2.3:a:x",), ("x",)], "c string").select(IN.cpe_parts(F.col("c")).alias("p")).collect()
    assert long[0]["p"]["vendor"] == "apache" and long[0]["p"]["other"] == "*" and long[1]["p"] is None and long[2]["p"] is None


def test_manifest_detects_tampering(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    path = write(folder / "f.txt", "hello")
    stored = spark.createDataFrame(MF.file_checksums(spark, path).collect())
    assert MF.verify(stored, MF.file_checksums(spark, path)).first()["status"] == "AUTHENTIC"
    write(folder / "g.txt", "x")
    (folder / "f.txt").write_text("changed")
    assert MF.verify(stored, MF.file_checksums(spark, str(folder))).first()["status"] == "TAMPERED"
    SK.save_manifest(stored, str(tmp_path / "saved"))
    assert SK.load_manifest(spark, str(tmp_path / "saved"), "file_name string, file_size_bytes long").first()["file_size_bytes"] == 5


def test_replace_run_replaces_exactly_its_scope(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda n: spark.createDataFrame([("x", i) for i in range(n)], "rule_id string, v int")
    gap, neg = {"analysis_run_id": "a", "engine": "gap"}, {"analysis_run_id": "a", "engine": "negative_space"}
    for n, scope in ((3, gap), (4, neg), (2, {"analysis_run_id": "b", "engine": "gap"}), (1, gap), (1, gap)):
        SK.replace_run(rows(n), path, scope)
    counts = lambda: {(r[0], r[1]): r[2] for r in SK.read_runs(spark, path).groupBy("analysis_run_id", "engine").count().collect()}
    assert counts() == {("a", "gap"): 1, ("a", "negative_space"): 4, ("b", "gap"): 2}
    SK.replace_run(rows(0), path, gap)
    assert counts() == {("a", "negative_space"): 4, ("b", "gap"): 2}
    assert SK.stale_generations(spark, path).count() == 3


def test_directory_of_files_and_part_folders(spark, tmp_path):
    folder = tmp_path / "exports"
    (folder / "alerts.csv").mkdir(parents=True)
    for n in range(2):
        (folder / "alerts.csv" / f"part-{n}.csv").write_text(f"id,cse_id\n{n},x\n")
    (folder / "cses.json").write_text('\n  [{"id": "1", "name": "n"}]')
    (folder / "ground_truth.json").write_text("{}")
    out = FS.read_directory(spark, str(folder))
    assert list(out) == ["cses", "alerts"] and out["alerts"].count() == 2 and out["cses"].first()["name"] == "n"


def test_stream_repeats_are_dropped_across_files(spark, tmp_path):
    src = tmp_path / "in"
    ddl = "id string, seen_at timestamp"
    for part in (["1", "2"], ["2", "3"]):
        spark.createDataFrame([(i,) for i in part], "id string").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
    stream = IS.drop_repeats(IS.file_stream(spark, str(src), ddl, files_per_batch=1), "alerts", "seen_at", "1 day")
    IS.run_available(stream, IS.batch_table_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_second_import_reads_its_batch_as_stored(spark, tmp_path):
    from datetime import datetime

    from lacuna.plans import q_ingest
    from lacuna.schemas import SOURCE_DDL

    day = datetime(2024, 1, 2)
    orders = [(k, k, "O", 1.0, day, f"{1 + k % 2}-X") for k in range(1, 9)]
    lines = [(k, 1, 1, n, 3.0, 9.0, 0.01, 0.02, "N", "O", day) for k in range(1, 9) for n in (1, 2)]
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, SOURCE_DDL[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    out = q_ingest.ingest_only_new_alerts(spark, str(tmp_path))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    uid = spark.createDataFrame([(k,) for k in (1, 3, 5, 7)], "k long").select(q_ingest.uid("ALT", F.col("k")).alias("id"))
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in uid.collect())
