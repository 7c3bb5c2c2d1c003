import uuid

from pyspark.sql import functions as F

from lacuna.operators import ingest as I
from lacuna.plans import import_job as J
from lacuna.sources import key_index as KI

DDL = "id string, case_id string"
KINDS = [["id"], ["case_id"]]


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("c"), "id").alias("case_id"))


def touched(index, spark, part, buckets):
    """Bytes of the files that a read of some buckets opens."""
    files = index.read(spark, part, buckets).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]


def test_same_rows_as_anti_joins(spark, tmp_path):
    stored = spark.createDataFrame([("a", "x"), ("b", None), (None, "y"), ("", "z"), ("a", "x")], DDL)
    batch = spark.createDataFrame([("a", "q"), ("q", "x"), ("x", "a"), (None, None), (None, "y"), ("b", None), ("n", None), ("", "n2"), ("n3", ""), ("a", "x"), ("x", "a")], DDL)
    for capacity in (1, 1000):
        index = KI.built(stored, KINDS, str(tmp_path / f"k{capacity}"), capacity)
        got = sorted(str((r["id"], r["case_id"])) for r in index.only_new(batch, KINDS).collect())
        assert got == sorted(str((r["id"], r["case_id"])) for r in I.only_new(batch, stored, "closures").collect()) and len(got) == 5
        assert index.only_new(batch.limit(0), KINDS).count() == 0
    nothing = KI.built(stored.limit(0), KINDS, str(tmp_path / "none"))
    assert nothing.only_new(batch, KINDS).count() == 11 and nothing.n_keys == 0


def test_growth_splits_buckets_and_keeps_every_key(spark, tmp_path):
    path = str(tmp_path / "k")
    index = KI.built(rows(spark, 100), KINDS, path, capacity=512)
    first = index.generation
    for start in (100, 300, 900):
        index.opened_for_writing(spark)
        assert KI.opened(spark, path) is None
        index = index.extended(KI.digests(rows(spark, 2 * start, start), KINDS))
        assert KI.opened(spark, path) == index
    assert index.generation != first and index.n_keys == 5400 and index.buckets * 512 >= 5400
    assert index.only_new(rows(spark, 2800), KINDS).select("id").toPandas()["id"].str[1:].astype(int).min() == 2700


def test_what_a_batch_reads_does_not_grow_with_the_table(spark, tmp_path):
    read, passed = [], []
    for n in (4_000, 40_000):
        index = KI.built(rows(spark, n), KINDS, str(tmp_path / f"t{n}"), capacity=500)
        probes = KI._placed(KI.digests(rows(spark, 6, 10**6), KINDS), index.buckets, index.capacity)
        may = index.suspects(probes)
        buckets = KI._numbers(probes)
        read.append(touched(index, spark, "filters", buckets) + touched(index, spark, "keys", KI._numbers(may)))
        whole = touched(index, spark, "keys", list(range(index.buckets)))
        passed.append(read[-1] / whole)
        strangers = KI._placed(KI.digests(rows(spark, 2000, 10**6), KINDS), index.buckets, index.capacity)
        assert index.suspects(strangers).count() < 0.1 * 4000
    assert read[1] < 1.5 * read[0] and passed[1] < 0.15


def test_a_dead_import_is_repaired_from_the_table(spark, tmp_path):
    store = str(tmp_path / "store")
    ids = [str(uuid.UUID(int=i)) for i in range(1, 6)]
    ddl = "id string, case_id string, disposition_type string"
    J.store_batch(spark.createDataFrame([(ids[0], ids[1], "x")], ddl), "closures", ["id"], store, "a", "2024-01-31")
    index = KI.opened(spark, f"{store}/known_keys/closures")
    assert index.n_keys == 2
    index.opened_for_writing(spark)  # the import then wrote its rows and died
    spark.read.parquet(f"{store}/closures").withColumn("id", F.lit(ids[2])).withColumn("case_id", F.lit(ids[3])).write.mode("append").parquet(f"{store}/closures")
    J.store_batch(spark.createDataFrame([(ids[2], ids[4], "x"), (ids[4], ids[3], "x"), (ids[4], ids[4], "x")], ddl), "closures", ["id", "case_id"], store, "b", "2024-01-31")
    stored = spark.read.parquet(f"{store}/closures")
    assert sorted(r["id"] for r in stored.collect())[:2] == sorted([ids[0], ids[2]])
    assert KI.opened(spark, f"{store}/known_keys/closures").n_keys == 2 * stored.count()
