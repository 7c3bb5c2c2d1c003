"""The pipeline on planted cases: each stage's decisions take effect and clean documents stay."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lacuna.llm import bpe
from lacuna.llm.common import arrow_rows
from lacuna.llm.queries import ORACLES, QUERIES
from tests.llm.test_text_ops import SCHEMA


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "an", "ed", "ti", "on", "ra", "lo"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for k in range(400):
        body = text(rng.choice([40, 80, 200]))
        if toxic := k % 4 == 0:
            words = body.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "vequti"]))
            body = " ".join(words)
        docs.append((k, body))
        labels.append((k, int(toxic)))
    line = "this is a passage that many documents hold word for word and line for line"
    for k in range(1000, 1010):
        docs.append((k, f"{text(60)}\n{line}\n{text(10)}"))
    seed = text(300).split()
    for k in range(2000, 2006):
        other = list(seed)
        other[rng.randrange(300)] = word()
        docs.append((k, " ".join(other)))
    docs += [(3000, None), (3001, ""), (3002, docs[1][1])]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t), 1, "x") for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_planted_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "byte_bpe"]
    for name, apply in corpus_pipeline.STAGES:
        before = docs
        apply(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "byte_bpe" or docs.columns == columns
        kept[name] = docs.collect()
        if name == "mixing":
            mixed_from = {r["doc_id"]: r["text"] for r in before.collect()}
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    clean = {k for k in range(400) if k % 4} | set(range(1000, 1010)) | set(range(2000, 2006)) | {3000, 3001, 3002}
    assert len(ids("toxicity") & {k for k in range(400) if k % 4 == 0}) <= 2 and len(clean - ids("toxicity")) <= 2
    assert ids("line_dedup") == ids("toxicity")
    holders = [r["doc_id"] for r in kept["line_dedup"] if "this is a passage that many documents hold" in (r["text"] or "")]
    assert holders == [1009] and all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    assert ids("ngram_join") == ids("line_dedup") - set(range(2001, 2006)) - {3002}
    assert all(r["text"] == mixed_from[r["doc_id"]] for r in kept["mixing"])
    codec = bpe.Codec(bpe.tables())
    assert sorted((r["doc_id"], codec.decode(r["ids"]).decode()) for r in kept["byte_bpe"]) == sorted((r["doc_id"], r["text"] or "") for r in kept["mixing"])
    assert all(r["n_tokens"] == len(r["ids"]) for r in kept["byte_bpe"])
    assert sorted(r["decoded_sha256"] for r in kept["byte_bpe"]) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept["mixing"])


def test_encoding_holds_one_worker_a_core_and_decoding_no_codec(spark):
    rows = [(1, "some words", "a"), (2, None, "b"), (3, "\u00e9\u4e2d \U0001f600" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.encoded(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t, _ in rows}
    assert bpe._as_it_is([b"x"]) == [b"x"] and not bpe._CODECS


def test_encoding_remembers_packed_ids_and_reads_small_batches(spark):
    codec = bpe.Codec(bpe.tables())
    for text in ("some words, some words", "\u00e9\u4e2d \U0001f600 xyzzyqwv", "", None):
        assert codec.encode(text) == np.frombuffer(codec.packed(text), np.int32).tolist()
    assert codec.whole and all(type(v) is bytes and len(v) % 4 == 0 for v in codec.whole.values())

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(name), spark.range(0, 1000, 1, 1)
    with arrow_rows(spark, 100):
        sizes = rows.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
    assert sum(r["n"] for r in sizes) == 1000 and max(r["n"] for r in sizes) <= 100 and spark.conf.get(name) == before


def test_a_worker_keeps_no_codec_after_its_task(spark):
    docs = spark.createDataFrame([(k, "some words", "a") for k in range(8)], "doc_id long, text string, source string").repartition(4)
    assert bpe.encode_documents(docs).count() == 8

    def left(it):
        list(it)
        yield pa.RecordBatch.from_pydict({"n": [len(bpe._CODECS)]})

    bpe.encode_documents(docs).collect()
    assert {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n long").collect()} == {0}


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
