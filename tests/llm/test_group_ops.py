"""Joins, orders and shards against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import chosen_path, grid_join, ordering, shuffle
from lacuna.llm.common import WordCodes, components, local_roots
from tests.llm.test_text_ops import SCHEMA, empty, odd_documents


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(5000, k) for k in range(5001, 5300)] + [(k, k + 1) for k in range(7000, 7400)] + [(4, 4)]
    want = brute_components({n for p in links for n in p}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert all(want[n] == r for n, r in got.items()) and {n for n, r in want.items() if n != r} <= set(got)
    nodes, roots = local_roots(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "an", "ed", "ti", "on"]) for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts, base = [None, "", " \n", "one", "one", "one two", "one two three"], []
    for k in range(60):
        base.append([word() for _ in range(rng.randint(20, 200))] + (passage if k % 4 == 0 else []))
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    seed = [word() for _ in range(150)]
    for _ in range(80):  # one large group of near copies
        other = list(seed)
        other[rng.randrange(150)] = word()
        texts.append(" ".join(other))
    texts += [texts[20]] * 30
    return [(k + 10, t) for k, t in enumerate(texts)] + [(12, texts[2]), (30, texts[20]), (None, texts[21])]


@pytest.mark.parametrize("leaf,block,depth", [(256, 512, 3), (6, 16, 3)])
def test_chosen_path_against_all_pairs(spark, leaf, block, depth):
    rows = near_documents()
    codes = WordCodes()
    sets = [set(chosen_path.shingles(t, codes).tolist()) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    degree = Counter(k for p in linked for k in p)
    root = brute_components(range(len(rows)), linked)
    members = {}
    for k, r in root.items():
        members.setdefault(r, []).append(rows[k][0])
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    want = Counter((rows[k][0], degree[k], least[root[k]]) for k in range(len(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_links"], r["component_id"]) for r in chosen_path.near_groups(docs, leaf=leaf, block=block, depth=depth).collect())
    assert got == want and len(linked) > 2000


def test_one_document_of_each_group_stays(spark):
    rows = near_documents()
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 2, "x") for i, t in rows], SCHEMA)
    kept = chosen_path.one_of_each(docs)
    assert kept.columns == docs.columns
    codes = WordCodes()
    sets = [set(chosen_path.shingles(r["text"], codes).tolist()) for r in kept.collect()]
    full = [s for s in sets if s]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(full) for b in full[:k])
    groups = {r["component_id"] for r in chosen_path.near_groups(docs).collect() if not r["alone"]}
    assert len(full) == len(groups) and len(sets) - len(full) == sum(not chosen_path.shingles(t, codes).size for _, t in rows)
    assert chosen_path.one_of_each(empty(spark)).count() == 0 and chosen_path.near_groups(empty(spark)).count() == 0


def test_runs_reach_the_recall():
    assert chosen_path.runs_needed(0.5) < chosen_path.runs_needed(0.99) < chosen_path.runs_needed(0.9999)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    other = np.unique(np.concatenate([a[:800], rng.integers(0, 2 ** 63, 100).astype(np.uint64)]))
    a = np.unique(a)
    x, y = (np.frombuffer(chosen_path.sketch(s), np.uint16) for s in (a, other))
    assert abs((x == y).mean() - 0.8) < 0.2


def vector_rows():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    rows = [(centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.35, 0.8])).astype(np.float32).tolist() for _ in range(700)]
    rows += [rows[3]] * 40 + [[2 * x for x in rows[3]], [-x for x in rows[3]], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [1.0, 2.01], [1.0] * 23]
    return [(k * 3 + 5, v, k % 4) for k, v in enumerate(rows)] + [(None, rows[5], 1)]


@pytest.mark.parametrize("interval", [4096, 50])
def test_grid_order_join_against_all_pairs(spark, interval):
    rows = vector_rows()
    units = [None if v is None or any(x is None for x in v) else grid_join.unit(np.array(v, np.float32)) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    degree = Counter(k for p in links for k in p)
    root = brute_components(range(len(rows)), links)
    members = {}
    for k, r in root.items():
        members.setdefault(r, []).append(rows[k][0])
    want = Counter()
    for k, (i, _, _) in enumerate(rows):
        least = min((x for x in members[root[k]] if x is not None), default=None)
        want[i, degree[k], least, least == i] += 1
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in grid_join.near_vectors(vectors, interval=interval).collect())
    assert got == want and len(links) > 1000
    assert grid_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_far_blocks_are_skipped():
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(8), 200, axis=0) + rng.normal(size=(1600, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    j = grid_join.Joiner(x, x, x, np.arange(1600), np.ones(1600, np.int64), 0.9)
    old, grid_join.LEAF = grid_join.LEAF, 64
    try:
        j.join((0, 1600), (0, 1600))
    finally:
        grid_join.LEAF = old
    assert (j.links == 199).all() and j.compared < 1600 * 1600 / 4


def test_feistel_is_a_permutation():
    for domain in (1, 2, 3, 17, 1000, 4097):
        out = ordering.feistel(np.arange(domain), domain)
        assert sorted(out.tolist()) == list(range(domain))
    assert (ordering.feistel(np.arange(1000), 1000) != ordering.feistel(np.arange(1000), 1000, (1, 2, 3, 4))).any()


def test_training_order_against_plain_loops(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    length = 64
    shards = ordering.materialise(ordering.byte_tokens(docs), length, shard_bytes=4_000)
    got = ordering.read_sequences(shards).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for part in range(max(1, -(-len(data) // length))):
            want[doc_id, part, data[part * length:(part + 1) * length]] += 1
    assert Counter((r["doc_id"], r["part"], bytes(r["ids"])) for r in got) == want
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and all(r["intact"] for r in got)
    ids = [r[0] for r in rows if r[0] is not None]
    parts = max(-(-len((t or "").encode()) // length) for _, t, *_ in rows)
    domain = (max(ids) - min(ids) + 2) * parts
    number = np.array([((min(ids) - 1 if r["doc_id"] is None else r["doc_id"]) - min(ids) + 1) * parts + r["part"] for r in sorted(got, key=lambda r: r["slot"])])
    assert (np.diff(ordering.feistel(number, domain)) >= 0).all()
    assert {len(r["payload"]) == r["n_records"] * r["stride"] for r in shards.collect()} == {True} and shards.select("shard").distinct().count() > 3
    assert sorted((r["slot"], r["doc_id"] or -1) for r in got) == sorted((r["slot"], r["doc_id"] or -1) for r in ordering.read_sequences(ordering.materialise(ordering.byte_tokens(docs), length, shard_bytes=4_000)).collect())
    assert ordering.read_sequences(ordering.materialise(ordering.byte_tokens(empty(spark)))).count() == 0


def test_external_shuffle(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = shuffle.shuffled_shards(docs.repartition(3), bucket_bytes=4000)
    got = out.collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(rows)
    by = {}
    for r in got:
        by.setdefault(r["__shard"], []).append(r["__slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shuffle.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    again = shuffle.shuffled_shards(docs.repartition(5), bucket_bytes=4000).collect()
    key = lambda r: (r["__shard"], r["__slot"], str(r["doc_id"]), r["text"] or "")
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert shuffle.shuffled_shards(empty(spark)).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(shuffle.fisher_yates(4, 9, b)) for b in range(6000))
    assert len(seen) == 24 and max(seen.values()) < 340 and min(seen.values()) > 170
    assert shuffle.fisher_yates(0, 1, 1).tolist() == [] and shuffle.fisher_yates(1, 1, 1).tolist() == [0]


def test_one_of_each_when_ids_are_missing_or_repeated(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "more", "still"])]
    other = " ".join(f"v{k}" for k in range(60))
    for ids in ((7, 7, 7), (None, None, None), (None, 7, 7), (7, None, 9)):
        rows = [(i, t) for i, t in zip(ids, near, strict=True)] * 3 + [(ids[0], other)] * 3 + [(ids[1], "short"), (ids[1], None)]
        kept = [(r["doc_id"], r["text"]) for r in chosen_path.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
        groups = Counter("near" if t in near else t for _, t in kept)
        assert groups == {"near": 1, other: 1, "short": 1, None: 1}, (ids, groups)
        assert next(i for i, t in kept if t in near) == min((i for i in ids if i is not None), default=None)
