import hashlib

import pytest
from pyspark.sql import functions as F

from lacuna.operators import accumulator as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaves(spark, n, start=0):
    return spark.range(start, n).select(F.col("id").alias("at"), M.leaf_digest(F.concat(F.lit("p"), "id")).alias("digest"))


def brute(n):
    level, at, out = 0, [sha(f"leaf:p{i}") for i in range(n)], {}
    while at:
        out.update({(level, i): d for i, d in enumerate(at)})
        at, level = [sha("node:" + at[i] + at[i + 1]) for i in range(0, len(at) - 1, 2)], level + 1
    return out


def as_dict(nodes):
    rows = [((r["level"], r["at"]), r["digest"]) for r in nodes.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_nodes_roots_and_growth_against_loops(spark):
    assert M.peaks_of(0) == [] and M.peaks_of(11) == [(3, 0), (1, 4), (0, 10)]
    grown = None
    for n in (1, 300, 301, 1031):
        old = 0 if grown is None else M.size(grown)
        more = M.extended(leaves(spark, n, old), grown)
        assert as_dict(more) == {k: d for k, d in brute(n).items() if k not in brute(old)}
        grown = (more if grown is None else grown.unionByName(more)).checkpoint()
    want = brute(1031)
    held = "".join(want[p] for p in M.peaks_of(1031))
    assert M.root(grown, 1031).first()["root"] == sha(f"root:1031:{held}")
    assert M.root(grown, 300).first()["root"] == sha("root:300:" + "".join(want[p] for p in M.peaks_of(300)))
    assert M.extended(leaves(spark, 0), grown).count() == 0 and M.size(grown.limit(0)) == 0
    for bad in (leaves(spark, 1040, 1035), leaves(spark, 1032, 1030), leaves(spark, 1032, 1031).union(leaves(spark, 1032, 1031))):
        with pytest.raises(ValueError):
            M.extended(bad, grown)


def test_proofs_hold_and_forgeries_fail(spark):
    n, old = 300, 173
    nodes = M.extended(leaves(spark, n)).checkpoint()
    all_leaves, top = leaves(spark, n), M.peaks(nodes, n)
    proofs = M.inclusion(all_leaves, nodes, n).checkpoint()
    got = M.included(all_leaves, proofs, top).collect()
    assert len(got) == n and all(r["is_included"] for r in got)
    assert {r["n_steps"] for r in got if r["at"] < 256} == {8} and {r["at"]: r["n_steps"] for r in got}[299] == 2
    forged = all_leaves.withColumn("digest", F.when(F.col("at") == 7, F.lit("0" * 64)).otherwise(F.col("digest")))
    assert [r["at"] for r in M.included(forged, proofs, top).collect() if not r["is_included"]] == [7]
    assert [r["at"] for r in M.included(all_leaves, proofs.where("NOT (at = 9 AND step = 3)"), top).collect() if not r["is_included"]] == [9]
    path = M.consistency(nodes, old, n).checkpoint()
    assert M.is_consistent(old, M.peaks(nodes, old), path, n, top)
    assert not M.is_consistent(old + 1, M.peaks(nodes, old), path, n, top)
    rewritten = M.extended(forged).checkpoint()
    assert not M.is_consistent(old, M.peaks(nodes, old), M.consistency(rewritten, old, n), n, M.peaks(rewritten, n))


def test_proofs_of_a_whole_log_by_blocks(spark):
    top = M.size(nodes := M.extended(leaves(spark, 1031)).checkpoint())
    for n in (1, 2, 3, 255, 256, 259, 1024, top):
        want = {}
        for r in M.inclusion(leaves(spark, n), nodes, n).collect():
            want.setdefault(r["at"], []).append((r["step"], r["sibling"]))
        paths = M.all_paths(nodes, n)
        got = M.all_included(leaves(spark, n), paths, M.peaks(nodes, n)).collect()
        assert sorted(r["at"] for r in got) == list(range(n)) and all(r["is_included"] for r in got)
        assert {r["at"]: r["path"] for r in got} == {at: [d for _, d in sorted(want.get(at, []))] for at in range(n)}
        assert paths.count() == -(-n // 256)  # rows do not grow with the steps
    forged = leaves(spark, top).withColumn("digest", F.when(F.col("at") == 700, F.lit("0" * 64)).otherwise(F.col("digest")))
    assert [r["at"] for r in M.all_included(forged, M.all_paths(nodes, top), M.peaks(nodes, top)).collect() if not r["is_included"]] == [700]
    assert {r["at"] for r in M.all_included(leaves(spark, top), M.all_paths(nodes, top).where("block <> 2"), M.peaks(nodes, top)).collect() if not r["is_included"]} == set(range(512, 768))
