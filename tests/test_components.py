import random

from lacuna.operators import components as CC

EDGES = "src string, dst string"


def brute(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a in parent and b in parent:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ids(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "id string")


def test_chain_hub_loops_and_unknown_ends(spark):
    nodes = [f"n{i:03d}" for i in range(120)]
    chain = [(nodes[i + 1], nodes[i]) for i in range(40)]
    hub = [("n090", n) for n in nodes[60:89]]
    odd = [("n100", "n100"), ("n101", None), (None, "n102"), ("n103", "zz"), ("n104", "zz"), ("n060", "n090")]
    got = {r["id"]: r["label"] for r in CC.labels(ids(spark, nodes), spark.createDataFrame(chain + hub + odd, EDGES)).collect()}
    assert got == brute(nodes, chain + hub + odd)
    assert CC.labels(ids(spark, nodes[:3]), spark.createDataFrame([], EDGES)).where("id = label").count() == 3


def test_merging_equals_recomputing(spark):
    rng = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(150)]
    rng.shuffle(nodes)
    old, new = nodes[:100], nodes[100:]
    first = [(rng.choice(old), rng.choice(old)) for _ in range(60)]
    second = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)]
    stored = CC.labels(ids(spark, old), spark.createDataFrame(first, EDGES))
    grown = {r["id"]: r["label"] for r in CC.merge(stored, ids(spark, new), spark.createDataFrame(second, EDGES)).collect()}
    assert grown == brute(nodes, first + second)
    same = {r["id"]: r["label"] for r in CC.merge(stored, ids(spark, []), spark.createDataFrame([], EDGES)).collect()}
    assert same == brute(old, first)


def test_two_components_as_chains_with_shuffled_names(spark):
    """Labels are the smallest names although nodes are numbered otherwise; repeated and null ids keep their rows."""
    rng = random.Random(9)
    nodes = [f"n{i:04d}" for i in range(600)]
    rng.shuffle(nodes)
    chains = [(nodes[i], nodes[i + 1]) for i in range(599) if i != 299]
    got = [(r["id"], r["label"]) for r in CC.labels(ids(spark, [*nodes, nodes[0], None]), spark.createDataFrame(chains, EDGES)).collect()]
    want = brute(nodes, chains)
    assert sorted(got, key=str) == sorted([*want.items(), (nodes[0], want[nodes[0]]), (None, None)], key=str)


def test_rounds_keep_only_nodes_with_edges(spark, monkeypatch):
    """A hub takes its leaves within two rounds; each round has fewer edges than the one before."""
    sizes = {}
    kept = CC.written

    def count(df, name, place):
        out = kept(df, name, place)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(CC, "written", count)
    hub = [("n000", f"n{i:03d}") for i in range(1, 60)]
    pairs = [(f"m{i:03d}", f"m{i + 1:03d}") for i in range(0, 40, 2)]
    nodes = sorted({x for e in hub + pairs for x in e} | {"alone"})
    got = {r["id"]: r["label"] for r in CC.labels(ids(spark, nodes), spark.createDataFrame(hub + pairs, EDGES)).collect()}
    assert got == brute(nodes, hub + pairs)
    links = [sizes[f"links_{k}"] for k in range(sum(n.startswith("links_") for n in sizes))]
    assert links[-1] == 0 and all(a > b for a, b in zip(links, links[1:]))
    assert len(links) <= 3 and sizes["names_2"] <= 1
