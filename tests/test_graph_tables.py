"""Sweep join, adjacency, betweenness and communities as tables, against plain computations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from remembrane.operators import community, facts, graph

FACT = "subject string, predicate string, fact_id string, object string, valid_from string, valid_to string, superseded_by string"


def conflicts_by_hand(rows):
    before = lambda x, y: x is None or y is None or x < y
    out = []
    for a, b in itertools.permutations(rows, 2):
        if a[:2] == b[:2] and None not in a[:2] and a[2] < b[2] and a[3] != b[3] and before(a[4], b[5]) and before(b[4], a[5]) and a[6] != b[2] and b[6] != a[2]:
            out.append((a[2], b[2]))
    return sorted(out)


def test_conflicts(spark):
    r = random.Random(1)
    day = lambda: f"2024-{r.randint(1, 4):02d}-{r.randint(1, 9):02d}"
    rows = []
    for i in range(160):
        a, b = sorted((day(), day()))
        rows.append((r.choice("st"), r.choice(["p", "q", None]), f"f{i % 150}", r.choice("xyz"), r.choice((a, a, None)), r.choice((b, b, a, None)), r.choice((None, None, f"f{r.randint(0, 149)}"))))
    got = sorted((x.a_fact_id, x.b_fact_id) for x in facts.conflicts(spark.createDataFrame(rows, FACT)).collect())
    assert got == conflicts_by_hand(rows) and len(got) > 100
    assert facts.conflicts(spark.createDataFrame([], FACT)).count() == 0


def test_conflicts_of_one_large_subject(spark):
    """A subject with 60,000 facts one after another: all pairs would be 1.8 thousand million, those that overlap are none."""
    rows = spark.range(60_000).select(F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.concat(F.lit("f"), "id").alias("fact_id"), F.col("id").cast("string").alias("object"),
        F.date_format(F.timestamp_seconds(F.col("id") * 3600), "yyyy-MM-dd'T'HH").alias("valid_from"), F.date_format(F.timestamp_seconds(F.col("id") * 3600 + 3600), "yyyy-MM-dd'T'HH").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    assert facts.conflicts(rows).count() == 0


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    r = random.Random(2)
    rows = sorted({(f"n{r.randint(0, 60)}", r.choice("RST"), f"n{r.randint(0, 60)}") for _ in range(150)})
    path = str(tmp_path_factory.mktemp("net") / "e")
    spark.createDataFrame(rows, "src string, type string, dst string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("named", [1000, 2])
def test_adjacency(spark, net, monkeypatch, named):
    monkeypatch.setattr(graph, "MAX_NAMED", named)
    near = graph.adjacency(net)
    seeds = spark.createDataFrame([("n1",), ("n2",), ("none",)], "key string")
    for hops in (1, 2):
        want = {tuple(x) for x in graph.neighbors(net, seeds, hops).collect()}
        assert {tuple(x) for x in graph.neighbors_by(near, seeds, hops).collect()} == want and want
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(60)], "natural_key string, size int")
    steps = [{"relation": "R", "direction": "out", "depth": 2}, {"relation": "S", "direction": "both", "limit": 3}, {"relation": "T", "direction": "in", "where": F.col("size") > 5}]
    want = sorted(map(tuple, graph.traverse(nodes, net, seeds, steps).collect()))
    assert sorted(map(tuple, graph.traverse(nodes, None, seeds, steps, near=near).collect())) == want and want


def test_reads_of_few_keys_join_nothing(spark, net):
    found, _ = graph.at_keys(graph.adjacency(net), spark.createDataFrame([("n1",)], "key string"))
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan and "bucket" in plan.split("PartitionFilters")[1][:120]


def shuffled(spark, run):
    """What run() gives, and how many rows it shuffles."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    out = run()
    return out, sum(n for stage, n in total().items() if stage not in before)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A path of five keys beside 40,000 edges that have nothing to do with it, each edge twice."""
    rows = spark.range(80_000).select(F.concat(F.lit("x"), F.col("id") % 40_000).alias("src"), F.lit("R").alias("type"), F.concat(F.lit("y"), F.col("id") % 40_000 % 977).alias("dst"))
    path = str(tmp_path_factory.mktemp("wide") / "e")
    rows.unionByName(spark.createDataFrame([("b", "R", "a"), ("b", "R", "c"), ("aa", "R", "a"), ("aa", "R", "c"), ("d", "R", "c"), ("d", "R", "e"), ("a", "R", "a")] * 2, "src string, type string, dst string")).write.parquet(path)
    return spark.read.parquet(path)


def test_paths_shuffle_what_they_meet(spark, wide):
    found, rows = shuffled(spark, lambda: graph.shortest_path(wide, "a", "e"))
    assert found == ["a", "aa", "c", "d", "e"] and rows < 2000
    assert graph.shortest_path(wide, "a", "e", most=3) is None and graph.shortest_path(wide, "a", "e", most=4) == found
    assert graph.shortest_path(wide, "a", "x1") is None and graph.shortest_path(wide, "a", "nothing") is None and graph.shortest_path(wide, "e", "d") == ["e", "d"]


def test_neighborhoods_shuffle_what_they_meet(spark, wide):
    seeds = spark.createDataFrame([("a",)], "key string")
    (keys, links), rows = shuffled(spark, lambda: tuple(x.distinct().collect() for x in graph.neighborhood(wide, seeds, 2)))
    assert {tuple(x) for x in keys} == {("a", 0), ("aa", 1), ("b", 1), ("c", 2)} and rows < 2000
    assert {(x.src, x.dst) for x in links} == {("a", "a"), ("b", "a"), ("b", "c"), ("aa", "a"), ("aa", "c")}


def ring_of_cliques(n, size):
    return [(f"{c}{i}", f"{c}{j}") for c in range(n) for i in range(size) for j in range(i)] + [(f"{c}0", f"{(c + 1) % n}1") for c in range(n)]


@pytest.mark.parametrize("folds", [10, 0])
def test_betweenness(spark, monkeypatch, folds):
    monkeypatch.setattr(community, "FOLDS", folds)
    r = random.Random(3)
    pairs = {tuple(sorted((f"a{r.randint(0, 14)}", f"a{r.randint(0, 14)}"))) for _ in range(22)} | {("a1", "leaf"), ("leaf", "tip"), ("u", "v"), ("x", "y"), ("y", "z")}
    edges = spark.createDataFrame(sorted(pairs) + [("v", "u")], "src string, dst string")
    want = community.betweenness(edges)
    got = {(x.a, x.b): x.betweenness for x in community.edge_betweenness(edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    nodes = {x.key: x.betweenness for x in community.node_betweenness_table(edges).collect()}
    plain = community.node_betweenness(edges)
    assert nodes.keys() == plain.keys() and all(abs(nodes[k] - plain[k]) < 1e-6 for k in plain)


def test_betweenness_in_batches(spark, monkeypatch):
    monkeypatch.setattr(community, "BATCH_ROWS", 200)
    edges = spark.createDataFrame(ring_of_cliques(4, 4), "src string, dst string")
    want = community.betweenness(edges)
    got = {(x.a, x.b): x.betweenness for x in community.edge_betweenness(edges).collect()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    some = {(x.a, x.b): x.betweenness for x in community.edge_betweenness(edges, pivots=8).collect()}
    assert max(some, key=some.get) in sorted(want, key=want.get)[-8:]


def test_leiden(spark):
    edges = spark.createDataFrame(ring_of_cliques(5, 5), "src string, dst string")
    found = community.leiden(edges, rounds=8, levels=4)
    assert sorted(tuple(sorted(x.key for x in rows)) for _, rows in itertools.groupby(sorted(found.collect(), key=lambda x: x.community), lambda x: x.community)) == [tuple(f"{c}{i}" for i in range(5)) for c in range(5)]
    assert community.modularity(edges, found) > 0.6
    apart = spark.createDataFrame([("00", "c"), ("01", "c"), ("20", "c"), ("21", "c"), ("40", "d")], "key string, community string")
    parts = {x.key: x.community for x in community.connected_parts(edges, apart).collect()}
    assert parts["00"] == parts["01"] != parts["20"] == parts["21"] and parts["40"] == "40"


def propagated(spark, pairs, rounds=40):
    """Labels by hand, with the hash that deals nodes to sides."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    side = {x.key: x.s for x in spark.createDataFrame([(k,) for k in near], "key string").select("key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("s")).collect()}
    label, quiet = {k: k for k in near}, 0
    for turn in range(rounds):
        new = dict(label)
        for k in near:
            if side[k] == turn % 2:
                votes = [label[b] for b in near[k]]
                new[k] = min(votes, key=lambda x: (-votes.count(x), x))
        quiet = quiet + 1 if new == label else 0
        label = new
        if quiet == 2:
            break
    return label


@pytest.mark.parametrize("few", [50, 1])
def test_label_propagation(spark, monkeypatch, few):
    """Each side's turn counts its own votes only, and later turns only those that can change: fewer rows than all votes of each round."""
    monkeypatch.setattr(community, "FEW", few, raising=False)
    r = random.Random(7)
    pairs = [(f"k{r.randint(0, 90)}", f"k{r.randint(0, 90)}") for _ in range(150)] + [("p1", "p2"), ("p2", "p1"), ("q", "q")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    found, rows = shuffled(spark, lambda: {x.key: x.community for x in community.label_propagation(edges).collect()})
    assert found == propagated(spark, pairs)
    assert rows < 8000


def test_moves_rate_one_side(spark):
    edges = spark.createDataFrame(ring_of_cliques(8, 12), "src string, dst string")
    found, rows = shuffled(spark, lambda: community.louvain(edges, rounds=8, levels=2).collect())
    assert len({x.community for x in found}) == 8 and rows < 5700


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_rounds_over_blocks(spark, monkeypatch, block):
    """Rounds shuffle arrays for whole blocks, not a row for each link, and give the same over one block and over many."""
    from remembrane.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", block)
    pairs = ring_of_cliques(3, 14)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    packed, names = community.coded(edges)
    assert packed.groups == (1 if block > 1000 else 14) and packed.total == 2 * len(pairs)
    begun = names.select(F.col("id").alias("key"), F.col("id").alias("community"))
    found, rows = shuffled(spark, lambda: {x.key: x.community for x in community.local_moves(packed, 3, 1.0, begun).collect()})
    assert rows < 3000
    assert len(found) == 42 and sum(1 for k, c in found.items() if k == c) < 21
    assert {x.key: x.community for x in community.label_propagation(edges, 6).collect()} == propagated(spark, pairs, 6)
