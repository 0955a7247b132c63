"""Relations of pairs from edges held by every worker, against the closure."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termloom.operators import graph
from termloom.operators import hierarchy as hy


@pytest.mark.parametrize("cyclic", [False, True])
def test_related_pairs_agree_with_the_closure(spark, monkeypatch, cyclic):
    monkeypatch.setattr(hy, "BLOCK", 50)
    rng = random.Random(8)
    n = 180
    links = {(7 * k, 7 * rng.randrange(max(1, k // 3), k)) for k in range(2, n) for _ in range(rng.randrange(1, 4))} | {(14, 7)}
    links |= {(14, 700), (70, 1190)} if cyclic else set()
    edges = spark.createDataFrame(sorted(links), "child long, parent long")
    nodes = spark.createDataFrame([(7 * k,) for k in range(1, n) if k % 11], "node long")
    rows = [(7 * rng.randrange(n), 7 * rng.randrange(n) + (rng.random() < 0.02), k) for k in range(3000)]
    pairs = spark.createDataFrame(rows + rows[:50], "a long, b long, k int")
    hops = graph.cut_lineage(graph.closure(edges))
    depth = graph.depths(nodes, hops, 7)
    h = hy.hierarchy(edges, nodes, 7)
    got = hy.related(pairs, h)
    assert got.count() == 3050
    once = hy.related(pairs.drop("k"), h, once=True)
    assert once.count() == len({r[:2] for r in rows})
    want = graph.common_ancestors(pairs.select("a", "b").distinct(), hops, depth)
    assert sorted(map(tuple, once.filter("lca is not null").select("a", "b", "lca", "lca_depth").collect())) == sorted(map(tuple, want.collect()))
    scores = graph.similarity(pairs.select(F.col("a").alias("gold"), F.col("b").alias("pred")), hops, depth)
    mine = once.withColumnRenamed("a_depth", "gold_depth").select("a", "b", graph.tier_score("a", "b"))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, scores.collect()))
    dist = {(r.node, r.ancestor): r.dist for r in hops.collect()}
    assert all((r.from_a, r.from_b) == (dist[r.a, r.lca], dist[r.b, r.lca]) for r in once.filter("lca is not null").collect())


@pytest.mark.parametrize("name", ["lca_pairs", "hier_similarity", "lca_clusters", "tiered_metrics"])
def test_pairs_of_ancestors_are_no_rows(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ancestor" not in plan
