"""Closure of a hierarchy deeper than 64 levels."""

from termloom.operators import graph


def test_closure_reaches_ancestors_more_than_64_levels_up(spark):
    n = 70
    edges = spark.createDataFrame([(k + 1, k) for k in range(n)], "child long, parent long")
    got = {(r.node, r.ancestor): r.dist for r in graph.closure(edges).collect()}
    assert got == {(a, b): a - b for a in range(n + 1) for b in range(a)}
