"""Assignments of many documents at once against the solvers of single matrices."""

import numpy as np
import pytest

from termloom.operators import assignment
from termloom.operators import evaluation as ev


@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_documents_solved_together_get_the_pairs_of_the_single_solver(spark, method):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for d in range(3000):
        n, m = rng.integers(1, 7, 2)
        scores = rng.choice([0.0, 0.05, 0.1, 0.3, 0.55, 0.7, 1.0], (n, m))  # many ties
        rows += [(d, 10 * i, f"p{j}", float(scores[i, j])) for i in range(n) for j in range(m)]
        want |= {(d, 10 * i): (f"p{j}", scores[i, j]) for i, j in getattr(assignment, method)(scores, 0.1).items()}
    df = spark.createDataFrame(rows, "doc long, g long, p string, s double")
    out = ev.assign(df, "doc", "g", "p", "s", method, 0.1)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # no group a document
    assert {(r.doc, r.g): (r.p, r.s) for r in out.collect()} == want
    assert ev.assign(df.limit(0), "doc", "g", "p", "s", method, 0.1).count() == 0


def test_vectors_match_as_all_their_pairs_do_with_copies_and_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from termloom.functions import vectors as V

    monkeypatch.setattr(ev, "NEAR_PART", 20)
    rng = np.random.default_rng(5)
    pool = rng.integers(-3, 4, (40, 6)).astype(float)  # copies, multiples and zero vectors
    rows = [("ab"[i % 3 // 2], i, (pool[rng.integers(40)] * rng.choice([1, 2])).tolist()) for i in range(400)] + [("c", 400, pool[0].tolist()), ("a", 401, None)]
    df = spark.createDataFrame(rows, "doc string, id long, v array<float>")
    gold, pred = df.filter("id % 2 = 0").withColumnRenamed("id", "g"), df.filter("id % 2 = 1").withColumnRenamed("id", "p")
    got = ev.match_vectors(gold, pred, "doc", "g", "p", "v", 0.1)
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # pairs are not rows
    pairs = gold.join(pred.filter("v is not null").withColumnRenamed("v", "w"), "doc").select("doc", "g", "p", V.cosine(F.col("v"), F.col("w")).alias("similarity"))
    want = ev.embedding_match(pairs, "doc", "g", "p", "similarity", 0.1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10
