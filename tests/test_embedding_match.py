"""Embedding match over whole labels against the greedy solver, and its ties."""

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as entry
from termloom.operators import assignment
from termloom.operators import evaluation as ev

SF = "/root/testdata/sf0.01"


def test_every_prediction_is_offered_all_gold_vectors_of_its_label(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, label, v = np.array(t["vec_id"]), np.array(t["label"]), np.array(t["embedding"], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for x in np.unique(label):
        g, p = (np.flatnonzero((label == x) & (ids % 2 == k)) for k in (0, 1))
        g, p = g[np.argsort(ids[g])], p[np.argsort(ids[p])]
        m = v[p] @ v[g].T
        want |= {(int(ids[g[j]]), int(ids[p[i]])): m[i, j] for i, j in assignment.best_gold_only(m, 0.1)}
    got = {(r.g, r.p): r.similarity for r in entry.queries()["embedding_greedy"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ties_and_threshold(spark):
    rows = [("a", 1, 1, 0.9), ("a", 2, 1, 0.9), ("a", 1, 2, 0.9), ("a", 2, 2, 0.5), ("a", 3, 3, 0.2), ("a", 2, 3, 0.1), ("b", 1, 4, 0.3)]
    got = ev.embedding_match(spark.createDataFrame(rows, "doc string, g long, p long, s double"), "doc", "g", "p", "s", 0.3)
    assert got.columns == ["doc", "g", "p", "s"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 0.9), ("b", 1, 4, 0.3)]
