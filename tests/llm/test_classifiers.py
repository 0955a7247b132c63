"""Scores of both classifiers against plain Python, and training tables with odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import quality_model as Q
from termloom.llm import toxicity as X

M = (1 << 64) - 1


def code(gram: str) -> int:
    """The hashed place of one n-gram, by whole numbers."""
    h = 0
    for c in gram:
        h = (h * int(X.P) + ord(c) + 1) & M
    h = (h + len(gram) - 1) & M
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return (h ^ (h >> 31)) >> (64 - X.SPACE_BITS)


def grams(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {code(t[i : i + n]) for n in X.NGRAMS for i in range(len(t) - n + 1)}


TEXTS = [None, "", "abc", "Bad bad WORDS here", "süße Grüße 日本語のテキスト", "bad words", "e" * 3000, "x 🎉 y 🎉 z"]


def test_features_are_code_point_ngrams():
    rows, feats, n = X.ngram_hits(pa.array(TEXTS))
    assert n == len(TEXTS)
    got = [set(feats[rows == i].tolist()) for i in range(n)]
    assert got == [grams(t) for t in TEXTS]


def test_scores_equal_the_sum_of_weights(spark):
    train = [(f"good text number {i} of many", 0) for i in range(40)] + [(f"bad words number {i} süß", 1) for i in range(20)]
    model = X.fit(spark.createDataFrame(train, "text string, y int"), n_features=300)
    weight = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *(t for t, _ in train)])), "doc_id long, text string")
    for r in X.score_documents(docs, model).collect():
        text = [*TEXTS, *(t for t, _ in train)][r.doc_id]
        z = model.intercept + sum(weight.get(g, 0.0) for g in grams(text))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    kept = {r.doc_id for r in X.reject(docs, model).collect()}
    assert {i for i in range(len(TEXTS), len(TEXTS) + 40)} <= kept and not kept & set(range(len(TEXTS) + 40, len(TEXTS) + 60))


def test_small_tables_learn_too(spark):
    rows = [(i, "a friendly line" if i % 2 else "a hateful line") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in X.score_documents(docs, X.train_toxicity(docs, labels)).collect()}
    assert min(scores[i] for i in range(0, 12, 2)) > max(scores[i] for i in range(1, 12, 2))


def test_repeated_ids_and_labels_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = X.training_rows(docs, labels, "toxic", 10**6, -1, 100).collect()
    assert sorted((r.text or "", r.y) for r in rows) == sorted([("", 0), *((min(rows, key=lambda r: r.text is None).text, y) for y in (0, 1))])
    assert X.training_rows(docs, labels, "toxic", 10**6, -1, 2).count() <= 2


@pytest.mark.parametrize("extra", [False, True])
def test_compiled_rules_equal_the_numbers(spark, extra):
    rng = np.random.default_rng(3)
    texts = [None, "", "   ", "one", "A B! C? | $ # 12", "line one here\nline one here\nline two", "x " * 400, *(" ".join(rng.choice(["word", "Other", "12", "no!", "a|b"], 30)) for _ in range(30))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, other string")
    if extra:
        docs = docs.withColumns({"n_words": F.lit("clash"), "y": F.lit(1)})
    rows = Q.statistics(docs).orderBy("doc_id").select(*Q.FEATURES).toPandas().to_numpy(dtype=float)
    # cuts that are values of the table itself: equality must fall to the same side in both
    rules = [[(f, op, float(rows[k, f]))] for f in range(len(Q.FEATURES)) for op in ("<=", ">") for k in (0, 4, 5, 9)]
    rules += [[(0, ">", 3.0), (1, "<=", 4.5)], [(2, ">", 0.0), (4, ">", 0.0), (0, "<=", 100.0)]]
    model = Q.RuleEnsemble(rules, rng.standard_normal(len(rules)), 0.1)
    want = 1 / (1 + np.exp(-(model.holds(rows) @ model.weights + 0.1)))
    got = [r.score for r in Q.score_documents(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-12)
