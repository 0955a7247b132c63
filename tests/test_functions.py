"""Golden and boundary cases of functions and operators."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from termloom.functions import json_repair as J
from termloom.functions import text as T
from termloom.operators import assignment
from termloom.operators import retrieval as rt


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_statement_forms(spark):
    for text, want in [
        ("Known hypersensitivity to oxymorphone.", "hypersensitivity|oxymorphone"),
        ("history of known penicillin allergy", "hypersensitivity|known penicillin"),
        (None, ""),
        ("Patients with severe asthma", "severe asthma"),
    ]:
        assert one(spark, T.canonical_statement(F.col("t")), t=text) == want
    assert one(spark, T.semantic_tag(F.col("t")), t="Pain (finding)") == "finding"
    assert one(spark, T.strip_tag(F.col("t")), t="Pain (finding)") == "Pain"
    assert one(spark, T.split_cell(F.col("t")), t=" a;;b\r\n c ") == ["a", "b", "c"]
    assert one(spark, T.split_cell(F.col("t")), t=None) == []


def test_set_similarity_of_empty_sets_is_zero(spark):
    assert one(spark, T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), a="", b=None) == 0.0
    assert one(spark, T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), a="x y", b="y z") == 1 / 3


def test_json_is_found_in_model_output():
    assert J.extract_json('```json\n{"items": [{"a": "}"}]}\n```') == {"items": [{"a": "}"}]}
    assert J.extract_json(None) is None
    assert J.outer_span('x {"a": "{"} y') == '{"a": "{"}'


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.random((3, 4)).round(2) + 0.01
        best = max(sum(s[i, p[i]] for i in range(3)) for p in itertools.permutations(range(4), 3))
        got = assignment.optimal(s)
        assert len(set(got.values())) == len(got)
        assert abs(sum(s[g, p] for g, p in got.items()) - best) < 1e-9


def test_no_counts_give_zero_metrics():
    assert assignment.prf(0, 0, 0) == (0.0, 0.0, 0.0)


def test_fusion_of_first_ranks(spark):
    hit = spark.createDataFrame([(1, 7, 1.0, 1)], "q long, d long, score double, rank int")
    row = rt.rrf([("dense", hit)], "q", "d", 5).first()
    assert abs(row.fused - 1 / 61) < 1e-12
