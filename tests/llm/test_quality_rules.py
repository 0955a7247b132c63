"""Limits read from each level of the sketches, both joins, and sketches beyond their exact size."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termloom.llm import quality_rules as Q

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def documents(n_hot, n_other):
    """A hot source, a few groups of some 60 documents, small groups, null groups, junk and edge cases."""
    rng, rows = random.Random(8), []

    def prose(size):
        return "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(12)) for _ in range(size))

    for i in range(n_hot + n_other):
        lang, source = ("en", "hot") if i < n_hot else (["de", "fr", None][i % 3], ["s1", "s2", None, "s3", "s4"][i % 5])
        text = prose(rng.randrange(1, 6))
        if i % 17 == 0:
            text = " ".join(w + "###" * rng.randrange(1, 3) for w in text.split())
        if i % 19 == 0:
            text = "\n".join([text, *["a line that comes again " + str(i)] * rng.randrange(2, 7)])
        rows.append((i, {0: None, 1: "", 2: " \n\t", 3: "# $ % & * < > | # $ % &"}.get(i, text), lang, source))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    docs = documents(400, 500)
    folder = tmp_path_factory.mktemp("rules")
    docs.to_parquet(folder / "documents.parquet")
    return docs, str(folder), {r.doc_id: r for r in Q.op8_quality_rules(spark, str(folder)).collect()}


def test_every_level_equals_the_sql(judged):
    docs, folder, got = judged
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(Q.OP8_SQL).fetchall()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.values()) == sorted(want)
    sizes = docs.groupby(["lang", "source"], dropna=False).size()
    assert sizes.max() >= 400 and sizes.min() < Q.MIN_GROUP  # own limits and those of a level above
    rejected = sum(not r.kept and not r.base_failed for r in got.values())
    assert 10 < rejected < 0.12 * len(docs)


def test_salted_join_gives_the_same(spark, judged):
    _, folder, got = judged
    stats = Q.statistics(spark.read.parquet(f"{folder}/documents.parquet")).drop("text").withColumns(Q.rates())
    limits = Q.fences(Q.sketches(stats))
    salted = Q.with_limits(stats, limits, broadcast_groups=0, salt=4)
    whole = Q.with_limits(stats, limits)
    names = ["doc_id", "lo_mean_word", "hi_mean_word", "hi_symbol_rate", "hi_dup_line_rate"]
    assert sorted(map(str, salted.select(names).collect())) == sorted(map(str, whole.select(names).collect()))


def test_sketches_beyond_their_exact_size_keep_to_their_rank_error(spark):
    n = 6000
    stats = spark.range(n).select(F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(5).alias("n_words"), ((F.col("id") * 7919) % n / n).alias("mean_word"), F.lit(0.0).alias("symbol_rate"), F.lit(0.0).alias("dup_line_rate")).repartition(5)
    row = Q.fences(Q.sketches(stats), width=0.0).first()
    assert abs(row.lo_mean_word - 0.1) < 0.01 and abs(row.hi_mean_word - 0.9) < 0.01
    assert row.hi_symbol_rate == 0.0


def test_groups_of_even_documents_keep_their_own(spark):
    stats = spark.range(200).select(F.lit("en").alias("lang"), F.lit("x").alias("source"), F.col("id").alias("doc_id"), F.lit(50).alias("n_words"), F.lit(250).alias("word_chars"), F.lit(0).alias("n_repeat_words"), F.lit(5.0).alias("mean_word"), F.lit(0.0).alias("symbol_rate"), F.lit(0.0).alias("dup_line_rate"))
    assert Q.judge(stats, Q.fences(Q.sketches(stats))).filter("kept").count() == 200
