"""Leaks of paraphrased items against brute force over all regions of a text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import decontamination as D

SF = "/root/testdata/sf0.01"


def paraphrase(rng, words, share, how):
    out = list(words)
    for k in rng.sample(range(len(out)), round(share * len(out))):
        out[k] = "" if how == "deleted" else f"unseen{rng.randrange(10**9)}"
    return [w for w in out if w]


def brute_force(texts, items):
    """(document, item) of every leak: the LCS in all regions that begin a STRIDE apart."""
    h, rows, _ = D._words(pa.array(texts, pa.string()))
    g, of, _ = D._words(pa.array(items, pa.string()))
    docs, wanted = ([x[r == i].tolist() for i in range(n)] for x, r, n in ((h, rows, len(texts)), (g, of, len(items))))
    found = set()
    for i, w in enumerate(wanted):
        n, a = len(w), min(D.ANSWER, len(w))
        masks, answers = D._masks(w), D._masks(w[-a:])
        for d, text in enumerate(docs):
            for s in range(0, len(text), D.STRIDE) if n else ():
                region = text[s : s + n + 2 * (D.STRIDE + n // 4)]
                if D.is_leak(D.lcs(masks, region, n) / n, D.lcs(answers, region, a) / a, n):
                    found.add((d, i))
                    break
    return found


@pytest.mark.parametrize("how", ["unseen", "deleted"])
def test_paraphrased_leaks_are_those_of_brute_force(spark, how):
    rng = random.Random(5)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    base = [r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 400 and 3000").orderBy("doc_id").limit(240).collect()]
    texts = []
    for k, words in enumerate(base):
        at = rng.randrange(len(words))
        texts.append(" ".join([*words[:at], *paraphrase(rng, items[k % len(items)].split(), (0.1, 0.2, 0.3, 0.38)[k // 7 % 4], how), *words[at:]]))
    want = brute_force(texts, items)
    assert len(want) > 120
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id): r for r in D.find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert want - set(got) == set()
    # the cosine's own regions do not begin on the grid: a leak more is right if its shares say so
    sizes = [len(D._words(pa.array([x], pa.string()))[0]) for x in items]
    assert all(D.is_leak(r.lcs_share, r.answer_share, sizes[i]) for (_, i), r in got.items())
    assert len(got) <= 1.05 * len(want)


def test_regions_by_rare_words_reach_long_and_short_texts():
    rng = random.Random(2)
    item = [f"i{k}" for k in range(30)]
    fill = lambda n: [f"f{rng.randrange(500)}" for _ in range(n)]
    texts = [" ".join([*fill(a), *item[:20], *fill(b)]) for a, b in ((0, 0), (0, 900), (250, 3), (900, 0), (507, 700))]
    block = D.ItemBlock([7, 8, 9], [" ".join(item), None, "one two"], np.ones((D.BUCKETS, D.RANK), np.float32))
    h, rows, n = D._words(pa.array([*texts, "", None], pa.string()))
    first = np.searchsorted(rows, np.arange(n + 1))
    got = block.spots(first, D._buckets(h))
    assert set(got[1][got[0] == 0].tolist()) == {0, 1, 2, 3, 4}
    assert set(got[0].tolist()) == {0}
    best = {}
    for i, r, s, e in zip(*(x.tolist() for x in got), strict=True):
        best[r] = max(best.get(r, 0), block.judge(i, h[s:e].tolist())[0])
    assert best == dict.fromkeys(range(5), 20 / 30)


def test_regions_that_start_together_and_end_apart_are_all_judged():
    item = [f"w{k}" for k in range(48)]
    text = [*item[32:], *item]
    eye = np.zeros((D.BUCKETS, D.RANK), np.float32)
    h, _, _ = D._words(pa.array([" ".join(item)], pa.string()))
    eye[D._buckets(h), np.arange(48) % D.RANK] = 1
    block = D.ItemBlock([7], [" ".join(item)], eye)
    got = D.leaks(pa.array([" ".join(text)]), block, eye, 0.95)
    assert {k: v[:2] for k, v in got.items()} == {(0, 0): (pytest.approx(1.0), 1.0)}


def test_short_items_null_ids_and_repeated_rows(spark):
    words = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([(1, "Two Words"), (2, words), (2, words), (3, None), (4, "")], "item_id long, text string")
    rows = [(None, f"x {words} y", "a"), (None, "clean text without any of it", "b"), (5, words, "c"), (5, words, "d"), (6, "here two words come", "e"), (7, "two other words", "f"), (8, None, "g"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    found = D.find_leaks(docs, items).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.lcs_share) for r in found) == [(-1, 2, 1.0), (5, 2, 1.0), (6, 1, 1.0)]
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.item_id or "-" for r in kept.collect()) == ["-", "b", "f", "g"]


def test_many_items_and_a_sampled_space_find_the_same(spark):
    rng = random.Random(9)
    items = [" ".join(f"v{rng.randrange(3000)}" for _ in range(25)) for _ in range(600)]
    texts = [" ".join([*(f"v{rng.randrange(3000)}" for _ in range(40)), *paraphrase(rng, items[k].split(), 0.2, "unseen"), "end"]) for k in range(0, 600, 7)]
    want = brute_force(texts, items)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weighted, idf = D.latent_space(docs, basis_docs=20)
    block = D.ItemBlock(list(range(600)), items, weighted, idf)
    got = {(r.doc_id, r.item_id) for r in D.search(docs, block, weighted).collect()}
    assert want <= got and len(got) <= 1.05 * len(want) + 1
