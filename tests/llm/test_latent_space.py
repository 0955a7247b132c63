"""The latent space comes from every document, however many there are."""

import random

import numpy as np
import pyarrow as pa

from termloom.llm import decontamination as D


def test_the_space_is_fitted_on_every_document_of_a_large_table(spark):
    docs = spark.range(17_000).selectExpr("id as doc_id", "concat_ws(' ', 'w' || id % 90, 'w' || id % 77, 'x' || id % 50, 'y' || id % 8, 'z' || id % 13) as text")
    weighted, idf = D.latent_space(docs)
    whole = D.latent_basis(docs, idf) * idf[:, None]
    some = np.flatnonzero(np.abs(whole).sum(axis=1))
    got, want = (x[some] @ x[some].T for x in (weighted, whole))
    assert np.allclose(got, want, atol=1e-3 * np.abs(want).max())


def test_the_space_decides_no_leak():
    rng = random.Random(4)
    items = [[f"v{rng.randrange(5000)}" for _ in range(24)] for _ in range(300)]
    texts = []
    for k in range(300):
        # the item's words stretched over about as many words as a region has
        body = [w for x in items[k] for w in ([x] if rng.random() < 0.85 else []) + [f"u{rng.randrange(9999)}"] * rng.choice([0, 0, 1, 3])]
        texts.append(" ".join([f"u{rng.randrange(9999)}" for _ in range(rng.randrange(40))] + body + ["end"] * 30))
    texts = pa.array(texts)
    h, _, _ = D._words(texts)
    df = np.bincount(D._buckets(h), minlength=D.BUCKETS)
    idf = D.idf_weights(df, 300)
    weighted = np.random.default_rng(1).standard_normal((D.BUCKETS, D.RANK)).astype(np.float32) * idf[:, None]
    block = D.ItemBlock(list(range(300)), [" ".join(x) for x in items], weighted, idf)
    some, none = D.leaks(texts, block, weighted), D.leaks(texts, block, weighted, cosine=2.0)
    assert len(some) > 100
    assert {k: v[1:3] for k, v in some.items()} == {k: v[1:3] for k, v in none.items()}
