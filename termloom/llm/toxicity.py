"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios (NB-SVM style).

Features are hashed n-grams of NGRAMS code points over the text with A-Z lowered, taken per document as present or
absent. Three passes: (1) n-gram counts by class over the training rows give log ratios, from which the N_FEATURES
most telling n-grams are kept; (2) the training rows' kept n-grams go to the driver, which fits an L2 logistic
regression on presence times ratio; (3) all documents are scored in Arrow batches with a hash table of the weights.
Training rows are labelled rows outside the held-out fold, at most MAX_TRAIN of them, by smallest hash of doc_id; every
document's whole text is read and scored. Labels, lang, source and doc_id never enter a score.

Null and empty texts have no n-gram and score the intercept. Repeated ids are scored each by itself; one text of a
repeated doc_id trains, that of the smallest hash, and a doc_id with two labels trains once with each. Null labels do not train. Without labels of both classes every score is the base rate
(0 where there is none). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, tidy
from .hashing import P, buffer_of, mix

NGRAMS = (4, 5)
SPACE_BITS = 22
N_FEATURES = 2048
MAX_TRAIN = 16_384
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with A-Z lowered, offsets with one more entry than texts)."""
    raw, off = buffer_of(texts)
    point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    point[(point >= 65) & (point <= 90)] += np.uint64(32)
    return point, np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][off]


def ngram_hits(texts, table_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, feature) pairs, distinct: hashed n-grams, or their places in table_of (-1 there: not a feature)."""
    point, off = code_points(texts)
    n_rows, n = len(off) - 1, len(point)
    rows_out, feats_out = [], []
    if n:
        point = point + np.uint64(1)
        row = np.repeat(np.arange(n_rows), np.diff(off))
        acc = np.zeros(n, dtype=np.uint64)
        shift = np.uint64(64 - SPACE_BITS)
        for k in range(max(NGRAMS)):
            m = n - k
            acc = acc[:m] * P + point[k:]
            if k + 1 in NGRAMS:
                code = (mix(acc + np.uint64(k)) >> shift).astype(np.int64)
                inside = row[:m] == row[k:]
                if table_of is None:
                    rows_out.append(row[:m][inside])
                    feats_out.append(code[inside])
                else:
                    f = table_of[code]
                    hit = np.flatnonzero((f >= 0) & inside)
                    rows_out.append(row[hit])
                    feats_out.append(f[hit].astype(np.int64))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_rows
    pair = np.unique((np.concatenate(rows_out) << SPACE_BITS) | np.concatenate(feats_out))
    return pair >> SPACE_BITS, pair & ((1 << SPACE_BITS) - 1), n_rows


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_cols: int, l2: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression over sparse triples, by accelerated gradient descent."""
    w, b = np.zeros(n_cols), 0.0
    if len(y) == 0:
        return w, b
    norm = np.bincount(rows, weights=values**2, minlength=len(y)).mean() + 1
    rate = 4.0 / norm
    vw, vb, pw, pb = w.copy(), b, w.copy(), b
    for t in range(steps):
        z = np.bincount(rows, weights=values * vw[cols], minlength=len(y)) + vb
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(cols, weights=values * d[rows], minlength=n_cols) / len(y) + l2 / len(y) * vw
        gb = d.mean()
        w, b = vw - rate * gw, vb - rate * gb
        vw, vb = w + t / (t + 3) * (w - pw), b + t / (t + 3) * (b - pb)
        pw, pb = w, b
    return w, b


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_train: int) -> DataFrame:
    """(text, y) of the labelled rows outside the held-out fold, at most max_train by smallest hash of doc_id."""
    y = labels.filter(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held_out))
    y = y.select("doc_id", F.col(label).cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")  # max_train rows of two numbers
    one = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))  # of a repeated doc_id; a struct keeps nulls
    return rows.groupBy("doc_id", "y").agg(one.alias("t")).select("t.text", "y")


def _class_counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    pos, neg = np.zeros(1 << SPACE_BITS, np.int32), np.zeros(1 << SPACE_BITS, np.int32)
    for batch in batches:
        y = np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
        for lo in range(0, batch.num_rows, 256):
            rows, feats, _ = ngram_hits(batch.column(0).slice(lo, 256))
            is_pos = y[lo:][rows] == 1
            for counts, found in ((pos, feats[is_pos]), (neg, feats[~is_pos])):
                f, c = np.unique_counts(found)
                counts[f] += c.astype(np.int32)
    # a class's own n-grams are few; the common ones stay in every task and are summed
    f = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(pos[f], pa.int64()), pa.array(neg[f], pa.int64())], ["f", "pos", "neg"])


class NbLinear:
    """The fitted model: kept n-gram codes, their weights (ratio included), intercept, base rate."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, intercept: float):
        self.codes, self.weights, self.intercept = codes, weights, intercept

    def table_of(self) -> np.ndarray:
        t = np.full(1 << SPACE_BITS, -1, dtype=np.int16)
        t[self.codes] = np.arange(len(self.codes), dtype=np.int16)
        return t

    def score(self, texts, table_of: np.ndarray) -> np.ndarray:
        rows, feats, n = ngram_hits(texts, table_of)
        z = np.bincount(rows, weights=self.weights[feats] if len(self.weights) else None, minlength=n) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(train: DataFrame, n_features: int = N_FEATURES) -> NbLinear:
    spark = train.sparkSession
    ship(spark)
    n_pos, n_all = train.agg(F.sum("y"), F.count(F.lit(1))).first()
    n_pos = n_pos or 0
    if not 0 < n_pos < n_all:
        base = np.clip(n_pos / n_all if n_all else 0.0, 1e-9, 1 - 1e-9)
        return NbLinear(np.zeros(0, np.int64), np.zeros(0), float(np.log(base / (1 - base))))
    counts = train.mapInArrow(tidy(_class_counts), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + 1) / (n_pos + 2)) - F.log((F.col("neg") + 1) / (n_all - n_pos + 2))
    telling = F.abs(ratio) * F.sqrt(F.greatest(F.col("pos") / n_pos, F.col("neg") / (n_all - n_pos)))
    top = counts.select("f", ratio.alias("r"), telling.alias("t")).orderBy(F.desc("t"), "f").limit(n_features).collect()
    codes, r = np.array([x.f for x in top], dtype=np.int64), np.array([x.r for x in top])
    probe = NbLinear(codes, r, 0.0)

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = probe.table_of()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, feats, n = ngram_hits(part.column(0), t)
                cut = np.searchsorted(rows, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feats, pa.int16()))
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), lists], ["y", "fs"])

    # at most MAX_TRAIN rows with at most n_features small numbers each
    rows = train.mapInArrow(tidy(kept), "y int, fs array<short>").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    lists = rows.column("fs").combine_chunks()
    cols = lists.flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    w, b = logistic(at, cols, r[cols], y, len(codes))
    return NbLinear(codes, w * r, b)


def score_documents(docs: DataFrame, model: NbLinear) -> DataFrame:
    """doc_id and score of every document, over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_features numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        t = m.table_of()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(part.column(1), t), pa.float64())], ["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def reject(docs: DataFrame, model: NbLinear, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_features numbers
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        t = m.table_of()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield part.filter(pa.array(m.score(part.column(at), t) < threshold))

    ship(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> NbLinear:
    return fit(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, max_train))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
