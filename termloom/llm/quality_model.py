"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Statistics of each text are built-in column expressions. On at most MAX_TRAIN labelled rows outside the held-out fold,
small trees are grown on bootstrap samples; every path from a root becomes a conjunctive rule; an L1 logistic
regression keeps few of them; and intercept plus weighted rules become one column expression, so scoring is one pass
over the texts inside the JVM. Every whole text is scored. Labels, lang, source and doc_id never enter a score.

Null and empty texts have zero statistics and are scored by the rules that hold for those. Repeated ids are scored
each by itself; of a repeated doc_id one text trains. statistics replaces input columns that have a feature's name. Null labels do not train; without labels of both classes every score is the base rate (0.5 without
labels). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD_SPLIT, table
from .toxicity import training_rows
from .trees import grow, paths

FOLDS, HELD_OUT = 5, 0
MAX_TRAIN = 16_384
THRESHOLD = 0.3
N_TREES = 40
DEPTH = 3
L1 = 2e-4
FEATURES = ["n_words", "mean_word", "symbol_rate", "upper_rate", "digit_rate", "stop_rate", "bang_rate", "bar_rate", "distinct_rate", "adjacent_rate", "dup_line_rate", "words_per_line", "top_word_rate"]


def statistics(docs: DataFrame) -> DataFrame:
    """The input's columns with FEATURES (doubles)."""
    t = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    count = lambda chars: F.char_length(t) - F.char_length(F.regexp_replace(t, chars, ""))
    first = docs.withColumns({
        "words__": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT)),
        "lines__": F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
        "chars__": F.greatest(F.char_length(t), F.lit(1)).cast("double"),
        "symbols__": count("[#*$%&|<>]"),
        "upper__": count(r"\p{Lu}"),
        "digits__": count("[0-9]"),
        "stops__": count("[.?]"),
        "bangs__": count("!"),
        "bars__": count(r"\|"),
    })
    sized = first.withColumns({
        "n__": F.size("words__").cast("double"),
        "letters__": F.char_length(F.array_join("words__", "")).cast("double"),
        "distinct__": F.size(F.array_distinct("words__")),
        "adjacent__": F.expr("size(filter(words__, (x, i) -> i > 0 and x = get(words__, i - 1)))"),
        "n_lines__": F.size("lines__").cast("double"),
        "line_kinds__": F.size(F.array_distinct("lines__")),
    }).drop("words__", "lines__")
    n, c = F.greatest("n__", F.lit(1.0)), F.col("chars__")
    return sized.withColumns({
        "n_words": F.col("n__"),
        "mean_word": F.col("letters__") / n,
        "symbol_rate": F.col("symbols__") / c,
        "upper_rate": F.col("upper__") / c,
        "digit_rate": F.col("digits__") / c,
        "stop_rate": F.col("stops__") / n,
        "bang_rate": F.col("bangs__") / n,
        "bar_rate": F.col("bars__") / n,
        # distinct words against what prose of that length has, so that long texts are not taken for lists
        "distinct_rate": F.col("distinct__") / F.pow(n, F.lit(0.8)),
        "adjacent_rate": F.col("adjacent__") / n,
        "dup_line_rate": (F.col("n_lines__") - F.col("line_kinds__")) / F.greatest("n_lines__", F.lit(1.0)),
        "words_per_line": n / F.greatest("n_lines__", F.lit(1.0)),
        "top_word_rate": 1 - F.col("distinct__") / n,
    }).drop("chars__", "symbols__", "upper__", "digits__", "stops__", "bangs__", "bars__", "n__", "letters__", "distinct__", "adjacent__", "n_lines__", "line_kinds__")


class RuleEnsemble:
    """Rules as conditions on feature places, their weights, and the intercept."""

    def __init__(self, rules: list, weights: np.ndarray, intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(self.rules)), dtype=bool)
        for k, rule in enumerate(self.rules):
            for f, op, at in rule:
                out[:, k] &= x[:, f] <= at if op == "<=" else x[:, f] > at
        return out

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for f, op, at in rule:
                c = F.col(FEATURES[f])
                cond = cond & (c <= float(at) if op == "<=" else c > float(at))
            z = z + F.when(cond, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def lasso_logistic(x: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, k = x.shape
    x = x.astype(float)
    rate = 4 / (np.linalg.norm(np.column_stack([x, np.ones(n)]), 2) ** 2 / n + 1e-9)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, pw, pb = w, b, w, b
    for t in range(steps):
        d = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y
        w = vw - rate * (x.T @ d) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b = vb - rate * d.mean()
        vw, vb = w + t / (t + 3) * (w - pw), b + t / (t + 3) * (b - pb)
        pw, pb = w, b
    return w, b


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH, l1: float = L1, seed: int = 11) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        base = np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9)
        return RuleEnsemble([], np.zeros(0), float(np.log(base / (1 - base))))
    rng = np.random.default_rng(seed)
    rules: dict[tuple, None] = {}
    for _ in range(n_trees):
        at = rng.integers(0, len(y), min(len(y), 2048))
        some = np.sort(rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False))
        for p in paths(grow(x[at], y[at], depth, max(2, len(at) // 200), some)):
            rules.setdefault(tuple((f, op, float(f"{c:.6g}")) for f, op, c in p))
    every = RuleEnsemble(list(rules), np.zeros(len(rules)), 0.0)
    hold = every.holds(x)
    use = [k for k in range(len(every.rules)) if 0 < hold[:, k].sum() < len(y)]
    w, b = lasso_logistic(hold[:, use], y.astype(float), l1)
    live = [(use[k], w[k]) for k in range(len(use)) if abs(w[k]) > 1e-6]
    return RuleEnsemble([every.rules[k] for k, _ in live], np.array([v for _, v in live]), b)


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> RuleEnsemble:
    # at most max_train rows of len(FEATURES) numbers reach the driver
    rows = statistics(training_rows(docs, labels, "quality", FOLDS, HELD_OUT, max_train)).select("y", *FEATURES).toPandas().sort_values(["y", *FEATURES])
    return fit(rows[FEATURES].to_numpy(dtype=float), rows["y"].to_numpy())


def score_documents(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    return statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
