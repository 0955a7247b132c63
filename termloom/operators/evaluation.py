"""Scoring of predictions against gold: set metrics, pair scores, assignments and the detail table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import assignment

ALPHA, BETA = 0.85, 0.15


def prf_columns(tp: str, fp: str, fn: str) -> list[Column]:
    """precision, recall and f1 columns; 0 on empty denominators."""
    a, b, c = F.col(tp), F.col(fp), F.col(fn)
    p = F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    r = F.when(a + c > 0, a / (a + c)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def set_metrics(gold: DataFrame, pred: DataFrame, doc: str, value: str) -> DataFrame:
    """Per document of gold or pred: tp, fp, fn of distinct values, with precision, recall and f1."""
    g = gold.select(doc, value).distinct().withColumn("g", F.lit(1))
    p = pred.select(doc, value).distinct().withColumn("p", F.lit(1))
    both = g.join(p, [doc, value], "full")
    counts = both.groupBy(doc).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    return counts.select(doc, "tp", "fp", "fn", *prf_columns("tp", "fp", "fn"))


def micro(per_document: DataFrame) -> DataFrame:
    """One row: the counts summed, with precision, recall and f1."""
    s = per_document.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return s.select("tp", "fp", "fn", *prf_columns("tp", "fp", "fn"))


def exact_sets(gold: DataFrame, pred: DataFrame, doc: str, value: str) -> DataFrame:
    """Per document whether both sides hold the same set, and whether they share a value."""
    lists = lambda df, name: df.groupBy(doc).agg(F.array_sort(F.collect_set(value)).alias(name))
    both = lists(gold, "g").join(lists(pred, "p"), doc, "full")
    empty = F.array().cast("array<bigint>")
    g, p = F.coalesce("g", empty), F.coalesce("p", empty)
    return both.select(doc, (g == p).alias("exact"), F.arrays_overlap(g, p).alias("relaxed"))


def surplus(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, surplus): how often pred repeats a key beyond gold, where it does."""
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gold"))
    p = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    s = F.greatest(F.col("n_pred") - F.coalesce("n_gold", F.lit(0)), F.lit(0))
    return p.join(g, keys, "left").select(*keys, s.alias("surplus")).filter("surplus > 0")


def consume_equal(gold: DataFrame, pred: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, gold order, pred order): equal keys paired one to one in item order."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = gold.select(*keys, F.col(order).alias("gold_item"), F.row_number().over(w).alias("nth"))
    p = pred.select(*keys, F.col(order).alias("pred_item"), F.row_number().over(w).alias("nth"))
    return g.join(p, [*keys, "nth"]).select(*keys, "gold_item", "pred_item")


def pair_scores(gold: DataFrame, pred: DataFrame, doc: str, g: str, p: str, semantic: Column | None = None, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """All pairs within a document with their token Jaccard, and alpha * semantic + beta * jaccard (jaccard alone if no
    semantic column is given)."""
    joined = gold.join(pred, doc)
    jac = T.jaccard(T.token_set(F.col(g)), T.token_set(F.col(p)))
    return joined.withColumn("jaccard", jac).withColumn("score", F.col("jaccard") if semantic is None else alpha * semantic + beta * F.col("jaccard"))


def assign(scores: DataFrame, doc: str, gold: str, pred: str, score: str, method: str = "greedy", min_score: float = 0.0) -> DataFrame:
    """(doc, gold, pred, score): one-to-one pairs of each document, greedy or optimal. Scores hold every pair of a
    document. Documents come sorted and are solved a batch at a time; only a document's own pairs must fit one."""
    solve: Callable = {"greedy": assignment.greedy_pairs, "optimal": assignment.optimal_pairs}[method]

    def solved(batch):
        codes = lambda k: np.unique(batch.column(k).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        d, g, p = codes(0), codes(1), codes(2)
        numbered = lambda x: np.unique(d * (int(x.max()) + 1) + x, return_inverse=True)[1]
        return batch.take(np.sort(solve(d, numbered(g), numbered(p), batch.column(3).to_numpy(), min_score)))

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            docs = whole.column(0).to_numpy(zero_copy_only=False)
            ended = np.flatnonzero(docs[1:] != docs[:-1])
            cut = int(ended[-1]) + 1 if len(ended) else 0  # the last document may go on in the next batch
            if cut:
                yield solved(whole.slice(0, cut))
            held = whole.slice(cut)
        if held is not None:
            yield solved(held)

    kinds = dict(scores.dtypes)
    rows = scores.select(doc, gold, pred, F.col(score).cast("double").alias(score)).repartition(doc).sortWithinPartitions(doc, gold, pred)
    return rows.mapInArrow(run, f"{doc} {kinds[doc]}, {gold} {kinds[gold]}, {pred} {kinds[pred]}, {score} double")


def embedding_match(scores: DataFrame, doc: str, gold: str, pred: str, similarity: str, threshold: float = 0.9) -> DataFrame:
    """(doc, gold, pred, similarity): predictions by largest similarity, each offered only its nearest gold; ties go to
    the smaller gold, then prediction. As a gold goes to the most similar of those it is nearest to, two aggregations
    do, and a document's pairs need not fit one task."""
    nearest = F.min_by(F.struct(gold, similarity), F.struct(-F.col(similarity), gold)).alias("n__")
    offered = scores.groupBy(doc, pred).agg(nearest).select(doc, pred, "n__.*").filter(F.col(similarity) >= threshold)
    best = F.min_by(F.struct(pred, similarity), F.struct(-F.col(similarity), pred)).alias("b__")
    return offered.groupBy(doc, gold).agg(best).select(doc, gold, "b__.*")


#: Predictions of a document compared in one task, numbers in a block of cosines, and the error that the fast cosines of
#: single precision may have; what comes so near to the largest is computed again in double precision.
NEAR_PART, NEAR_CELLS, NEAR_SLACK = 32_768, 1 << 22, 2e-5


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of V.cosine, so that equal vectors have equal cosines."""
    dot, na, nb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k].astype(float), b[:, k].astype(float)
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    n = np.sqrt(na) * np.sqrt(nb)
    return np.where(n == 0, 0.0, dot / np.where(n == 0, 1.0, n))


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each different vector, and the vectors; those with a number that is not finite are left out."""
    fine = np.isfinite(vectors).all(axis=1)
    ids, vectors = ids[fine], vectors[fine]
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order]).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel().tolist()
    seen: dict[bytes, int] = {}
    for at, row in zip(order.tolist(), rows, strict=True):
        seen.setdefault(row, at)
    first = np.fromiter(seen.values(), np.int64, len(seen))
    return ids[first], vectors[first]


class _Nearest:
    """The nearest gold vector of each of a part's predictions, gold coming in batches; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = _distinct(ids, vectors)
        self.unit = self._units(self.vectors)
        self.best, self.gold = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids), np.int64)

    @staticmethod
    def _units(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v.astype(float), axis=1)
        return (v / np.where(n == 0, 1.0, n)[:, None]).astype(np.float32)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        ids, vectors = _distinct(ids, vectors)
        if not len(ids):
            return
        unit = self._units(vectors)
        step = max(1, NEAR_CELLS // len(ids))
        for lo in range(0, len(self.ids), step):
            fast = self.unit[lo : lo + step] @ unit.T
            floor = np.maximum(fast.max(axis=1), self.best[lo : lo + step]).astype(np.float32) - np.float32(NEAR_SLACK)
            at = np.flatnonzero(fast >= floor[:, None])
            for k in range(0, len(at), 1 << 18):
                i, j = np.divmod(at[k : k + (1 << 18)], len(ids))
                exact = _cosines(self.vectors[lo + i], vectors[j])
                order = np.lexsort((ids[j], -exact, i))
                order = order[np.r_[True, i[order][1:] != i[order][:-1]]]
                i, gold, exact = lo + i[order], ids[j[order]], exact[order]
                better = (exact > self.best[i]) | ((exact == self.best[i]) & (gold < self.gold[i]))
                self.best[i[better]], self.gold[i[better]] = exact[better], gold[better]


def match_vectors(gold: DataFrame, pred: DataFrame, doc: str, g: str, p: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """embedding_match() of the cosines of all gold and predicted vectors of a document, as (doc, g, p, similarity).

    Predictions are dealt to parts of about NEAR_PART; a part meets all gold vectors of its document, which stream by, in
    blocks of one matrix product each. No pair leaves its task: a part gives one row per different prediction. Of equal
    vectors the smallest id stands for all, as it wins every tie. Rows without a vector match nothing."""
    some = lambda df: df.filter(F.col(vector).isNotNull() & F.col(doc).isNotNull())
    gold, pred = some(gold), some(pred)
    parts = pred.groupBy(doc).agg(F.expr(f"cast(ceil(count(1) / {NEAR_PART}) as int)").alias("n__"))
    mine = pred.join(parts, doc).select(doc, F.expr(f"cast(pmod(xxhash64({p}), n__) as int)").alias("part__"), F.lit(0).alias("side__"), F.col(p).cast("long").alias("id__"), F.col(vector).alias("v__"))
    theirs = gold.join(parts, doc).select(doc, F.explode(F.sequence(F.lit(0), F.col("n__") - 1)).alias("part__"), F.lit(1).alias("side__"), F.col(g).cast("long").alias("id__"), F.col(vector).alias("v__"))

    def run(batches):
        import pyarrow as pa

        def ended():
            ok = near.best >= threshold
            n = int(ok.sum())
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, kind), pa.array(near.gold[ok]), pa.array(near.ids[ok]), pa.array(near.best[ok])], [doc, g, p, "similarity"])

        at = near = kind = None
        held: list = []
        for batch in batches:
            kind = batch.schema.field(0).type
            docs, part, side = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ids = batch.column(3).to_numpy()
            for lo, hi in _runs(docs, part, side):
                v = batch.column(4).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if (docs[lo], part[lo]) != at:
                    if near is not None:
                        yield from ended()
                    at, near, held = (docs[lo], part[lo]), None, []
                if side[lo] == 0:
                    held.append((ids[lo:hi], v))
                elif held or near is not None:
                    if near is None:
                        near, held = _Nearest(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                    near.offer(ids[lo:hi], v)
        if near is not None:
            yield from ended()

    kinds = dict(gold.dtypes)
    rows = mine.unionByName(theirs).repartition(doc, "part__").sortWithinPartitions(doc, "part__", "side__")
    offered = rows.mapInArrow(run, f"{doc} {kinds[doc]}, {g} long, {p} long, similarity double")
    best = F.min_by(F.struct(p, "similarity"), F.struct(-F.col("similarity"), p)).alias("b__")
    return offered.groupBy(doc, g).agg(best).select(doc, g, "b__.*")


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of equal keys."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]) - 1, dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    cut = np.r_[0, np.flatnonzero(new) + 1, len(keys[0])].tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def detail(gold: DataFrame, pred: DataFrame, matched: DataFrame, doc: str, g: str, p: str) -> DataFrame:
    """One row per outcome: matched pairs, gold set aside (ignored), gold and predictions without a partner, and
    predictions of documents without gold. gold has a boolean `ignored`."""
    pairs = matched.join(gold.select(doc, g, "ignored"), [doc, g])
    found = pairs.select(doc, g, p, F.when(F.col("ignored"), "matched_ignored_gold").otherwise("matched").alias("outcome"))
    lost = gold.join(matched.select(doc, g), [doc, g], "left_anti").select(doc, g, F.lit(None).cast("long").alias(p), F.when(F.col("ignored"), "ignored_gold_unmatched").otherwise("unmatched_gold").alias("outcome"))
    spare = pred.join(matched.select(doc, p), [doc, p], "left_anti")
    known = gold.select(doc).distinct().withColumn("known", F.lit(True))
    spare = spare.join(known, doc, "left").select(doc, F.lit(None).cast("long").alias(g), p, F.when(F.col("known"), "unmatched_pred").otherwise("unmatched_pred_no_gold").alias("outcome"))
    return found.unionByName(lost).unionByName(spare)


def outcome_counts(outcomes: DataFrame, gold_ids: DataFrame, pred_ids: DataFrame, doc: str, g: str, p: str, decoupled: bool = True, shared: str | None = None) -> DataFrame:
    """detail()'s rows with counts on three levels: ex_ (a statement found), set_ (its ids all equal) and id_ (single
    ids), each tp, fp and fn.

    Rows of ignored gold count nowhere, and the prediction that such a row took is spent. Without a partner, a row
    counts as found or lost statement; on the other two levels only if not decoupled. gold_ids and pred_ids have (doc,
    g or p, ids as an array); shared names a column of outcomes with the credit of a pair in place of its common ids."""
    none = F.array().cast(dict(gold_ids.dtypes)["ids"])
    both = outcomes.join(gold_ids.select(doc, g, F.col("ids").alias("g__")), [doc, g], "left").join(pred_ids.select(doc, p, F.col("ids").alias("p__")), [doc, p], "left")
    gi, pi = F.array_distinct(F.coalesce("g__", none)), F.array_distinct(F.coalesce("p__", none))
    hit, lost, spare = F.col("outcome") == "matched", F.col("outcome") == "unmatched_gold", F.col("outcome").isin("unmatched_pred", "unmatched_pred_no_gold")
    credit = F.size(F.array_intersect(gi, pi)).cast("double") if shared is None else F.coalesce(F.col(shared), F.lit(0.0))
    equal = (F.size(F.array_except(gi, pi)) == 0) & (F.size(F.array_except(pi, gi)) == 0)
    alone = F.lit(0 if decoupled else 1)
    n = lambda c: F.when(c, 1).otherwise(0)
    counts = {
        "ex_tp": n(hit), "ex_fp": n(spare), "ex_fn": n(lost),
        "set_tp": n(hit & equal), "set_fp": n(hit & ~equal) + n(spare) * alone, "set_fn": n(hit & ~equal) + n(lost) * alone,
        "id_tp": F.when(hit, credit).otherwise(0.0),
        "id_fp": F.when(hit, F.size(pi) - credit).when(spare, F.size(pi) * alone).otherwise(0.0),
        "id_fn": F.when(hit, F.size(gi) - credit).when(lost, F.size(gi) * alone).otherwise(0.0),
    }
    return both.select(doc, g, p, "outcome", *(c.alias(k) for k, c in counts.items()))


def levels(counts: DataFrame) -> DataFrame:
    """(level, tp, fp, fn, precision, recall, f1) of the three levels of outcome_counts: three rows."""
    sums = counts.agg(*(F.coalesce(F.sum(f"{x}_{y}"), F.lit(0)).cast("double").alias(f"{x}_{y}") for x in ("ex", "set", "id") for y in ("tp", "fp", "fn")))
    rows = F.array(*(F.struct(F.lit(name).alias("level"), *(F.col(f"{x}_{y}").alias(y) for y in ("tp", "fp", "fn"))) for x, name in (("ex", "extraction"), ("set", "exact_set"), ("id", "concept"))))
    return sums.select(F.explode(rows).alias("r")).select("r.*").select("level", "tp", "fp", "fn", *prf_columns("tp", "fp", "fn"))


def reserve_then_assign(gold: DataFrame, pred: DataFrame, doc: str, g: str, p: str, key: str, ids: str, min_score: float = 0.0, method: str = "greedy") -> DataFrame:
    """(doc, g, p, score, method): equal keys are reserved for each other in item order, blank keys never; what is left
    of both sides is assigned by the Jaccard of its ids. gold has (doc, g, key, ids), pred (doc, p, key, ids)."""
    keyed = lambda df, x: df.filter(F.col(key) != "").select(doc, key, F.col(x).alias("item"))
    fixed = consume_equal(keyed(gold, g), keyed(pred, p), [doc, key], "item").select(doc, F.col("gold_item").alias(g), F.col("pred_item").alias(p))
    rest_g, rest_p = gold.join(fixed.select(doc, g), [doc, g], "left_anti"), pred.join(fixed.select(doc, p), [doc, p], "left_anti")
    pairs = rest_g.select(doc, g, F.col(ids).alias("a__")).join(rest_p.select(doc, p, F.col(ids).alias("b__")), doc)
    scored = pairs.select(doc, g, p, T.jaccard(F.col("a__"), F.col("b__")).alias("score"))
    rest = assign(scored, doc, g, p, "score", method, min_score)
    return fixed.withColumn("score", F.lit(1.0)).withColumn("method", F.lit("reserved")).unionByName(rest.withColumn("method", F.lit(method)))


def nearest_unused(pairs: DataFrame, doc: str, g: str, p: str, similarity: str, overlap: str, min_overlap: int = 1) -> DataFrame:
    """(doc, g, p, method): each document's gold rows in order take the most similar prediction not yet taken, or, where
    no similarity is known, the unused one with most common ids, at least min_overlap; ties go to the smaller p. Each row
    depends on those before it, so a document is one group; it holds the pairs of one document only."""

    def run(frame):
        import pandas as pd

        used, out = set(), []
        for item, rows in frame.sort_values([g, p]).groupby(g, sort=True):
            rows = rows[~rows[p].isin(used)]
            near = rows.dropna(subset=[similarity]).sort_values([similarity, p], ascending=[False, True])
            best, how = (near, "semantic") if len(near) else (rows[rows[overlap] >= min_overlap].sort_values([overlap, p], ascending=[False, True]), "overlap")
            if len(best):
                used.add(best[p].iloc[0])
                out.append((frame[doc].iloc[0], item, best[p].iloc[0], how))
        return pd.DataFrame(out, columns=[doc, g, p, "method"])

    kinds = dict(pairs.dtypes)
    return pairs.select(doc, g, p, similarity, overlap).groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, {g} {kinds[g]}, {p} {kinds[p]}, method string")


def canonical_sets(gold: DataFrame, pred: DataFrame, doc: str, text: str) -> DataFrame:
    """set_metrics of the canonical statements of both sides, blank ones and 'nan' left out, with the sorted keys that
    only one side has."""
    keyed = lambda df: df.filter((F.trim(F.coalesce(text, F.lit(""))) != "") & (F.lower(F.col(text)) != "nan")).select(doc, T.canonical_statement(F.col(text)).alias("key")).distinct()
    a, b = keyed(gold), keyed(pred)
    lists = lambda x, y, name: x.join(y, [doc, "key"], "left_anti").groupBy(doc).agg(F.array_sort(F.collect_set("key")).alias(name))
    none = F.array().cast("array<string>")
    joined = set_metrics(a, b, doc, "key").join(lists(b, a, "fp_keys"), doc, "left").join(lists(a, b, "fn_keys"), doc, "left")
    return joined.withColumns({"fp_keys": F.coalesce("fp_keys", none), "fn_keys": F.coalesce("fn_keys", none)})


def grid(runs: dict[str, DataFrame], score: str = "f1") -> DataFrame:
    """(run_tag, score): one row of metrics per run as one table, in the order of the tags."""
    out = None
    for tag, frame in runs.items():
        part = frame.select(F.lit(tag).alias("run_tag"), F.col(score).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("run_tag")


def spans_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two half-open spans share a character."""
    return (start_a < end_b) & (start_b < end_a)
