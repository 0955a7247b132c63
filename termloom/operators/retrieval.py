"""Retrieval: BM25 over postings, tiered lexical scores, exact vector search, rank fusion, hybrid search.

All operators take batches of queries. Postings join on the token, so a query reads only the postings of its words;
document vectors are scanned once against a block of queries whose size is checked, more queries go in more blocks.
BM25 is the documented form: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg)).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import unit
from ..session import cut_lineage

K1, B = 1.2, 0.75
RANK_BIAS = 60
#: Boosts of the lexical tiers.
BOOST = {"exact": 5.0, "phrase": 3.0, "shingle": 2.0, "all_terms": 0.6}
QUERY_BLOCK = 2048


def postings(docs: DataFrame, ident: str, tokens) -> DataFrame:
    """(ident, token, tf, dl) of every document's tokens."""
    t = docs.select(F.col(ident), tokens.alias("ts")).withColumn("dl", F.size("ts"))
    # the outer form: a plain explode pushes a filter on its array below the projection and tokenises twice
    return t.select(ident, "dl", F.explode_outer("ts").alias("token")).filter("token is not null").groupBy(ident, "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


class Postings:
    """The postings of some queries' tokens and the statistics of the whole table, from one pass over the texts.

    Each text is cut into tokens once; tokens of no query are dropped where they arise, so only those of the queries are
    shuffled. Each document keeps one row without a token that carries its length. Written once, they serve any number of
    scorings."""

    def __init__(self, docs: DataFrame, ident: str, tokens, words: DataFrame):
        used = words.select(F.col("token").alias("used__")).distinct()
        t = docs.select(F.col(ident), tokens.alias("ts")).withColumn("dl", F.coalesce(F.size("ts"), F.lit(0)))
        each = t.select(ident, "dl", F.posexplode_outer("ts").alias("pos", "token"))
        hits = each.join(used, F.col("token") == F.col("used__"), "left").filter("used__ is not null or pos is null or pos = 0")
        # a document's first row counts it, whether or not its token is of a query
        first = F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)
        rows = hits.groupBy(ident, "dl", F.col("used__").alias("token")).agg(F.count(F.lit(1)).alias("tf"), F.max(first).alias("head"))
        kept = cut_lineage(rows)
        self.rows = kept.filter("token is not null").drop("head")
        self.stats = kept.agg(F.sum("head").alias("n_docs"), (F.sum(F.col("head") * F.col("dl")) / F.sum("head")).alias("avg_dl"))


def bm25_scores(queries: DataFrame, index: Postings, query: str, doc: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score) of every document that shares a token. queries has distinct (query, token)."""
    df = index.rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(index.stats))  # stats is one row
    weighted = df.select("token", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hit = queries.join(weighted, "token").join(index.rows, "token")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return hit.groupBy(query, doc).agg(F.sum(part).alias("score"))


def query_words(queries: DataFrame, query: str, query_text: str, analyse: Callable = T.analysed_tokens) -> DataFrame:
    """Distinct (query, token)."""
    return queries.select(query, F.explode(F.array_distinct(analyse(F.col(query_text)))).alias("token"))


def bm25_top(queries: DataFrame, docs: DataFrame, query: str, query_text: str, doc: str, doc_text: str, k: int, k1: float = K1, b: float = B, index: Postings | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best documents of every query; ties go to the smaller id. An index of the same
    queries and documents is used as it is."""
    words = query_words(queries, query, query_text)
    index = index or Postings(docs, doc, T.analysed_tokens(F.col(doc_text)), words)
    return ranked(bm25_scores(words, index, query, doc, k1, b), query, doc, k)


def ranked(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), doc)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tiered(queries: DataFrame, docs: DataFrame, query: str, query_text: str, doc: str, doc_text: str, k: int, tag: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Sum of boosted tiers per document: equal text, phrase, shingles and single tokens; at least one must match. With
    tags, only documents whose tag is one of them; statistics are of the documents that are searched.

    A query of one token has no shingle: its phrase candidates are the documents that hold the token."""
    if tags:
        docs = docs.filter(F.col(tag).isin(*tags))
    q_tokens = T.analysed_tokens(F.col(query_text))
    words = query_words(queries, query, query_text)
    base = cut_lineage(bm25_scores(words, Postings(docs, doc, T.analysed_tokens(F.col(doc_text)), words), query, doc))
    # tokens become a column first: inside a lambda the expression would be evaluated for every position
    docs = docs.withColumn("tokens__", T.analysed_tokens(F.col(doc_text)))
    pairs = queries.select(query, F.explode(F.array_distinct(T.shingles(q_tokens))).alias("token"))
    shingle = cut_lineage(bm25_scores(pairs, Postings(docs, doc, T.shingles(F.col("tokens__")), pairs), query, doc))
    joined = F.concat(F.lit(" "), F.array_join("tokens__", " "), F.lit(" "))
    # a phrase can only be where all its shingles are, or its one token
    single = base.join(queries.filter(F.size(q_tokens) == 1).select(query), query, "left_semi")
    near = shingle.select(query, doc).unionByName(single.select(query, doc)).join(queries.select(query, F.array_join(q_tokens, " ").alias("phrase")), query).join(docs.select(doc, joined.alias("body")), doc)
    phrase = near.filter(F.col("body").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select(query, doc, F.lit(BOOST["phrase"]).alias("score"))
    exact = queries.select(query, F.lower(F.trim(query_text)).alias("t")).join(docs.select(doc, F.lower(F.trim(doc_text)).alias("t")), "t").select(query, doc, F.lit(BOOST["exact"]).alias("score"))
    boosted = lambda df, tier: df.withColumn("score", F.col("score") * BOOST[tier])
    every = boosted(base, "all_terms").unionByName(boosted(shingle, "shingle")).unionByName(phrase).unionByName(exact)
    return ranked(every.groupBy(query, doc).agg(F.sum("score").alias("score")), query, doc, k)


def knn(queries: DataFrame, vectors: DataFrame, query: str, ident: str, vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """(query, ident, score, rank): the k nearest vectors by inner product of unit vectors, exactly.

    Each task keeps only its own k best per query of a block; the blocks of queries are broadcast, at most QUERY_BLOCK
    vectors each, and further blocks scan the vectors again.
    """
    rows = queries.select(query, vector).orderBy(query)
    n = rows.count()
    out = None
    numbered = rows.withColumn("block__", F.pmod(F.xxhash64(query), F.lit(max(1, -(-n // QUERY_BLOCK)))))
    for block in range(max(1, -(-n // QUERY_BLOCK))):
        part = numbered.filter(F.col("block__") == block).select(query, vector).toArrow()  # about QUERY_BLOCK vectors
        if not part.num_rows:
            continue
        ids = np.asarray(part.column(0))
        mat = _unit(np.stack(part.column(1).to_numpy(zero_copy_only=False)))

        def run(batches: Iterator, ids=ids, mat=mat) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.asarray(batch.column(0))
                sims = np.round(mat @ _unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False))).T, 9)
                if exclude_self:
                    sims[ids[:, None] == own[None, :]] = -np.inf
                take = np.lexsort((np.broadcast_to(own, sims.shape), -sims), axis=1)[:, :k]
                s = np.take_along_axis(sims, take, axis=1)
                live = np.isfinite(s)
                q = np.broadcast_to(ids[:, None], take.shape)[live]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[take][live]), pa.array(s[live])], [query, ident, "score"])

        got = vectors.select(ident, vector).mapInArrow(run, f"{query} long, {ident} long, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{query} long, {ident} long, score double, rank int")
    return ranked(out, query, ident, k)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def dense_candidates(queries: DataFrame, vectors: DataFrame, query: str, ident: str, concept: str, vector: str, k: int, k_vectors: int | None = None) -> DataFrame:
    """(query, concept, score, rank): the best vectors pooled to their concept by the largest score."""
    hits = knn(queries, vectors, query, ident, vector, k_vectors or 5 * k, exclude_self=True)
    named = hits.join(vectors.select(ident, concept), ident)
    return ranked(named.groupBy(query, concept).agg(F.max("score").alias("score")), query, concept, k)


def similar_above(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """(key, score): rows of left whose nearest vector of right reaches the threshold."""
    best = knn(left, right.withColumnRenamed(key, "other__"), key, "other__", vector, 1)
    return best.filter(F.col("score") >= threshold).select(key, F.col("other__").alias("nearest"), "score")


def rrf(lists: list[tuple[str, DataFrame]], query: str, doc: str, k: int, bias: int = RANK_BIAS) -> DataFrame:
    """(query, doc, fused, origin, rank): reciprocal ranks summed over the lists (query, doc, rank); ties go to the
    list given first, then to its rank, then to the id."""
    union = None
    for place, (name, frame) in enumerate(lists):
        part = frame.select(query, doc, F.col("rank").cast("int").alias("r"), F.lit(place).alias("place"), F.lit(name).alias("name"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy(query, doc).agg(
        F.sum(1.0 / (bias + F.col("r"))).alias("fused"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place", "name"))), lambda s: s["name"]), "+").alias("origin"),
        F.min(F.struct("place", "r")).alias("first"),
    )
    w = Window.partitionBy(query).orderBy(F.desc(F.round("fused", 12)), "first", doc)
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("first")


def rerank(hits: DataFrame, query: str, doc: str, query_text: str, doc_text: str, score_pairs: Callable, k: int) -> DataFrame:
    """hits with rerank_score from an injected function of two lists of texts, the k best per query."""

    @F.pandas_udf("double")
    def score(a, b):
        import pandas as pd

        return pd.Series(score_pairs(a.tolist(), b.tolist()), dtype=float)

    w = Window.partitionBy(query).orderBy(F.desc("rerank_score"), doc)
    return hits.withColumn("rerank_score", score(query_text, doc_text)).withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= k)


def encode(docs: DataFrame, text: str, out: str, encoder: Callable) -> DataFrame:
    """docs with a vector column from an injected encoder of a list of texts."""

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        return pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in encoder([t or "" for t in texts])])

    return docs.withColumn(out, run(text))


def hashing_encoder(size: int = 64) -> Callable:
    """A deterministic stand-in for a sentence encoder: signed hashed words, unit length."""

    def run(texts: list[str]) -> list[np.ndarray]:
        import re
        import zlib

        out = []
        for t in texts:
            v = np.zeros(size)
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 1 << 20 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return out

    return run


def hybrid(queries: DataFrame, docs: DataFrame, query: str, query_text: str, doc: str, doc_text: str, dense: DataFrame, k_lexical: int = 50, k: int = 20) -> DataFrame:
    """Lexical top lists fused with given dense lists (query, doc, rank), dense first."""
    lexical = bm25_top(queries, docs, query, query_text, doc, doc_text, k_lexical)
    return rrf([("dense", dense), ("bm25", lexical)], query, doc, k)


def full_hybrid(queries: DataFrame, concepts: DataFrame, vectors: DataFrame, query: str, query_text: str, query_vector: str, concept: str, label: str, vector: str, score_pairs: Callable, paths: DataFrame | None = None, tags: list[str] | None = None, k_dense: int = 50, k_lexical: int = 50, k_fused: int = 20, k: int = 10) -> DataFrame:
    """(query, concept, label, fused, origin, rerank_score, rank, path): the whole search for a batch of queries.

    Dense candidates pooled to concepts and tiered lexical ones are fused by reciprocal rank; the fused get their labels
    and are scored again by pairs of texts; the k best get their path, if paths (concept, path) are given. concepts has
    (concept, label, tag), vectors (vec_id, concept, vector), queries (query, text, vector)."""
    if tags:
        concepts = concepts.filter(F.col("tag").isin(*tags))
        vectors = vectors.join(concepts.select(concept), concept, "left_semi")
    dense = knn(queries, vectors, query, "vec_id", query_vector, 5 * k_dense) if query_vector == vector else knn(queries.withColumnRenamed(query_vector, vector), vectors, query, "vec_id", vector, 5 * k_dense)
    named = dense.join(vectors.select("vec_id", concept), "vec_id").groupBy(query, concept).agg(F.max("score").alias("score"))
    lexical = tiered(queries, concepts, query, query_text, concept, label, k_lexical)
    fused = rrf([("dense", ranked(named, query, concept, k_dense)), ("lexical", lexical)], query, concept, k_fused).drop("rank")
    texts = fused.join(concepts.select(concept, label), concept).join(queries.select(query, F.col(query_text).alias("q__")), query)
    out = rerank(texts, query, concept, "q__", label, score_pairs, k).drop("q__").withColumnRenamed("rerank", "rank")
    return out if paths is None else out.join(paths, concept, "left")


def map_terms(items: DataFrame, ident: list[str], terms: dict[str, str], search: Callable[[DataFrame], DataFrame], concept: str, label: str) -> DataFrame:
    """items' ident with <name>_terms, an array of struct(id, label) in rank order, for each of terms (name: column);
    [] for a blank text. All texts of all items are one batch for search, which gets distinct (query, text) and gives
    (query, concept, label, rank); equal texts are searched once."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.trim(F.coalesce(F.col(c), F.lit(""))).alias("text")) for n, c in terms.items())))
    long_ = cut_lineage(items.select(*ident, pairs.alias("p")).select(*ident, "p.*"))
    texts = long_.select("text").filter("text <> ''").distinct().select(F.xxhash64("text").alias("query"), "text")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(concept).alias("id"), F.col(label).alias("label")))), lambda s: F.struct(s["id"].alias("id"), s["label"].alias("label")))
    found = search(texts).groupBy("query").agg(lists.alias("hits"))
    got = long_.withColumn("query", F.xxhash64("text")).join(found, "query", "left")
    wide = got.groupBy(*ident).agg(*(F.first(F.when((F.col("name") == n) & (F.col("text") != ""), F.col("hits")), ignorenulls=True).alias(f"{n}_terms") for n in terms))
    kinds = dict(wide.dtypes)
    return wide.select(*ident, *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in (f"{n}_terms" for n in terms)))


def save_vectors(vectors: DataFrame, path: str, ident: str, vector: str, buckets: int = 64) -> None:
    """Unit vectors as Parquet, ids as BIGINT (an id that is none raises an error), in files by a hash of the id."""
    number = F.col(ident).cast("string").cast("bigint").alias(ident)
    rows = vectors.select(number, *(c for c in vectors.columns if c not in (ident, vector)), unit(F.col(vector)).alias(vector))
    rows.withColumn("bucket", F.pmod(F.xxhash64(ident), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


_LOADED: dict[tuple, DataFrame] = {}


def load_vectors(spark, path: str) -> DataFrame:
    """The vectors written to path; a path is opened once a session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _LOADED:
        _LOADED[key] = spark.read.parquet(path).drop("bucket")
    return _LOADED[key]


def candidate_block(label: str, score: str, rank: str, group: str, hits: DataFrame, n: int = 10, path: str | None = None) -> DataFrame:
    """(group, block): the first n hits as numbered lines with the score to three places, and the path where given."""
    line = F.format_string("%d. %s (%.3f)", F.col(rank), F.col(label), F.col(score))
    if path:
        line = F.concat(line, F.when(F.coalesce(F.col(path), F.lit("")) != "", F.concat(F.lit(" | "), F.col(path))).otherwise(""))
    top = hits.filter(F.col(rank) <= n)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), line.alias("line")))), lambda s: s["line"]), "\n").alias("block"))
