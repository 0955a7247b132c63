"""Lexical, vector and hybrid retrieval: benchmark items are queries, documents and embeddings are searched.

Vector searches take every vector whose id is divisible by 50 as a query, against all vectors. In hybrid_search the
vector of an item is the one of equal id, and a document's the one of its id."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as rt
from ..session import shared_root, table

QUERIES, ORACLES = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_FOLD = "translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_BASE = rf"""
dt AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS ts FROM documents),
qt AS (SELECT item_id, regexp_extract_all({_FOLD}, '[\p{{L}}\p{{N}}]+') AS ts FROM benchmark)"""


def _scores(name: str, dt: str, qt: str, k1: float, b: float) -> str:
    """CTEs that end in <name>(item_id, doc_id, score)."""
    return f"""
{name}_n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {dt}),
{name}_p AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM {dt}) GROUP BY 1, 2, 3),
{name}_f AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_q AS (SELECT DISTINCT item_id, unnest(ts) AS token FROM {qt}),
{name} AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
  FROM {name}_q JOIN {name}_f USING (token) JOIN {name}_p USING (token), {name}_n GROUP BY 1, 2)"""


def _top(source: str, k: int, q: str = "item_id", c: str = "doc_id", s: str = "score") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY round({s}, 9) DESC, {c}) AS rank FROM {source} QUALIFY rank <= {k}"


def _bm25(spark, d, k, b=rt.B):
    return rt.bm25_top(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", k, b=b)


@plan(f"WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.75)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_top('s', 10)})")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@plan(f"WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.5)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_top('s', 5)})")
def bm25_tuned_b(spark, d):
    return _bm25(spark, d, 5, b=0.5).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_GRAMS = "list_transform(list_concat(list_transform(range(len(ts) - 1), lambda i: list_slice(ts, i + 1, i + 2)), list_transform(range(len(ts) - 2), lambda i: list_slice(ts, i + 1, i + 3))), lambda g: array_to_string(g, ' '))"


@plan(f"""WITH {_BASE}, ds AS (SELECT doc_id, {_GRAMS} AS ts FROM dt), qs AS (SELECT item_id, {_GRAMS} AS ts FROM qt),
{_scores('a', 'dt', 'qt', 1.2, 0.75)}, {_scores('g', 'ds', 'qs', 1.2, 0.75)},
near AS (SELECT item_id, doc_id FROM g UNION ALL SELECT a.item_id, a.doc_id FROM a JOIN qt ON a.item_id = qt.item_id WHERE len(qt.ts) = 1),
ph AS (SELECT g.item_id, g.doc_id FROM near g JOIN dt ON g.doc_id = dt.doc_id JOIN qt ON g.item_id = qt.item_id
       WHERE contains(' ' || array_to_string(dt.ts, ' ') || ' ', ' ' || array_to_string(qt.ts, ' ') || ' ')),
ex AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON lower(trim(b.text)) = lower(trim(d.text))),
u AS (SELECT item_id, doc_id, score * 0.6 AS score FROM a UNION ALL SELECT item_id, doc_id, score * 2.0 FROM g
      UNION ALL SELECT item_id, doc_id, 3.0 FROM ph UNION ALL SELECT item_id, doc_id, 5.0 FROM ex),
s AS (SELECT item_id, doc_id, sum(score) AS score FROM u GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_top('s', 10)})""")
def tiered_lexical(spark, d):
    r = rt.tiered(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", 10)
    return r.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
_SIMS = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_dot_product(q.v, e.v), 9) AS score FROM {_UNIT} q, {_UNIT} e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e


@plan(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({_top(f'({_SIMS})', 10, 'query_id', 'vec_id')})")
def knn_topk(spark, d):
    q, e = _vectors(spark, d)
    return rt.knn(q, e, "query_id", "vec_id", "embedding", 10, exclude_self=True).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@plan(f"""WITH h AS (SELECT query_id, label, score FROM ({_top(f'({_SIMS})', 25, 'query_id', 'vec_id')})),
m AS (SELECT query_id, label, max(score) AS score FROM h GROUP BY 1, 2)
SELECT query_id, label, round(score, 6) AS score, rank FROM ({_top('m', 5, 'query_id', 'label')})""")
def dense_candidates(spark, d):
    q, e = _vectors(spark, d)
    return rt.dense_candidates(q, e, "query_id", "vec_id", "label", "embedding", 5).select("query_id", "label", F.round("score", 6).alias("score"), "rank")


@plan(f"""WITH s AS (SELECT l.vec_id, r.vec_id AS nearest, round(list_dot_product(l.v, r.v), 9) AS score FROM {_UNIT} l, {_UNIT} r WHERE l.label < 5 AND r.label >= 5)
SELECT vec_id, nearest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) AS rn FROM s) WHERE rn = 1 AND score >= 0.35""")
def sim_join_threshold(spark, d):
    e = table(spark, d, "embeddings")
    r = rt.similar_above(e.filter("label < 5").select("vec_id", "embedding"), e.filter("label >= 5").select("vec_id", "embedding"), "vec_id", "embedding", 0.35)
    return r.select("vec_id", "nearest", F.round("score", 6).alias("score"))


@plan(f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM {_UNIT}")
def l2_normalize(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    return u.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


_FUSE = """u AS (SELECT item_id, doc_id, rank AS r, 0 AS place, '{a}' AS name FROM l0 UNION ALL SELECT item_id, doc_id, rank, 1, '{b}' FROM l1),
f AS (SELECT item_id, doc_id, sum(1.0 / (60 + r)) AS fused, string_agg(name, '+' ORDER BY place) AS origin, min(place) AS p0, arg_min(r, place) AS r0 FROM u GROUP BY 1, 2)
SELECT item_id, doc_id, round(fused, 9) AS fused, origin, row_number() OVER (PARTITION BY item_id ORDER BY round(fused, 12) DESC, p0, r0, doc_id) AS rank FROM f QUALIFY rank <= {k}"""


@plan(f"WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.75)}, {_scores('t', 'dt', 'qt', 1.2, 0.5)}, l0 AS ({_top('s', 20)}), l1 AS ({_top('t', 20)}), " + _FUSE.format(a="plain", b="tuned", k=10))
def rrf_fuse(spark, d):
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    index = rt.Postings(docs, "doc_id", T.analysed_tokens(F.col("text")), rt.query_words(items, "item_id", "text"))  # one index for both lists
    top = lambda b: rt.bm25_top(items, docs, "item_id", "text", "doc_id", "text", 20, b=b, index=index)
    return rt.rrf([("plain", top(rt.B)), ("tuned", top(0.5))], "item_id", "doc_id", 10).select("item_id", "doc_id", F.round("fused", 9).alias("fused"), "origin", "rank")


_DENSE = f"SELECT q.vec_id AS item_id, e.vec_id AS doc_id, round(list_dot_product(q.v, e.v), 9) AS score FROM {_UNIT} q, {_UNIT} e WHERE q.vec_id IN (SELECT item_id FROM benchmark)"


@plan(f"WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.75)}, l0 AS ({_top(f'({_DENSE})', 50)}), l1 AS ({_top('s', 50)}), " + _FUSE.format(a="dense", b="bm25", k=20))
def hybrid_search(spark, d):
    e, items = table(spark, d, "embeddings"), table(spark, d, "benchmark")
    q = e.select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id", "left_semi")
    dense = rt.knn(q, e.select(F.col("vec_id").alias("doc_id"), "embedding"), "item_id", "doc_id", "embedding", 50)
    h = rt.hybrid(items, table(spark, d, "documents"), "item_id", "text", "doc_id", "text", dense)
    return h.select("item_id", "doc_id", F.round("fused", 9).alias("fused"), "origin", "rank")


@plan(f"""WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.75)}
SELECT item_id, string_agg(rank || '. ' || doc_id || ' (' || printf('%.3f', round(score, 6)) || ')', chr(10) ORDER BY rank) AS block FROM ({_top('s', 5)}) GROUP BY 1""")
def candidate_block_render(spark, d):
    top = _bm25(spark, d, 5).select("item_id", F.col("doc_id").cast("string").alias("label"), F.round("score", 6).alias("score"), "rank")
    return rt.candidate_block("label", "score", "rank", "item_id", top, 5)


@plan(f"""WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.75)}, t AS ({_top('s', 10)}),
g AS (SELECT item_id, min(rank) AS best FROM t JOIN documents d ON t.doc_id = d.doc_id WHERE d.lang = 'en' GROUP BY 1)
SELECT count(*) FILTER (WHERE best <= 1) AS top1, count(*) FILTER (WHERE best <= 5) AS top5, count(*) AS any_candidate FROM g""")
def topn_accuracy(spark, d):
    t = _bm25(spark, d, 10).join(table(spark, d, "documents").filter("lang = 'en'").select("doc_id"), "doc_id")
    g = t.groupBy("item_id").agg(F.min("rank").alias("best"))
    return g.agg(F.count_if(F.col("best") <= 1).alias("top1"), F.count_if(F.col("best") <= 5).alias("top5"), F.count(F.lit(1)).alias("any_candidate"))


@plan()
def encoded_rerank(spark, d):
    """Lexical candidates scored again by an injected pair scorer: the cosine of hashed word vectors."""
    enc = rt.hashing_encoder()

    def pairs(a, b):
        return [float(x @ y) for x, y in zip(enc(a), enc(b), strict=True)]

    hits = _bm25(spark, d, 10).join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("q")), "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rt.rerank(hits, "item_id", "doc_id", "q", "text", pairs, 5).select("item_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank")


@plan(f"""WITH {_BASE.replace("FROM documents", "FROM documents WHERE lang IN ('de', 'fr')")}, ds AS (SELECT doc_id, {_GRAMS} AS ts FROM dt), qs AS (SELECT item_id, {_GRAMS} AS ts FROM qt),
{_scores('a', 'dt', 'qt', 1.2, 0.75)}, {_scores('g', 'ds', 'qs', 1.2, 0.75)},
u AS (SELECT item_id, doc_id, score * 0.6 AS score FROM a UNION ALL SELECT item_id, doc_id, score * 2.0 FROM g
      UNION ALL SELECT g.item_id, g.doc_id, 3.0 FROM g JOIN dt ON g.doc_id = dt.doc_id JOIN qt ON g.item_id = qt.item_id WHERE contains(' ' || array_to_string(dt.ts, ' ') || ' ', ' ' || array_to_string(qt.ts, ' ') || ' ')),
s AS (SELECT item_id, doc_id, sum(score) AS score FROM u GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_top('s', 5)})""")
def tiered_tagged(spark, d):
    """Only documents of two tags are searched."""
    r = rt.tiered(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", 5, "lang", ["de", "fr"])
    return r.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@plan(f"SELECT vec_id, label, round(v[1], 6) AS first, round(v[2], 6) AS second FROM {_UNIT}")
def vector_index(spark, d):
    """Vectors written as a table of unit vectors, opened again and read."""
    path = f"{shared_root(spark)}/vectors-{uuid.uuid4().hex}"
    rt.save_vectors(table(spark, d, "embeddings").withColumn("vec_id", F.col("vec_id").cast("string")), path, "vec_id", "embedding")
    rt.load_vectors(spark, path)
    v = rt.load_vectors(spark, path)
    return v.select("vec_id", "label", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(1)), 6).alias("second"))


@plan(f"""WITH {_BASE}, {_scores('s', 'dt', 'qt', 1.2, 0.75)}
SELECT item_id, string_agg(rank || '. ' || doc_id || ' (' || printf('%.3f', round(score, 6)) || ')' || CASE WHEN doc_id % 2 = 0 THEN ' | ' || doc_id || ' -> ' || (doc_id // 2) ELSE '' END, chr(10) ORDER BY rank) AS block FROM ({_top('s', 3)}) GROUP BY 1""")
def candidate_paths(spark, d):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" -> ", F.col("doc_id").cast("string"), F.expr("cast(doc_id div 2 as string)")))
    top = _bm25(spark, d, 3).select("item_id", F.col("doc_id").cast("string").alias("label"), F.round("score", 6).alias("score"), "rank", path.alias("path"))
    return rt.candidate_block("label", "score", "rank", "item_id", top, 3, "path")


def _pair_scores(a, b):
    enc = rt.hashing_encoder()
    return [float(x @ y) for x, y in zip(enc(a), enc(b), strict=True)]


@plan()
def hybrid_full(spark, d):
    """Dense and tiered lexical lists fused, labelled, scored again, with the path to the concept's halves."""
    e = table(spark, d, "embeddings")
    concepts = table(spark, d, "documents").select(F.col("doc_id").alias("concept"), F.substring("text", 1, 400).alias("label"), F.col("lang").alias("tag"))
    vectors = e.select("vec_id", F.col("vec_id").alias("concept"), F.col("embedding").alias("vector"))
    queries = table(spark, d, "benchmark").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")), "item_id")
    paths = concepts.select("concept", F.concat_ws(" -> ", F.col("concept").cast("string"), F.expr("cast(concept div 2 as string)")).alias("path"))
    r = rt.full_hybrid(queries, concepts, vectors, "item_id", "text", "query_vector", "concept", "label", "vector", _pair_scores, paths)
    return r.select("item_id", "concept", F.round("fused", 9).alias("fused"), "origin", F.round("rerank_score", 6).alias("rerank_score"), "rank", "path")


@plan(f"""WITH {_BASE}, qn AS (SELECT item_id, ts FROM qt WHERE item_id % 3 <> 0),
{_scores('s', 'dt', 'qn', 1.2, 0.75)}, t AS ({_top('s', 3)})
SELECT b.item_id, coalesce(string_agg(t.doc_id || '', ',' ORDER BY t.rank), '') AS ci_text, '' AS severity FROM benchmark b LEFT JOIN t ON t.item_id = b.item_id GROUP BY 1""")
def item_term_map(spark, d):
    """Every item's texts searched as one batch; blank texts get no candidates."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 != 0, F.col("text")).otherwise("  ").alias("ci"), F.lit(None).cast("string").alias("severity"))

    def search(texts):
        return rt.bm25_top(texts, docs, "query", "text", "doc_id", "text", 3).withColumn("label", F.col("doc_id").cast("string"))

    m = rt.map_terms(items, ["item_id"], {"ci": "ci", "severity": "severity"}, search, "doc_id", "label")
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), ",")
    return m.select("item_id", ids("ci_terms").alias("ci_text"), ids("severity_terms").alias("severity"))
