"""Evaluation plans. Per order, gold ids are the parts of lines not returned and predictions those of open lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluation as ev
from ..operators import frames as fr
from ..operators import retrieval as rt
from ..session import table
from . import mapped

QUERIES, ORACLES = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_GP = "g AS (SELECT l_orderkey AS doc, l_partkey AS id FROM lineitem WHERE l_returnflag <> 'R'), p AS (SELECT l_orderkey AS doc, l_partkey AS id FROM lineitem WHERE l_linestatus = 'O')"
_COUNTS = "c AS (SELECT coalesce(a.doc, b.doc) AS doc, count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(*) FILTER (WHERE a.id IS NULL) AS fp, count(*) FILTER (WHERE b.id IS NULL) AS fn FROM (SELECT DISTINCT * FROM g) a FULL JOIN (SELECT DISTINCT * FROM p) b ON a.doc = b.doc AND a.id = b.id GROUP BY 1)"
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


def _sides(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id"), "l_returnflag", "l_linestatus")
    return li.filter("l_returnflag <> 'R'").select("doc", "id"), li.filter("l_linestatus = 'O'").select("doc", "id")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@plan(f"WITH {_GP}, {_COUNTS} SELECT doc, tp, fp, fn, {_PRF} FROM c")
def set_prf_per_doc(spark, d):
    return _rounded(ev.set_metrics(*_sides(spark, d), "doc", "id"))


@plan(f"WITH {_GP}, {_COUNTS}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c) SELECT tp, fp, fn, {_PRF} FROM s")
def micro_prf(spark, d):
    return _rounded(ev.micro(ev.set_metrics(*_sides(spark, d), "doc", "id")))


@plan(f"""WITH {_GP}, a AS (SELECT doc, list_sort(list_distinct(list(id))) AS v FROM g GROUP BY 1), b AS (SELECT doc, list_sort(list_distinct(list(id))) AS v FROM p GROUP BY 1)
SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.v = b.v, false) AS exact, coalesce(list_has_any(a.v, b.v), false) AS relaxed FROM a FULL JOIN b ON a.doc = b.doc""")
def exact_set_metric(spark, d):
    return ev.exact_sets(*_sides(spark, d), "doc", "id")


@plan(f"""WITH {_GP}, a AS (SELECT doc, id, count(*) AS n FROM g GROUP BY 1, 2), b AS (SELECT doc, id, count(*) AS n FROM p GROUP BY 1, 2)
SELECT b.doc, b.id, b.n - coalesce(a.n, 0) AS surplus FROM b LEFT JOIN a ON a.doc = b.doc AND a.id = b.id WHERE b.n > coalesce(a.n, 0)""")
def multiset_surplus(spark, d):
    return ev.surplus(*_sides(spark, d), ["doc", "id"])


@plan(f"""WITH {mapped._ITEMS}, g AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS expr, item, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY item) AS nth FROM it WHERE l_returnflag = 'A'),
p AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS expr, item, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY item) AS nth FROM it WHERE l_returnflag = 'N')
SELECT g.doc, g.expr, g.item AS gold_item, p.item AS pred_item FROM g JOIN p ON g.doc = p.doc AND g.expr = p.expr AND g.nth = p.nth""")
def expr_exact_consume(spark, d):
    it = mapped._items(spark, d).select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).alias("expr"), "item", "l_returnflag")
    return ev.consume_equal(it.filter("l_returnflag = 'A'"), it.filter("l_returnflag = 'N'"), ["doc", "expr"], "item")


@plan("""WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)
SELECT a.conv_id, a.turn AS g, b.turn AS p, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) END, 6) AS jaccard
FROM t a JOIN t b ON a.conv_id = b.conv_id WHERE a.role = 'user' AND b.role = 'assistant'""")
def pair_scores(spark, d):
    return _pairs(spark, d).select("conv_id", "g", "p", F.round("jaccard", 6).alias("jaccard"))


def _pairs(spark, d):
    """Per conversation, user turns against assistant turns."""
    c = table(spark, d, "conversations")
    g = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("g"), F.col("text").alias("gt"))
    p = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("p"), F.col("text").alias("pt"))
    return ev.pair_scores(g, p, "conv_id", "gt", "pt")


@plan()
def greedy_assign(spark, d):
    return ev.assign(_pairs(spark, d), "conv_id", "g", "p", "score", "greedy", 0.01)


@plan()
def hungarian_assign(spark, d):
    return ev.assign(_pairs(spark, d), "conv_id", "g", "p", "score", "optimal", 0.01)


@plan()
def embedding_greedy(spark, d):
    """Per label, all vectors of even id (gold) against all of odd id."""
    e = table(spark, d, "embeddings").withColumn("doc", F.col("label").cast("string"))
    side = lambda k, x: e.filter(F.col("vec_id") % 2 == k).select("doc", F.col("vec_id").alias(x), "embedding")
    return ev.match_vectors(side(0, "g"), side(1, "p"), "doc", "g", "p", "embedding", 0.1)


@plan()
def encoded_pair_scores(spark, d):
    """0.85 * cosine of hashed word vectors + 0.15 * token Jaccard, assigned greedily."""
    c = rt.encode(table(spark, d, "conversations"), "text", "v", rt.hashing_encoder())
    g = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("g"), F.col("text").alias("gt"), F.col("v").alias("gv"))
    p = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("p"), F.col("text").alias("pt"), F.col("v").alias("pv"))
    s = ev.pair_scores(g, p, "conv_id", "gt", "pt", V.cosine(F.col("gv"), F.col("pv")))
    return ev.assign(s, "conv_id", "g", "p", "score")


@plan()
def tiered_metrics(spark, d):
    """Concept matching by hierarchy tiers: the optimal pairs of each order, their credit and the counts."""
    from ..operators import graph as g
    from ..operators import hierarchy as hy
    from . import graphs

    gold, pred = (x.distinct() for x in _sides(spark, d))
    pairs = gold.withColumnRenamed("id", "a").join(pred.withColumnRenamed("id", "b"), "doc")
    s = hy.related(pairs, graphs._hierarchy(spark, d)).withColumnRenamed("a_depth", "gold_depth")
    s = s.select("doc", F.col("a").alias("gold"), F.col("b").alias("pred"), g.tier_score("a", "b").alias("score"))
    best = ev.assign(s, "doc", "gold", "pred", "score", "optimal", 0.1).groupBy("doc").agg(F.sum("score").alias("credit"))
    n = gold.groupBy("doc").agg(F.count(F.lit(1)).alias("n_gold")).join(pred.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pred")), "doc", "full")
    full = n.join(best, "doc", "left").na.fill(0)
    c = full.select("doc", F.round("credit", 6).alias("tp"), F.round(F.col("n_pred") - F.col("credit"), 6).alias("fp"), F.round(F.col("n_gold") - F.col("credit"), 6).alias("fn"))
    return _rounded(c.select("doc", "tp", "fp", "fn", *ev.prf_columns("tp", "fp", "fn")))


@plan()
def eval_detail_table(spark, d):
    c = table(spark, d, "conversations")
    gold = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("g"), (F.length("text") < 40).alias("ignored"))
    pred = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("p"))
    matched = ev.assign(_pairs(spark, d), "conv_id", "g", "p", "score", "greedy", 0.01).select("conv_id", "g", "p")
    return ev.detail(gold, pred, matched, "conv_id", "g", "p")


@plan("""WITH e AS (SELECT event_id, user_id, CAST(value AS BIGINT) AS s, CAST(value AS BIGINT) + 5 AS t, event_type FROM events)
SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.s < b.t AND b.s < a.t WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def span_overlap(spark, d):
    s = F.rint("value").cast("long")
    e = table(spark, d, "events").select("event_id", "user_id", s.alias("s"), "event_type")
    a = e.filter("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("s").alias("s1"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("s").alias("s2"))
    return a.join(b, "user_id").filter(ev.spans_overlap(F.col("s1"), F.col("s1") + 5, F.col("s2"), F.col("s2") + 5)).select("a", "b")


@plan("""WITH g AS (SELECT DISTINCT l_orderkey AS doc, lower(p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'),
p AS (SELECT DISTINCT l_orderkey AS doc, lower(p_type) AS k FROM lineitem JOIN part ON l_suppkey = p_partkey WHERE l_returnflag = 'N' OR l_linenumber = 1),
j AS (SELECT coalesce(g.doc, p.doc) AS doc, count(*) FILTER (WHERE g.k IS NOT NULL AND p.k IS NOT NULL) AS tp, count(*) FILTER (WHERE g.k IS NULL) AS fp, count(*) FILTER (WHERE p.k IS NULL) AS fn,
coalesce(string_agg(p.k, ';' ORDER BY p.k) FILTER (WHERE g.k IS NULL), '') AS fp_keys, coalesce(string_agg(g.k, ';' ORDER BY g.k) FILTER (WHERE p.k IS NULL), '') AS fn_keys FROM g FULL JOIN p ON g.doc = p.doc AND g.k = p.k GROUP BY 1)
SELECT doc, tp, fp, fn, fp_keys, fn_keys FROM j""")
def lexical_keys(spark, d):
    """Statements that differ in lead phrases and case match by their canonical form."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_type")
    li = table(spark, d, "lineitem")
    gold = li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("k")).join(p, "k").select("doc", F.concat(F.lit("Patients with "), "p_type").alias("text"))
    pred = li.filter("l_returnflag = 'N' or l_linenumber = 1").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("k")).join(p, "k").select("doc", F.concat(F.lit(" known "), "p_type").alias("text"))
    m = ev.canonical_sets(gold, pred, "doc", "text")
    return m.select("doc", "tp", "fp", "fn", F.array_join("fp_keys", ";").alias("fp_keys"), F.array_join("fn_keys", ";").alias("fn_keys"))


def _statements(spark, d):
    """Per order, gold statements (flag A, every fifth ignored) and predictions (flag N) with two ids each, paired by
    their number within the order; orders without gold have predictions alone."""
    it = mapped._items(spark, d)
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("item"))
    side = lambda flag, x, ids: it.filter(F.col("l_returnflag") == flag).withColumn("nth", nth).select(F.col("l_orderkey").alias("doc"), F.col("item").alias(x), "nth", "l_partkey", F.array(*ids).alias("ids"))
    gold = side("A", "g", [F.col("l_linenumber").cast("long"), F.col("l_partkey") % 3]).withColumn("ignored", F.col("l_partkey") % 5 == 0)
    pred = side("N", "p", [F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 3])
    matched = gold.select("doc", "g", "nth").join(pred.select("doc", "p", "nth"), ["doc", "nth"]).drop("nth")
    return gold, pred, matched


_ST = f"""{mapped._ITEMS}, gs AS (SELECT l_orderkey AS doc, item AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY item) AS nth, list_distinct([CAST(l_linenumber AS BIGINT), CAST(l_partkey % 3 AS BIGINT)]) AS gi, l_partkey % 5 = 0 AS ignored FROM it WHERE l_returnflag = 'A'),
ps AS (SELECT l_orderkey AS doc, item AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY item) AS nth, list_distinct([CAST(l_linenumber AS BIGINT), CAST(l_suppkey % 3 AS BIGINT)]) AS pi FROM it WHERE l_returnflag = 'N'),
oc AS (SELECT coalesce(gs.doc, ps.doc) AS doc, g, p, gi, pi, CASE WHEN p IS NULL THEN CASE WHEN ignored THEN 'ignored_gold_unmatched' ELSE 'unmatched_gold' END WHEN g IS NULL THEN 'unmatched_pred' WHEN ignored THEN 'matched_ignored_gold' ELSE 'matched' END AS outcome
FROM gs FULL JOIN ps ON gs.doc = ps.doc AND gs.nth = ps.nth)"""


def _levels_sql(alone: int) -> str:
    eq = "len(gi) = len(pi) AND len(list_intersect(gi, pi)) = len(gi)"
    sums = f"""SELECT sum(CASE WHEN outcome = 'matched' THEN 1 ELSE 0 END) AS a1, sum(CASE WHEN outcome = 'unmatched_pred' THEN 1 ELSE 0 END) AS b1, sum(CASE WHEN outcome = 'unmatched_gold' THEN 1 ELSE 0 END) AS c1,
    sum(CASE WHEN outcome = 'matched' AND {eq} THEN 1 ELSE 0 END) AS a2, sum(CASE WHEN outcome = 'matched' AND NOT ({eq}) THEN 1 WHEN outcome = 'unmatched_pred' THEN {alone} ELSE 0 END) AS b2, sum(CASE WHEN outcome = 'matched' AND NOT ({eq}) THEN 1 WHEN outcome = 'unmatched_gold' THEN {alone} ELSE 0 END) AS c2,
    sum(CASE WHEN outcome = 'matched' THEN len(list_intersect(gi, pi)) ELSE 0 END) AS a3, sum(CASE WHEN outcome = 'matched' THEN len(pi) - len(list_intersect(gi, pi)) WHEN outcome = 'unmatched_pred' THEN len(pi) * {alone} ELSE 0 END) AS b3, sum(CASE WHEN outcome = 'matched' THEN len(gi) - len(list_intersect(gi, pi)) WHEN outcome = 'unmatched_gold' THEN len(gi) * {alone} ELSE 0 END) AS c3 FROM oc"""
    return f"""lv{alone} AS (SELECT unnest(['extraction', 'exact_set', 'concept']) AS level, CAST(unnest([a1, a2, a3]) AS DOUBLE) AS tp, CAST(unnest([b1, b2, b3]) AS DOUBLE) AS fp, CAST(unnest([c1, c2, c3]) AS DOUBLE) AS fn FROM ({sums})),
    mt{alone} AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM lv{alone})"""


_MT = "SELECT {tag}level, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM mt{n}"


def _levels(spark, d, decoupled):
    gold, pred, matched = _statements(spark, d)
    outcomes = ev.detail(gold, pred, matched, "doc", "g", "p")
    return ev.levels(ev.outcome_counts(outcomes, gold, pred, "doc", "g", "p", decoupled))


@plan(f"WITH {_ST}, {_levels_sql(0)}, {_levels_sql(1)} " + _MT.format(tag="'decoupled' AS counting, ", n=0) + " UNION ALL " + _MT.format(tag="'coupled' AS counting, ", n=1))
def three_level_metrics(spark, d):
    """Ignored gold takes its prediction out of every level; unmatched rows count below the first level if coupled."""
    tagged = lambda x, tag: _rounded(x).select(F.lit(tag).alias("counting"), "*")
    return tagged(_levels(spark, d, True), "decoupled").unionByName(tagged(_levels(spark, d, False), "coupled"))


@plan(f"WITH {_ST} SELECT doc, g, p, outcome FROM oc WHERE outcome <> 'unmatched_pred' OR doc IN (SELECT doc FROM gs) UNION ALL SELECT doc, g, p, 'unmatched_pred_no_gold' FROM oc WHERE doc NOT IN (SELECT doc FROM gs)")
def outcome_table(spark, d):
    return ev.detail(*_statements(spark, d), "doc", "g", "p")


@plan(f"""WITH {_ST} SELECT gs.doc, g, p, round(len(list_intersect(gi, pi)) / CAST(len(gi) + len(pi) - len(list_intersect(gi, pi)) AS DOUBLE), 6) AS score FROM gs JOIN ps ON gs.doc = ps.doc WHERE NOT ignored""")
def id_jaccard_pairs(spark, d):
    """Ignored gold is dropped before any pair is scored."""
    gold, pred, _ = _statements(spark, d)
    pairs = gold.filter("not ignored").select("doc", "g", F.col("ids").alias("a")).join(pred.select("doc", "p", F.col("ids").alias("b")), "doc")
    return pairs.select("doc", "g", "p", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@plan()
def reserved_then_greedy(spark, d):
    """Equal part numbers modulo 7 are reserved, the rest goes by the Jaccard of ids."""
    gold, pred, _ = _statements(spark, d)
    keyed = lambda df, x: df.select("doc", x, (F.col("l_partkey") % 7).cast("string").alias("key"), F.col("ids").cast("array<string>").alias("ids"))
    return ev.reserve_then_assign(keyed(gold, "g"), keyed(pred, "p"), "doc", "g", "p", "key", "ids", 0.01)


@plan()
def nearest_unused(spark, d):
    """Similarity of token sets where both sides have words; else common ids."""
    pairs = _pairs(spark, d).select("conv_id", "g", "p", F.when(F.col("jaccard") > 0, F.col("jaccard")).alias("similarity"), (F.col("g") % 2 + F.col("p") % 2).cast("int").alias("overlap"))
    return ev.nearest_unused(pairs, "conv_id", "g", "p", "similarity", "overlap")


_RUN = "SELECT '{t}' AS run_tag, CASE WHEN 2.0 * tp + fp + fn > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0 END AS score FROM (SELECT count(*) FILTER (WHERE l_linenumber <= {k} AND l_returnflag = 'R') AS tp, count(*) FILTER (WHERE l_linenumber <= {k} AND l_returnflag <> 'R') AS fp, count(*) FILTER (WHERE l_linenumber > {k} AND l_returnflag = 'R') AS fn FROM lineitem)"


@plan("SELECT run_tag, round(score, 6) AS score FROM (" + " UNION ALL ".join(_RUN.format(t=f"run{k}", k=k) for k in range(1, 9)) + ")")
def grid_summary(spark, d):
    """Eight runs that keep 1 to 8 lines of an order, each with its own metrics, as one table."""
    li = table(spark, d, "lineitem")
    hit = F.col("l_returnflag") == "R"

    def run(k):
        kept = F.col("l_linenumber") <= k
        return li.agg(F.count_if(kept & hit).alias("tp"), F.count_if(kept & ~hit).alias("fp"), F.count_if(~kept & hit).alias("fn")).select(*ev.prf_columns("tp", "fp", "fn"))

    return ev.grid({f"run{k}": run(k) for k in range(1, 9)}).select("run_tag", F.round("score", 6).alias("score"))


@plan("SELECT lang, count(*) AS n, round(sum(n_chars) / 1000.0, 3) AS total, round(avg(n_chars), 3) AS mean FROM documents GROUP BY lang")
def timing_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("n_chars") / 1000.0, 3).alias("total"), F.round(F.avg("n_chars"), 3).alias("mean"))


@plan("""SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def latest_wins(spark, d):
    return fr.latest_by(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), ["l_orderkey"], ["l_extendedprice", "l_partkey"])
