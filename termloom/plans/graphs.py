"""Hierarchy plans. Edges come from part keys: k lies under k div 2 and, where that is at least 1, under k div 3; the
root is 1, and key 0 stands apart. Pairs to compare are each order's parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as g
from ..operators import hierarchy as hy
from ..session import table

QUERIES, ORACLES = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _edges(spark, d):
    p = table(spark, d, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("child"))
    return p.select("child", F.explode(F.array(F.expr("child div 2"), F.expr("child div 3"))).alias("parent")).filter("parent >= 1").distinct()


def _nodes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


_E = "e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2)"
_C = f"{_E}, w(node, ancestor, dist) AS (SELECT child, parent, 1 FROM e UNION SELECT w.node, e.parent, w.dist + 1 FROM w JOIN e ON w.ancestor = e.child), c AS MATERIALIZED (SELECT node, ancestor, min(dist) AS dist FROM w GROUP BY 1, 2)"
_D = "dp AS MATERIALIZED (SELECT p_partkey AS node, coalesce(dist, 0) AS depth FROM part LEFT JOIN c ON c.node = p_partkey AND c.ancestor = 1)"
_PAIRS = "pr AS MATERIALIZED (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)"
_L = "lc AS MATERIALIZED (SELECT a, b, arg_min(ancestor, (-depth, ancestor)) AS lca, max(depth) AS lca_depth FROM (SELECT pr.a, pr.b, x.ancestor, dp.depth FROM pr JOIN c x ON x.node = pr.a JOIN c y ON y.node = pr.b AND y.ancestor = x.ancestor JOIN dp ON dp.node = x.ancestor) GROUP BY 1, 2)"


def _all_pairs(spark, d):
    """The pairs of each order's parts, repeated ones included."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return li.select("l_orderkey", F.col("l_partkey").alias("a")).join(li.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").filter("a < b").select("a", "b")


def _hierarchy(spark, d):
    return hy.hierarchy(_edges(spark, d), _nodes(spark, d), 1)


@plan(f"WITH RECURSIVE {_C} SELECT node, ancestor, dist FROM c")
def ancestor_closure(spark, d):
    return g.closure(_edges(spark, d))


@plan(f"WITH RECURSIVE {_C}, {_D} SELECT node, depth FROM dp")
def concept_depth(spark, d):
    return g.depths(_nodes(spark, d), g.below(_edges(spark, d), [1]), 1)


@plan(f"WITH RECURSIVE {_C} SELECT node FROM c WHERE ancestor = 7 UNION SELECT 7")
def descendants_or_self(spark, d):
    return g.descendants_or_self(g.below(_edges(spark, d), [7]), 7)


@plan(f"WITH RECURSIVE {_C}, {_D}, {_PAIRS}, {_L} SELECT a, b, lca, lca_depth FROM lc")
def lca_pairs(spark, d):
    return hy.related(_all_pairs(spark, d), _hierarchy(spark, d), once=True).filter("lca is not null").select("a", "b", "lca", "lca_depth")


@plan(f"""WITH RECURSIVE {_C}, {_D}, {_PAIRS}, {_L}
SELECT pr.a AS gold, pr.b AS pred, round(CASE WHEN u.dist IS NOT NULL THEN greatest(0.5, 1 - 0.15 * u.dist) WHEN v.dist IS NOT NULL THEN greatest(0.5, 1 - 0.15 * v.dist)
  WHEN lc.lca_depth IS NOT NULL THEN greatest(0.1, 0.4 - 0.05 * (coalesce(dp.depth, 0) - lc.lca_depth)) ELSE 0 END, 6) AS score
FROM pr LEFT JOIN c u ON u.node = a AND u.ancestor = b LEFT JOIN c v ON v.node = b AND v.ancestor = a
LEFT JOIN lc ON lc.a = pr.a AND lc.b = pr.b LEFT JOIN dp ON dp.node = pr.a""")
def hier_similarity(spark, d):
    s = hy.related(_all_pairs(spark, d), _hierarchy(spark, d), once=True).withColumnRenamed("a_depth", "gold_depth")
    return s.select(F.col("a").alias("gold"), F.col("b").alias("pred"), F.round(g.tier_score("a", "b"), 6).alias("score"))


@plan(f"""WITH RECURSIVE {_C}, r AS (SELECT p_partkey AS node, p_partkey AS domain, 0 AS dist FROM part UNION ALL SELECT node, ancestor, dist FROM c),
dm AS (SELECT p_partkey AS domain FROM part WHERE p_size = 7)
SELECT p_partkey AS node, (SELECT arg_min(r.domain, (r.dist, r.domain)) FROM r JOIN dm ON r.domain = dm.domain WHERE r.node = p_partkey) AS domain FROM part""")
def nearest_domain(spark, d):
    dm = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("domain"))
    return g.nearest_domain(_nodes(spark, d), g.closure(_edges(spark, d)), dm)


@plan(f"WITH RECURSIVE {_C} (SELECT node FROM c WHERE ancestor = 5 UNION SELECT 5) INTERSECT SELECT node FROM c WHERE ancestor = 3 EXCEPT SELECT node FROM c WHERE ancestor = 30")
def ecl_membership(spark, d):
    ecl = "<< 5 AND < 3 MINUS < 30"
    return g.members(ecl, g.below(_edges(spark, d), g.seeds_of(ecl)), _nodes(spark, d))


@plan(f"""WITH RECURSIVE {_C}, {_D}, cand AS (SELECT l_orderkey AS query, l_partkey AS node, max(l_discount) AS score FROM lineitem GROUP BY 1, 2),
{_PAIRS}, {_L},
nm AS (SELECT x.query, x.node AS a, y.node AS b, lc.lca FROM cand x JOIN cand y ON x.query = y.query AND x.node < y.node JOIN lc ON lc.a = x.node AND lc.b = y.node WHERE lc.lca_depth >= 2),
nd AS (SELECT query, lca, a AS node FROM nm UNION SELECT query, lca, b FROM nm),
gr AS (SELECT nd.query, nd.lca, count(*) AS size, sum(coalesce(c.dist, 10)) AS hops, CAST(sum(CAST(cand.score AS DECIMAL(18,9))) AS DOUBLE) AS total FROM nd LEFT JOIN c ON c.node = nd.node AND c.ancestor = nd.lca JOIN cand ON cand.query = nd.query AND cand.node = nd.node GROUP BY 1, 2)
SELECT query, lca, size, floor(size * total / hops * 1e6 + 0.5) / 1e6 AS score FROM gr WHERE size > 1 AND hops >= size""")
def lca_clusters(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("node"), "l_discount")
    cand = li.groupBy("query", "node").agg(F.max("l_discount").alias("score"))
    side = lambda x: cand.select("query", F.col("node").alias(x), F.col("score").alias(f"{x}_score"))
    pairs = hy.related(side("a").join(side("b"), "query").filter("a < b"), _hierarchy(spark, d))
    return g.clusters_of_related(pairs, 2).select("query", "lca", "size", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


@plan(f"""WITH RECURSIVE {_E}, up AS (SELECT child, min(parent) AS p FROM e GROUP BY 1)
SELECT p_partkey AS node, concat_ws(' -> ', p_partkey, a.p, b.p, c.p, x.p) AS path FROM part LEFT JOIN up a ON a.child = p_partkey LEFT JOIN up b ON b.child = a.p LEFT JOIN up c ON c.child = b.p LEFT JOIN up x ON x.child = c.p""")
def first_parent_path(spark, d):
    p = g.first_parent_path(_nodes(spark, d), _edges(spark, d))
    return p.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("path"))


@plan(f"""WITH RECURSIVE {_E}, w(node, path, spot) AS (SELECT p_partkey, [p_partkey], p_partkey FROM part UNION ALL SELECT w.node, list_append(w.path, e.parent), e.parent FROM w JOIN e ON w.spot = e.child WHERE len(w.path) <= 10),
s AS (SELECT node, spot, arg_min(path, (len(path), path)) AS path FROM w GROUP BY 1, 2)
SELECT node, array_to_string(arg_min(path, (-len(path), path)), ' -> ') AS path FROM s GROUP BY node""")
def deepest_path(spark, d):
    p = g.deepest_path(_nodes(spark, d), _edges(spark, d))
    return p.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("path"))


@plan(f"""WITH RECURSIVE {_C}, r AS (SELECT node, ancestor, row_number() OVER (PARTITION BY node ORDER BY ancestor) AS rn FROM c WHERE dist <= 2)
SELECT node, string_agg(CAST(ancestor AS VARCHAR), ',' ORDER BY ancestor) AS ancestors FROM r WHERE rn <= 25 GROUP BY 1""")
def near_ancestors(spark, d):
    n = g.near_ancestors(g.closure(_edges(spark, d)), 2, 25)
    return n.select("node", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ",").alias("ancestors"))


_REL = "rel AS (SELECT DISTINCT l_orderkey AS s, l_partkey % 5 AS t, l_suppkey AS v, l_linenumber % 3 AS g FROM lineitem)"


def _relations(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sourceId"), (F.col("l_partkey") % 5).alias("typeId"), F.col("l_suppkey").alias("destinationId"), (F.col("l_linenumber") % 3).alias("relationshipGroup")).distinct()


@plan(f"""WITH {_REL}, pa AS (SELECT s, string_agg(CAST(v AS VARCHAR), ' + ' ORDER BY v, g) AS p FROM rel WHERE t = 0 GROUP BY 1),
gr AS (SELECT s, g, string_agg(t || ' = ' || v, ', ' ORDER BY t, v) AS b FROM rel WHERE t <> 0 GROUP BY 1, 2),
rf AS (SELECT s, string_agg(CASE WHEN g = 0 THEN b ELSE '{{' || b || '}}' END, ', ' ORDER BY g) AS r FROM gr GROUP BY 1)
SELECT coalesce(pa.s, rf.s) AS sourceId, coalesce(p, '') || CASE WHEN r IS NULL THEN '' ELSE ' : ' || r END AS expression FROM pa FULL JOIN rf ON pa.s = rf.s""")
def scg_expression(spark, d):
    return g.composition(_relations(spark, d), 0)


@plan(f"""WITH {_REL} SELECT s AS sourceId, array_to_string(list_sort(list_distinct(list('g:' || g || '|t:' || t))), ' ') AS type_only,
array_to_string(list_sort(list_distinct(list('g:' || g || '|t:' || t || '|v:' || v))), ' ') AS type_value FROM rel WHERE t <> 0 GROUP BY s""")
def signature_sets(spark, d):
    s = g.signatures(_relations(spark, d), 0)
    return s.select("sourceId", F.array_join("type_only", " ").alias("type_only"), F.array_join("type_value", " ").alias("type_value"))


@plan(f"""WITH {_REL}, po AS (SELECT DISTINCT o_custkey AS q, s AS n, 'g:' || g || '|t:' || t AS m FROM rel JOIN orders ON o_orderkey = s WHERE t <> 0),
k AS (SELECT *, count(*) OVER (PARTITION BY q, n) AS c FROM po), p AS (SELECT q, n, m FROM k WHERE c >= 2),
sz AS (SELECT q, count(DISTINCT n) AS size FROM p GROUP BY 1), idf AS (SELECT p.q, m, ln((max(size) + 1) / (count(*) + 1.0)) AS w FROM p JOIN sz ON p.q = sz.q GROUP BY 1, 2),
x AS (SELECT p.q, p.n, p.m, w FROM p JOIN idf ON p.q = idf.q AND p.m = idf.m), tot AS (SELECT q, n, sum(w) AS t FROM x GROUP BY 1, 2),
sh AS (SELECT x.q, x.n AS a, y.n AS b, sum(x.w) AS s FROM x JOIN p y ON x.q = y.q AND x.m = y.m AND x.n <> y.n GROUP BY 1, 2, 3),
si AS (SELECT sh.q, a, sum(CASE WHEN ta.t + tb.t - s = 0 THEN 0 ELSE s / (ta.t + tb.t - s) END) AS s FROM sh JOIN tot ta ON ta.q = sh.q AND ta.n = a JOIN tot tb ON tb.q = sh.q AND tb.n = b GROUP BY 1, 2),
c AS (SELECT tot.q AS query, tot.n AS node, CASE WHEN size > 1 THEN coalesce(si.s, 0) / (size - 1) ELSE 0 END AS cohesion FROM tot JOIN sz ON tot.q = sz.q LEFT JOIN si ON si.q = tot.q AND si.a = tot.n)
SELECT query, node, round(cohesion, 6) AS cohesion, row_number() OVER (PARTITION BY query ORDER BY round(cohesion, 9) DESC, node) AS rank FROM c QUALIFY rank <= 8""")
def structured_exemplars(spark, d):
    s = g.signatures(_relations(spark, d), 0).select("sourceId", F.explode("type_only").alias("mark"))
    pool = s.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("sourceId"), F.col("o_custkey").alias("query")), "sourceId").select("query", F.col("sourceId").alias("node"), "mark")
    return g.exemplars(pool).select("query", "node", F.round("cohesion", 6).alias("cohesion"), "rank")


@plan("""SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || lower(p_type) || coalesce(' | ' || string_agg(DISTINCT 'supplier = ' || l_suppkey, ' | ' ORDER BY 'supplier = ' || l_suppkey), '') AS enriched
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_brand, p_type""")
def enriched_terms(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("supplier = "), F.col("l_suppkey").cast("string")))).alias("attrs"))
    p = table(spark, d, "part").join(a, "p_partkey", "left")
    return p.select("p_partkey", T.enriched_term(F.col("p_name"), F.array("p_brand"), F.lower("p_type"), F.col("attrs")).alias("enriched"))
