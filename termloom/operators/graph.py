"""Hierarchies: closure, depth, common ancestors, constraint membership, similarity tiers, paths, clusters.

Edges are (child, parent). The closure is built by rounds of joins that keep the smallest distance, one round a level;
the pairs of a level are checkpointed, so a round never reads its whole past.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage

#: Fixed values of the similarity tiers: loss per hop, floor, and the shared-ancestor tier.
HOP_LOSS, HOP_FLOOR, SHARED_TOP, SHARED_LOSS, SHARED_FLOOR = 0.15, 0.5, 0.4, 0.05, 0.1
UNREACHABLE_HOPS = 10


def edges_of(relations: DataFrame, type_id: int, inferred: int | None = None) -> DataFrame:
    """Distinct (child, parent) of active relations of a type, of one characteristic only if given."""
    r = relations.filter((F.col("active") == 1) & (F.col("typeId") == type_id))
    if inferred is not None:
        r = r.filter(F.col("characteristicTypeId") == inferred)
    return r.select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent")).distinct()


#: Levels after which the pairs known so far are cut from their past as well.
CUT_EVERY = 16


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, dist): every ancestor with its smallest distance, the node itself left out; only those up to
    max_depth if given."""
    edges = cut_lineage(edges.select("child", "parent").filter("child <> parent").distinct())
    frontier = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    known = frontier.withColumn("dist", F.lit(1))
    for d in itertools.count(2) if max_depth is None else range(2, max_depth + 1):
        step = frontier.join(edges, frontier.ancestor == edges.child).select("node", F.col("parent").alias("ancestor")).filter("node <> ancestor").distinct()
        frontier = cut_lineage(step.join(known, ["node", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.withColumn("dist", F.lit(d)))
        if d % CUT_EVERY == 0:
            known = cut_lineage(known)
    return known


def below(edges: DataFrame, seeds: list[int]) -> DataFrame:
    """(node, ancestor, dist): what lies below the seeds alone, found downwards from them; the closure's rows whose
    ancestor is a seed, without the rest of the closure."""
    spark = edges.sparkSession
    edges = cut_lineage(edges.select("child", "parent").filter("child <> parent").distinct())
    start = spark.createDataFrame([(int(s),) for s in sorted(set(seeds))], "ancestor long")
    known = frontier = None
    for d in itertools.count(1):
        from_ = start.select("ancestor", F.col("ancestor").alias("at")) if frontier is None else frontier.select("ancestor", F.col("node").alias("at"))
        step = edges.join(from_, edges.parent == F.col("at")).select(F.col("child").alias("node"), "ancestor").filter("node <> ancestor").distinct()
        frontier = cut_lineage(step if known is None else step.join(known, ["node", "ancestor"], "left_anti"))
        fresh = frontier.withColumn("dist", F.lit(d))
        known = fresh if known is None else known.unionByName(fresh)
        if frontier.isEmpty():
            return known
        if d % CUT_EVERY == 0:
            known = cut_lineage(known)


def seeds_of(constraint: str | None) -> list[int]:
    """The ids that a constraint names."""
    return [int(m) for m in re.findall(r"\d+", re.sub(r"\|[^|]*\|", "", constraint or ""))]


def simple_paths(nodes: DataFrame, edges: DataFrame, cutoff: int) -> DataFrame:
    """(node, path): every path upwards of 1 to cutoff hops that meets no node twice."""
    at = nodes.select("node", F.array("node").alias("path"), F.col("node").alias("at"))
    out = None
    for _ in range(cutoff):
        at = at.join(edges, at.at == edges.child).filter(~F.expr("array_contains(path, parent)")).select("node", F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("at"))
        part = at.select("node", "path")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def attribute_ranges(focus: DataFrame, hops: DataFrame, domains: DataFrame, attributes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(focus, attribute, constraint): what a focus may be refined by: the domains it lies in (or is), their attributes,
    and the constraints of those. domains has (domain, root), attributes (domain, attribute), ranges (attribute,
    constraint)."""
    reach = focus.select("focus", F.col("focus").alias("root")).unionByName(hops.select(F.col("node").alias("focus"), F.col("ancestor").alias("root")).join(focus.select("focus"), "focus", "left_semi"))
    return reach.join(domains, "root").join(attributes, "domain").join(ranges, "attribute").select("focus", "attribute", "constraint").distinct()


def labelled_relations(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """Relations with their type's and destination's labels, tags cut, ids as text; the id where a label is missing.
    labels has (conceptId, term)."""
    named = lambda x: labels.select(F.col("conceptId").alias(x), T.strip_tag(F.col("term")).alias(f"{x}_term"))
    joined = relations.join(named("typeId"), "typeId", "left").join(named("destinationId"), "destinationId", "left")
    text = lambda c: F.col(c).cast("string").alias(c)
    terms = [F.coalesce(f"{x}_term", F.col(x).cast("string")).alias(f"{x}_term") for x in ("typeId", "destinationId")]
    return joined.select(text("sourceId"), text("typeId"), text("destinationId"), *terms, "relationshipGroup")


def descendants_or_self(hops: DataFrame, of: int) -> DataFrame:
    """(node): everything below a concept, and itself."""
    spark = hops.sparkSession
    return hops.filter(F.col("ancestor") == of).select("node").unionByName(spark.range(1).select(F.lit(of).cast("long").alias("node"))).distinct()


def depths(nodes: DataFrame, hops: DataFrame, root: int) -> DataFrame:
    """(node, depth): hops to the root, 0 if it is not above."""
    d = hops.filter(F.col("ancestor") == root).select("node", F.col("dist").alias("depth"))
    return nodes.select("node").distinct().join(d, "node", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def common_ancestors(pairs: DataFrame, hops: DataFrame, depth: DataFrame) -> DataFrame:
    """(a, b, lca, lca_depth): the deepest common ancestor of each pair, the smallest of several; a concept is not its
    own ancestor."""
    up = hops.select("node", "ancestor")
    shared = pairs.join(up.withColumnRenamed("node", "a"), "a").join(up.select(F.col("node").alias("b"), F.col("ancestor")), ["b", "ancestor"])
    deep = shared.join(depth.withColumnRenamed("node", "ancestor"), "ancestor")
    return deep.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(-F.col("depth"), "ancestor")).alias("lca"), F.max("depth").alias("lca_depth"))


def similarity(pairs: DataFrame, hops: DataFrame, depth: DataFrame) -> DataFrame:
    """(gold, pred, score): 1 if equal; by hops if one lies above the other; by the deepest shared ancestor; else 0."""
    up = hops.select(F.col("node").alias("gold"), F.col("ancestor").alias("pred"), F.col("dist").alias("up"))
    down = hops.select(F.col("ancestor").alias("gold"), F.col("node").alias("pred"), F.col("dist").alias("down"))
    distinct = pairs.select("gold", "pred").distinct()
    shared = common_ancestors(distinct.select(F.col("gold").alias("a"), F.col("pred").alias("b")), hops, depth).select(F.col("a").alias("gold"), F.col("b").alias("pred"), "lca_depth")
    gold_depth = depth.select(F.col("node").alias("gold"), F.col("depth").alias("gold_depth"))
    all_ = distinct.join(up, ["gold", "pred"], "left").join(down, ["gold", "pred"], "left").join(shared, ["gold", "pred"], "left").join(gold_depth, "gold", "left")
    return all_.select("gold", "pred", tier_score("gold", "pred").alias("score"))


def tier_score(gold: str, pred: str) -> Column:
    """The score of a pair from its columns up, down, lca_depth and gold_depth."""
    by_hops = lambda d: F.greatest(F.lit(HOP_FLOOR), 1 - HOP_LOSS * F.col(d))
    return (
        F.when(F.col(gold) == F.col(pred), 1.0)
        .when(F.col("up").isNotNull(), by_hops("up"))
        .when(F.col("down").isNotNull(), by_hops("down"))
        .when(F.col("lca_depth").isNotNull(), F.greatest(F.lit(SHARED_FLOOR), SHARED_TOP - SHARED_LOSS * (F.coalesce("gold_depth", F.lit(0)) - F.col("lca_depth"))))
        .otherwise(0.0)
    )


def nearest_domain(nodes: DataFrame, hops: DataFrame, domains: DataFrame) -> DataFrame:
    """(node, domain): itself if it is a domain, else the nearest above, the smallest of several; null if none."""
    reach = nodes.select("node", F.col("node").alias("domain"), F.lit(0).alias("dist")).unionByName(hops.select("node", F.col("ancestor").alias("domain"), "dist"))
    best = reach.join(domains.select("domain"), "domain", "left_semi").groupBy("node").agg(F.min_by("domain", F.struct("dist", "domain")).alias("domain"))
    return nodes.select("node").distinct().join(best, "node", "left")


def deepest_path(nodes: DataFrame, edges: DataFrame, cutoff: int = 10) -> DataFrame:
    """(node, path): the shortest path to the farthest ancestor within cutoff hops; ties go to the smallest ids."""
    best = nodes.select("node", F.array("node").alias("path"), F.col("node").alias("at"))
    seen = best.select("node", "at")
    out, frontier = best.select("node", "path"), best
    for _ in range(cutoff):
        step = frontier.join(edges, frontier.at == edges.child).select("node", F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("at"))
        step = step.groupBy("node", "at").agg(F.min("path").alias("path")).join(seen, ["node", "at"], "left_anti")
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node", "at"))
        out = out.unionByName(frontier.select("node", "path"))
    return out.groupBy("node").agg(F.min_by("path", F.struct(-F.size("path"), "path")).alias("path"))


def first_parent_path(nodes: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """(node, path) by way of each concept's smallest parent, at most depth hops."""
    parent = edges.groupBy("child").agg(F.min("parent").alias("up"))
    out = nodes.select("node", F.array("node").alias("path"), F.col("node").alias("at"))
    for _ in range(depth):
        nxt = out.join(parent, F.col("at") == F.col("child"), "left")
        out = nxt.select("node", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path", F.array("up"))).alias("path"), F.col("up").alias("at"))
    return out.select("node", "path")


def near_ancestors(hops: DataFrame, within: int, first: int) -> DataFrame:
    """(node, ancestors): the smallest `first` ids within so many hops, in order."""
    return hops.filter(F.col("dist") <= within).groupBy("node").agg(F.slice(F.array_sort(F.collect_list("ancestor")), 1, first).alias("ancestors"))


_ECL = re.compile(r"\s*(<<|<)?\s*(\d+)\s*(?:\|[^|]*\|)?\s*(OR|AND|MINUS)?", re.I)


def members(constraint: str | None, hops: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(node) of a constraint: '<< x', '< x', 'x', joined left to right by OR, AND and MINUS; a blank one holds all
    nodes; None for what is more complex (the caller lets such pass)."""
    if not (constraint or "").strip():
        return nodes.select("node").distinct()
    out, op, at = None, "OR", 0
    while at < len(constraint.rstrip()):
        m = _ECL.match(constraint, at)
        if not m or m.end() == at:
            return None
        ident = int(m[2])
        below = hops.filter(F.col("ancestor") == ident).select("node")
        one = {"<<": lambda: descendants_or_self(hops, ident), "<": lambda: below}.get(m[1] or "", lambda: nodes.filter(F.col("node") == ident).select("node"))()  # noqa: B023
        out = one if out is None else {"OR": lambda: out.unionByName(one).distinct(), "AND": lambda: out.join(one, "node", "left_semi"), "MINUS": lambda: out.join(one, "node", "left_anti")}[op]()  # noqa: B023
        op, at = (m[3] or "").upper(), m.end()
        if not op:
            break
    return out if not constraint[at:].strip() else None


def allowed_values(constraints: list[str], hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): union over the constraints that can be evaluated."""
    parts = [m for c in constraints if (m := members(c, hops, nodes)) is not None]
    out = parts[0] if parts else nodes.select("node").limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def clusters(candidates: DataFrame, hops: DataFrame, depth: DataFrame, min_depth: int = 7) -> DataFrame:
    """Per query, groups of candidates under the deepest common ancestor of some pair of them, scored by
    size / mean distance * mean candidate score; none for groups of one, shallow ancestors or a mean distance below 1.

    candidates has (query, node, score); result has (query, lca, size, score)."""
    left, right = (candidates.select("query", F.col("node").alias(x)) for x in ("a", "b"))
    pairs = left.join(right, "query").filter("a < b")  # within one query's short candidate list
    named = pairs.join(common_ancestors(pairs.select("a", "b").distinct(), hops, depth).filter(F.col("lca_depth") >= min_depth), ["a", "b"])
    nodes = named.select("query", "lca", F.explode(F.array("a", "b")).alias("node")).distinct()
    away = nodes.join(hops.select("node", F.col("ancestor").alias("lca"), "dist"), ["node", "lca"], "left").withColumn("dist", F.coalesce("dist", F.lit(UNREACHABLE_HOPS)))
    return _cluster_scores(away.join(candidates, ["query", "node"]))


def _cluster_scores(nodes: DataFrame) -> DataFrame:
    # sums of whole numbers and decimals, divided once: the order of the rows cannot change a digit
    total = F.sum(F.col("score").cast("decimal(18,9)")).cast("double")
    g = nodes.groupBy("query", "lca").agg(F.count(F.lit(1)).alias("size"), F.sum("dist").alias("hops"), total.alias("total"))
    return g.filter("size > 1 and hops >= size").select("query", "lca", "size", (F.col("size") * F.col("total") / F.col("hops")).alias("score"))


def clusters_of_related(related: DataFrame, min_depth: int = 7) -> DataFrame:
    """clusters() from each query's pairs with their relation: (query, a, b, a_score, b_score, lca, lca_depth, from_a,
    from_b). Rows are dealt by query once; all groups lie within a query."""
    deep = related.filter(F.col("lca_depth") >= min_depth).select("query", "lca", "a", "b", "a_score", "b_score", "from_a", "from_b").repartition("query")
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(f"from_{x}").alias("dist"), F.col(f"{x}_score").alias("score")) for x in "ab")))
    return _cluster_scores(deep.select("query", "lca", ends.alias("e")).select("query", "lca", "e.*").distinct())


def composition(relations: DataFrame, is_a: int, labels: DataFrame | None = None) -> DataFrame:
    """(sourceId, expression): parents joined by ' + ', then ungrouped attributes, then groups in braces, in the order of
    ids; with labels (conceptId, term) each id is followed by |label|.

    relations has (sourceId, typeId, destinationId, relationshipGroup)."""
    r = relations.select("sourceId", "typeId", "destinationId", F.col("relationshipGroup").alias("g")).distinct()
    for x in ("typeId", "destinationId"):
        shown = F.col(x).cast("string")
        if labels is not None:
            r = r.join(labels.select(F.col("conceptId").alias(x), F.col("term").alias(f"{x}_t")), x, "left")
            shown = F.when(F.col(f"{x}_t").isNull(), shown).otherwise(F.concat(shown, F.lit(" |"), F.col(f"{x}_t"), F.lit("|")))
        r = r.withColumn(f"{x}_s", shown)
    pair = F.concat_ws(" = ", "typeId_s", "destinationId_s")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("destinationId", "destinationId_s"))), lambda s: s["destinationId_s"])
    parents = r.filter(F.col("typeId") == is_a).groupBy("sourceId").agg(F.array_join(listed, " + ").alias("parents"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("typeId", "destinationId", pair.alias("p")))), lambda s: s["p"])
    groups = r.filter(F.col("typeId") != is_a).groupBy("sourceId", "g").agg(F.array_join(ordered, ", ").alias("body"))
    groups = groups.withColumn("body", F.when(F.col("g") == 0, F.col("body")).otherwise(F.concat(F.lit("{"), F.col("body"), F.lit("}"))))
    refined = groups.groupBy("sourceId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "body"))), lambda s: s["body"]), ", ").alias("refined"))
    both = parents.join(refined, "sourceId", "full")
    expression = F.concat(F.coalesce("parents", F.lit("")), F.when(F.col("refined").isNotNull(), F.concat(F.lit(" : "), F.col("refined"))).otherwise(""))
    return both.select("sourceId", expression.alias("expression"))


def signatures(relations: DataFrame, is_a: int) -> DataFrame:
    """(sourceId, type_only, type_value): distinct 'g:<group>|t:<type>' and '...|v:<value>' marks without is-a."""
    r = relations.filter((F.col("typeId") != is_a) & F.col("destinationId").isNotNull())
    t = F.concat(F.lit("g:"), F.col("relationshipGroup").cast("string"), F.lit("|t:"), F.col("typeId").cast("string"))
    v = F.concat(t, F.lit("|v:"), F.col("destinationId").cast("string"))
    return r.groupBy("sourceId").agg(F.array_sort(F.collect_set(t)).alias("type_only"), F.array_sort(F.collect_set(v)).alias("type_value"))


def exemplars(pool: DataFrame, top: int = 8, min_marks: int = 2) -> DataFrame:
    """Per query, the candidates most like the others by IDF-weighted Jaccard of their marks.

    pool has (query, node, mark), distinct; result has (query, node, cohesion, rank)."""
    size = F.count(F.lit(1)).over(Window.partitionBy("query", "node"))
    marks = pool.distinct().withColumn("n_marks", size).filter(F.col("n_marks") >= min_marks)
    n = marks.groupBy("query").agg(F.countDistinct("node").alias("n"))
    idf = marks.groupBy("query", "mark").agg(F.count(F.lit(1)).alias("df")).join(n, "query").withColumn("w", F.log((F.col("n") + 1) / (F.col("df") + 1)))
    weighted = marks.join(idf.select("query", "mark", "w"), ["query", "mark"])
    total = weighted.groupBy("query", "node").agg(F.sum("w").alias("total"))
    a, b = (weighted.select("query", "mark", F.col("node").alias(x), "w") for x in ("a", "b"))
    shared = a.join(b.drop("w"), ["query", "mark"]).filter("a <> b").groupBy("query", "a", "b").agg(F.sum("w").alias("shared"))
    ta, tb = (total.select("query", F.col("node").alias(x), F.col("total").alias(f"t{x}")) for x in ("a", "b"))
    den = F.col("ta") + F.col("tb") - F.col("shared")
    sims = shared.join(ta, ["query", "a"]).join(tb, ["query", "b"]).withColumn("sim", F.when(den == 0, 0.0).otherwise(F.col("shared") / den))
    sums = sims.groupBy("query", F.col("a").alias("node")).agg(F.sum("sim").alias("sim"))
    scored = total.join(sums, ["query", "node"], "left").join(n, "query")
    cohesion = F.when(F.col("n") > 1, F.coalesce("sim", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
    ranked = scored.withColumn("cohesion", cohesion).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cohesion", 9)), "node")))
    return ranked.filter(F.col("rank") <= top).select("query", "node", "cohesion", "rank")
