"""Mapping plans over items: orders are documents, lineitem their items, part keys the concept ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import mapping as mp
from ..session import table

QUERIES, ORACLES = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_M = "m AS (SELECT p_brand AS attribute, p_partkey AS cid, bool_or(p_size % 3 <> 0) AS allowed FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1, 2)"
_CAND = "cd AS (SELECT p_brand AS attribute, l_suppkey AS cid, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _prefilter(spark, d):
    p = table(spark, d, "part")
    m = p.filter("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("attribute"), F.col("p_partkey").alias("conceptId"), (F.col("p_size") % 3 != 0).alias("allowed"))
    c = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("attribute")), "l_partkey").select("attribute", F.col("l_suppkey").alias("conceptId"), "l_orderkey")
    return mp.prefilter(c, m)


@plan(f"""WITH {_M}, {_CAND}, k AS (SELECT DISTINCT attribute FROM m)
SELECT cd.attribute, cd.cid AS conceptId, l_orderkey FROM cd LEFT JOIN m ON m.attribute = cd.attribute AND m.cid = cd.cid LEFT JOIN k ON k.attribute = cd.attribute
WHERE coalesce(m.allowed, k.attribute IS NULL)""")
def range_prefilter(spark, d):
    return _prefilter(spark, d)[0].select("attribute", "conceptId", "l_orderkey")


@plan(f"""WITH {_M}, {_CAND}, k AS (SELECT DISTINCT attribute FROM m),
j AS (SELECT cd.attribute, m.allowed, coalesce(m.allowed, k.attribute IS NULL) AS keep FROM cd LEFT JOIN m ON m.attribute = cd.attribute AND m.cid = cd.cid LEFT JOIN k ON k.attribute = cd.attribute)
SELECT attribute, count(*) AS n_in, count(*) FILTER (WHERE allowed IS NOT NULL) AS cache_hits, count(*) FILTER (WHERE allowed IS NULL) AS cache_misses,
count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS dropped FROM j GROUP BY 1""")
def prefilter_diagnostics(spark, d):
    return _prefilter(spark, d)[1]


@plan("SELECT p_brand AS attribute, count(DISTINCT p_partkey) AS concept_count, count(*) FILTER (WHERE p_size % 3 <> 0) AS allowed_count, 0 AS error_count FROM part GROUP BY 1")
def membership_stats(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("attribute"), F.col("p_partkey").alias("conceptId"), (F.col("p_size") % 3 != 0).alias("allowed"))
    return mp.membership_stats(m)


@plan("""WITH r AS (SELECT p_brand AS attribute, trim(p_type) AS c, p_size % 2 AS ct, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT attribute, string_agg(DISTINCT c, ' OR ' ORDER BY c) AS constraints FROM r WHERE n = 1 OR ct = 1 GROUP BY 1""")
def range_constraints(spark, d):
    r = table(spark, d, "part").select(F.col("p_brand").alias("attribute"), F.concat(F.lit(" "), "p_type").alias("constraint"), (F.col("p_size") % 2).alias("content_type"))
    return mp.range_constraints(r, 1).select("attribute", F.array_join("constraints", " OR ").alias("constraints"))


_ITEMS = """it AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS item FROM lineitem)"""


def _items(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return fr.running_key(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]).withColumn("item", F.col("idx").cast("long")).drop("idx", "key")


def _composed():
    return mp.compose(F.col("l_partkey"), [(F.lit(246075003), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey"))), (F.lit(246112005), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_linenumber")))])


_EXPR = """CASE WHEN l_suppkey % 2 = 0 OR l_linenumber % 3 = 0 THEN l_partkey || ':{' || concat_ws(',', CASE WHEN l_suppkey % 2 = 0 THEN '246075003=' || l_suppkey END, CASE WHEN l_linenumber % 3 = 0 THEN '246112005=' || l_linenumber END) || '}' ELSE CAST(l_partkey AS VARCHAR) END"""


@plan(f"WITH {_ITEMS} SELECT l_orderkey, item, {_EXPR} AS expression, CASE WHEN l_returnflag = 'R' THEN 'DIRECT' WHEN contains({_EXPR}, ':') THEN 'POSTCOORD' ELSE 'MINIMAL' END AS status FROM it")
def compose_expression(spark, d):
    e = _items(spark, d).withColumn("expression", _composed())
    return e.select("l_orderkey", "item", "expression", mp.status(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")), F.col("expression")).alias("status"))


@plan(f"WITH {_ITEMS} SELECT l_orderkey, item, CAST(l_partkey AS VARCHAR) AS focus FROM it")
def recover_focus(spark, d):
    e = _items(spark, d).withColumn("expression", _composed())
    return e.select("l_orderkey", "item", mp.focus_of(F.col("expression")).alias("focus"))


@plan(f"""WITH {_ITEMS}, co AS (SELECT l_orderkey, item, l_suppkey AS focus_id, {_EXPR} AS expression FROM it)
SELECT it.l_orderkey, it.item, CASE WHEN l_returnflag <> 'R' THEN 'verified' ELSE 'postcoord' END AS mapping_source,
CAST(CASE WHEN l_returnflag <> 'R' THEN l_partkey ELSE focus_id END AS VARCHAR) AS final_concept_id, CASE WHEN l_returnflag = 'R' THEN expression END AS expression
FROM it JOIN co ON it.l_orderkey = co.l_orderkey AND it.item = co.item""")
def merge_verified_postcoord(spark, d):
    it = _items(spark, d)
    v = it.select("l_orderkey", "item", F.when(F.col("l_returnflag") == "R", mp.NOT_FOUND).otherwise(F.col("l_partkey").cast("string")).alias("selected_id"))
    first = it.select("l_orderkey", "item", F.col("l_suppkey").alias("focus_id"), _composed().alias("expression"), F.lit(2).alias("seq"))
    stale = it.select("l_orderkey", "item", F.lit(0).cast("long").alias("focus_id"), F.lit("stale").alias("expression"), F.lit(1).alias("seq"))
    return mp.merge_verified(v, first.unionByName(stale), ["l_orderkey", "item"]).drop("selected_id")


@plan("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'FOCUS_MISSING' WHEN o_orderstatus = 'P' THEN 'FOCUS_NOT_NUMERIC' END,
CASE WHEN o_custkey % 5 = 0 THEN 'AGENT_NOT_NUMERIC' END) AS reasons FROM orders""")
def validate_ids(spark, d):
    focus = F.when(F.col("o_orderstatus") == "F", "N/A").when(F.col("o_orderstatus") == "P", "x1").otherwise(F.col("o_orderkey").cast("string"))
    agent = F.when(F.col("o_custkey") % 5 == 0, "abc").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(mp.id_faults(focus, {"agent": agent}), ",").alias("reasons"))


@plan("""WITH c AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS VARCHAR) ELSE CAST(ids[1] AS VARCHAR) END AS VARCHAR) AS focus,
CASE WHEN list_contains(ids, o_custkey) THEN CAST(o_custkey AS VARCHAR) ELSE 'N/A' END AS verified FROM orders JOIN c ON l_orderkey = o_orderkey""")
def verify_and_route(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: s["l_partkey"])
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(ids.alias("ids"))
    o = table(spark, d, "orders").join(c, "o_orderkey")
    focus = mp.focus_or_first(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string")).otherwise("N/A"), F.col("ids"))
    labels = F.transform("ids", lambda i: F.concat(F.lit("part "), i.cast("string")))
    return o.select("o_orderkey", focus.alias("focus"), mp.verify_choice(F.col("o_custkey").cast("string"), F.array_distinct("ids"), F.array_distinct(labels), F.lit("no such label")).alias("verified"))


@plan("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' AND user_id = (SELECT min(user_id) FROM events WHERE event_type = 'purchase') ORDER BY ts, event_id LIMIT 1")
def audit_lookup(spark, d):
    e = table(spark, d, "events")
    user = e.filter("event_type = 'purchase'").agg(F.min("user_id")).first()[0]
    return mp.audit_lookup(e, {"event_type": "purchase", "user_id": user}, ["event_id", "event_type", "user_id"], ["ts", "event_id"])


@plan("""SELECT c_custkey, s.slot, s.query FROM customer, (SELECT unnest(['name', 'segment']) AS slot) k, LATERAL (SELECT k.slot, CASE k.slot WHEN 'name' THEN trim(c_name) ELSE trim(c_mktsegment) END AS query) s WHERE s.query <> ''""")
def slot_queries(spark, d):
    return mp.slots(table(spark, d, "customer"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, ["c_custkey"])


@plan("SELECT item_id, 'Statement: ' || text || chr(10) || 'Id: ' || item_id AS prompt FROM benchmark")
def prompt_render(spark, d):
    b = table(spark, d, "benchmark")
    return mp.prompts(b, "Statement: {text}\nId: {id}", {"text": F.col("text"), "id": F.col("item_id")}).select("item_id", "prompt")


@plan()
def chat_with_retry(spark, d):
    """An injected model that completes its answer only with the larger budget."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return mp.chat(b, "prompt", "answer", lambda p, n: f"{len(p)}" + ("<<END_JSON>>" if n > 1024 else "")).select("item_id", "answer")
