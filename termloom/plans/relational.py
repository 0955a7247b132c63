"""Filters, joins, aggregates, windows and nesting over the driver's tables.

Roles: part = concepts (p_name term, p_type tag, p_brand vocabulary), orders = documents, lineitem = their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import frames as fr
from ..session import table

QUERIES, ORACLES = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@plan("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def scan_active_filter(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority")


@plan("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_active(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return fr.in_ids(table(spark, d, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


@plan("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_missing(spark, d):
    return fr.not_in_ids(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_CONCEPT = "SELECT p_partkey, p_name || ' (' || lower(p_type) || ')' AS term FROM part"


def _concepts(spark, d):
    """Concepts with a tagged term, and synonyms derived from vocabulary and size."""
    p = table(spark, d, "part")
    term = F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")"))
    concept = p.select(F.col("p_partkey").alias("conceptId"), term.alias("term"), T.semantic_tag(term).alias("semantic_tag"))
    syn = p.select(F.col("p_partkey").alias("conceptId"), F.concat_ws(" ", "p_name", "p_brand").alias("term"))
    return concept, syn.unionByName(p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("conceptId"), F.concat("p_name", F.lit("  ")).alias("term")))


@plan(f"""
WITH s AS (SELECT p_partkey, p_name || ' ' || p_brand AS term FROM part
           UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size % 2 = 0),
u AS (SELECT p_partkey, trim(term) AS term_text, 'preferred' AS term_type FROM ({_CONCEPT})
      UNION ALL SELECT p_partkey, trim(term), 'synonym' FROM s)
SELECT p_partkey AS conceptId, term_text, min(term_type) AS term_type FROM u GROUP BY p_partkey, term_text""")
def terms_union(spark, d):
    concept, syn = _concepts(spark, d)
    return fr.terms(concept, fr.present(syn, "term")).select("conceptId", "term_text", "term_type")


@plan(f"""
WITH s AS (SELECT DISTINCT p_partkey, trim(term) AS term FROM (SELECT p_partkey, p_name || ' ' || p_brand AS term FROM part
           UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size % 2 = 0))
SELECT c.p_partkey AS conceptId, c.term, lower(regexp_extract(c.term, '\\(([^)]+)\\)\\s*$', 1)) AS semantic_tag,
       coalesce((SELECT string_agg(s.term, '; ' ORDER BY s.term) FROM s WHERE s.p_partkey = c.p_partkey), '') AS synonyms
FROM ({_CONCEPT}) c""")
def complete_concepts(spark, d):
    concept, syn = _concepts(spark, d)
    return fr.complete(concept, syn).select("conceptId", "term", "semantic_tag", F.array_join("synonyms", "; ").alias("synonyms"))


@plan("SELECT p_brand AS vocabulary, count(*) AS n FROM part GROUP BY p_brand")
def vocab_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("vocabulary")).agg(F.count(F.lit(1)).alias("n"))


@plan("""
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
FROM (SELECT p_brand, count(*) n FROM part WHERE p_size <= 5 GROUP BY 1) a
FULL JOIN (SELECT p_brand, count(*) n FROM part WHERE p_size >= 46 GROUP BY 1) b ON a.p_brand = b.p_brand""")
def vocab_compare_outer(spark, d):
    p = table(spark, d, "part")
    return fr.compare_counts(p.filter("p_size <= 5"), p.filter("p_size >= 46"), "p_brand")


@plan("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(DISTINCT p_name) AS names FROM part")
def distinct_counts(spark, d):
    return table(spark, d, "part").agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.countDistinct("p_name").alias("names"))


@plan("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS named, count(*) AS n FROM documents GROUP BY lang")
def map_values_counts(spark, d):
    named = fr.map_values(F.col("lang"), {"en": "English", "de": "German", "fr": "French"})
    return table(spark, d, "documents").groupBy("lang", named.alias("named")).agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT c_custkey FROM customer WHERE NOT coalesce(contains(lower(c_mktsegment), 'build'), false)")
def substring_exclusion(spark, d):
    return fr.without_substring(table(spark, d, "customer"), "c_mktsegment", "BUILD").select("c_custkey")


@plan("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click'")
def not_equal_keep_null(spark, d):
    return fr.not_equal(table(spark, d, "events"), "event_type", "click").select("event_id")


@plan("""
SELECT l_orderkey, count(*) AS item_count,
       string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items
FROM lineitem GROUP BY l_orderkey""")
def group_nested_items(spark, d):
    n = fr.nest_items(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"])
    line = F.transform("items", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_partkey"], s["l_suppkey"]))
    return n.select("l_orderkey", "item_count", F.array_join(line, ";").alias("items"))


_TYPES = ["click", "view", "purchase", "signup", "scroll", "error"]


@plan("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def status_pivot(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", _TYPES).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("user_id", *(F.col(t).alias(f"n_{t}") for t in _TYPES))


@plan("""
WITH m AS (SELECT d.doc_id, d.lang, count(l.doc_id) AS n, sum(d.n_chars) AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE n > 0) AS with_label, count(*) FILTER (WHERE n = 0) AS without_label,
       round(avg(chars), 3) AS mean_chars FROM m GROUP BY lang""")
def corpus_summary(spark, d):
    m = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").groupBy("doc_id", "lang").agg(F.count("l").alias("n"), F.sum("n_chars").alias("chars"))
    return m.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n") > 0).alias("with_label"), F.count_if(F.col("n") == 0).alias("without_label"), F.round(F.avg("chars"), 3).alias("mean_chars"))


@plan("""
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx FROM lineitem)
SELECT l_orderkey, idx, l_orderkey || '_' || lpad(CAST(idx AS VARCHAR), 3, '0') AS key, l_partkey FROM r""")
def running_item_key(spark, d):
    r = fr.running_key(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return r.select("l_orderkey", "idx", "key", "l_partkey")


@plan("""
WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders)
SELECT shard, count(*) AS n, min(o_orderkey) AS least FROM r GROUP BY shard""")
def modulo_shards(spark, d):
    return fr.shard(table(spark, d, "orders"), 4, ["o_orderkey"]).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@plan("""
SELECT l_orderkey, l_partkey, l_extendedprice, rank FROM (
  SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""")
def top_k_per_group(spark, d):
    return fr.top_k(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey"], 3)


@plan("""
WITH g AS (SELECT l_partkey, count(*) AS global_count FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2),
r AS (SELECT b.*, g.global_count, row_number() OVER (PARTITION BY l_orderkey ORDER BY global_count DESC, best DESC, b.l_partkey) AS rank FROM b JOIN g ON b.l_partkey = g.l_partkey)
SELECT l_orderkey, l_partkey, best, global_count, rank FROM r WHERE rank <= 5""")
def rank_candidates(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_suppkey")
    b = fr.best_duplicate(li, ["l_orderkey"], "l_partkey", "l_extendedprice", ["l_suppkey"]).withColumnRenamed("l_extendedprice", "best")
    return fr.top_k(b, ["l_orderkey"], [F.desc("global_count"), F.desc("best"), "l_partkey"], 5).select("l_orderkey", "l_partkey", "best", "global_count", "rank")


@plan("""
SELECT o_orderpriority, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS accuracy,
       bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY 1""")
def conditional_accuracy(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1)), 6).alias("accuracy"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


@plan("""
SELECT l_orderkey, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS label, count(*) AS n
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY 1, 2""")
def label_lookup(spark, d):
    p = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return fr.with_label(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), p, "l_partkey", "p_name", "label").groupBy("l_orderkey", "label").agg(F.count(F.lit(1)).alias("n"))


@plan("""
WITH o AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
p AS (SELECT DISTINCT l_partkey AS id FROM lineitem JOIN o ON l_orderkey = o.id),
s AS (SELECT DISTINCT l_suppkey AS id FROM lineitem JOIN p ON l_partkey = p.id)
SELECT id FROM s""")
def chained_crosswalk(spark, d):
    li = table(spark, d, "lineitem")
    seeds = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return fr.crosswalk(seeds, li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@plan("""
WITH s AS (SELECT p_partkey FROM part)
SELECT DISTINCT s.p_partkey AS seed, c.l_partkey AS related FROM s JOIN lineitem a ON a.l_partkey = s.p_partkey
JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_returnflag IN ('A', 'N') JOIN lineitem c ON c.l_linenumber = b.l_linenumber AND c.l_orderkey = b.l_orderkey
WHERE s.p_partkey <> c.l_partkey""")
def seed_expansion(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    atom = F.concat_ws("-", "l_orderkey", "l_linenumber")
    atoms = li.select(F.col("l_partkey").alias("concept"), atom.alias("atom"))
    a, b = li.alias("a"), li.alias("b")
    rel = a.join(b, "l_orderkey").select(F.concat_ws("-", "l_orderkey", "a.l_linenumber").alias("atom"), F.col("b.l_returnflag").alias("label"), F.concat_ws("-", "l_orderkey", "b.l_linenumber").alias("related_atom"))
    seeds = table(spark, d, "part").select("p_partkey")
    return fr.expand_seeds(seeds, atoms, rel, ["A", "N"])


@plan("""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def lookup_two_sides(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0, ["customers", "suppliers"]).select("n_name", "customers", "suppliers")


@plan("""
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def json_path_reads(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@plan("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_day_counts(spark, d):
    from ..streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")
