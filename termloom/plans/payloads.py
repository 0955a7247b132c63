"""Candidate lists, payloads, results and label sections: orders are items, their parts the candidates in line order,
customers have label documents, and part keys k lie under k div 2 (see graphs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import frames as fr
from ..operators import graph as g
from ..operators import payloads as pl
from ..operators import sections as sc
from ..session import table
from . import graphs

QUERIES, ORACLES = {}, {}


def plan(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_HITS = "h AS (SELECT l_orderkey, list(struct_pack(id := l_partkey, label := p_name) ORDER BY l_linenumber, l_partkey, l_suppkey) AS hits FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
_ROWS = "hr AS (SELECT l_orderkey, p_partkey AS id, p_name AS label, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _hits(spark, d, keep=None):
    """(l_orderkey, hits) of every order; null stands for ids or labels that keep takes away."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p, "l_partkey")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name")))
    return li.groupBy("l_orderkey").agg(F.transform(ordered, lambda s: F.struct((keep(s["l_partkey"]) if keep else s["l_partkey"]).alias("id"), s["p_name"].alias("label"))).alias("hits"))


@plan(f"WITH {_HITS} SELECT l_orderkey, CAST(to_json(hits) AS VARCHAR) AS json, hits[1].label AS first_label FROM h")
def hit_projection(spark, d):
    h = _hits(spark, d)
    return h.select("l_orderkey", pl.project_hits(F.col("hits"), ["id", "label"]).alias("json"), F.get("hits", F.lit(0))["label"].alias("first_label"))


@plan(f"WITH {_ROWS} SELECT l_orderkey, coalesce(string_agg(id || '=' || label, '; ' ORDER BY pos) FILTER (WHERE id % 3 <> 0), '') AS hits FROM hr GROUP BY 1")
def clean_hit_terms(spark, d):
    h = _hits(spark, d, lambda i: F.when(i % 3 != 0, i))
    return h.select("l_orderkey", F.array_join(F.transform(pl.clean_hits(F.col("hits")), lambda x: F.concat(x["id"], F.lit("="), x["label"])), "; ").alias("hits"))


@plan(f"WITH {_ROWS} SELECT l_orderkey, string_agg(pos || '. ' || label || ' [' || id || ']', chr(10) ORDER BY pos) AS block FROM hr WHERE pos <= 3 GROUP BY 1")
def candidate_lines(spark, d):
    return _hits(spark, d).select("l_orderkey", pl.block(F.col("hits"), 3).alias("block"))


@plan(f"""WITH {_ROWS} SELECT l_orderkey, count(*) FILTER (WHERE CASE WHEN l_orderkey % 2 = 0 THEN id % 2 = 0 ELSE true END) AS n_hits,
coalesce(CAST(CASE WHEN count(*) FILTER (WHERE id % 2 = 0) > 0 THEN min_by(id, pos) FILTER (WHERE id % 2 = 0) ELSE min_by(id, pos) END AS VARCHAR), '') AS focus,
CAST(min_by(id, pos) AS VARCHAR) AS direct FROM hr GROUP BY 1""")
def slot_routing(spark, d):
    h = _hits(spark, d)
    even = F.filter("hits", lambda x: x["id"] % 2 == 0)
    routed = pl.route_slots(even, F.col("hits"), {"severity": F.when(F.col("l_orderkey") % 2 == 0, even).otherwise(F.col("hits"))})
    first = lambda c: F.get(c, F.lit(0))["id"].cast("string")
    return h.select("l_orderkey", F.size(routed["severity"]).cast("long").alias("n_hits"), first(routed["focus"]).alias("focus"), first(routed["direct"]).alias("direct"))


@plan("""WITH v AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR) END AS sel FROM orders)
SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority AS verified_text FROM lineitem JOIN v ON l_orderkey = o_orderkey WHERE sel = 'N/A'""")
def unresolved_items(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_custkey").cast("string")).alias("selected_id"), F.col("o_orderpriority").alias("query_text"), F.lit(1).alias("seq"))
    return pl.unresolved(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), o, ["l_orderkey"])


@plan(f"""WITH {_ROWS}, m AS (SELECT p_partkey AS cid, p_size % 3 <> 0 AS allowed FROM part),
k AS (SELECT l_orderkey, label, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS pos FROM hr JOIN m ON cid = id WHERE allowed),
a AS (SELECT l_orderkey, count(*) AS agents, coalesce(string_agg(pos || '. ' || label || ' [' || id || ']', chr(10) ORDER BY pos) FILTER (WHERE pos <= 2), '') AS agent_block FROM k GROUP BY 1),
f AS (SELECT l_orderkey, count(*) AS focuses FROM hr GROUP BY 1)
SELECT f.l_orderkey, 'order ' || f.l_orderkey AS query_text, focuses, coalesce(agents, 0) AS agents, coalesce(agent_block, '') AS agent_block FROM f LEFT JOIN a ON a.l_orderkey = f.l_orderkey""")
def slot_payloads(spark, d):
    m = table(spark, d, "part").select(F.lit("agent").alias("attribute"), F.col("p_partkey").alias("conceptId"), (F.col("p_size") % 3 != 0).alias("allowed"))
    items = _hits(spark, d).select("l_orderkey", F.col("hits").alias("focus"), F.col("hits").alias("agent"))
    p = pl.payload(pl.filter_slots(items, ["l_orderkey"], ["focus", "agent"], m), F.concat(F.lit(" order "), F.col("l_orderkey").cast("string")), ["focus", "agent"], 2)
    return p.select("l_orderkey", "query_text", F.col("focus_count").cast("long").alias("focuses"), F.col("agent_count").cast("long").alias("agents"), "agent_block")


@plan(f"""WITH {_HITS}, c AS (SELECT o_orderkey, hits, CASE WHEN o_orderstatus = 'F' THEN CAST(hits[1].id AS VARCHAR) WHEN o_orderstatus = 'P' THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS fill FROM orders JOIN h ON l_orderkey = o_orderkey)
SELECT o_orderkey, fill, coalesce(list_filter(hits, lambda x: CAST(x.id AS VARCHAR) = fill)[1].label, 'N/A') AS term FROM c""")
def normal_fills(spark, d):
    """Fills as plain ids, as JSON objects and as ids that are no candidate's."""
    o = table(spark, d, "orders").join(_hits(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    fill = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"id": "'), F.get("hits", F.lit(0))["id"].cast("string"), F.lit('", "term": "t"}'))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string"))
    f = pl.normal_fills({"severity": fill}, {"severity": F.col("hits")})["severity"]
    return o.select("o_orderkey", f["id"].alias("fill"), f["term"].alias("term"))


@plan(f"""WITH {_HITS} SELECT o_orderkey, CASE WHEN len(list_filter(hits, lambda x: x.id = o_custkey)) > 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'N/A' END AS id,
coalesce(list_filter(hits, lambda x: x.id = o_custkey)[1].label, 'N/A') AS term, coalesce(list_filter(hits, lambda x: x.id % 7 = 1)[1].label, 'N/A') AS other FROM orders JOIN h ON l_orderkey = o_orderkey""")
def checked_choice(spark, d):
    o = table(spark, d, "orders").join(_hits(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    c = pl.checked(F.col("o_custkey").cast("string"), F.col("hits"))
    one = F.get(F.filter("hits", lambda x: x["id"] % 7 == 1), F.lit(0))["id"].cast("string")
    return o.select("o_orderkey", c["id"].alias("id"), c["term"].alias("term"), pl.label_of(F.col("hits"), F.coalesce(one, F.lit("none"))).alias("other"))


def _fill(spark, d):
    """Orders with a focus and one fill, some of them no numbers, and a decision."""
    o = table(spark, d, "orders")
    focus = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("f"), F.col("o_custkey"))).when(F.col("o_custkey") % 11 == 0, "N/A").otherwise(F.col("o_custkey").cast("string"))
    agent = F.when(F.col("o_orderkey") % 5 == 0, "abc").when(F.col("o_orderkey") % 3 == 0, "N/A").otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", "o_orderstatus", focus.alias("focus"), F.create_map(F.lit("agent"), F.struct(agent.alias("id"), F.lit("a term").alias("term"))).alias("fills"))


_FILL = """f AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'f' || o_custkey WHEN o_custkey % 11 = 0 THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR) END AS focus,
CASE WHEN o_orderkey % 5 = 0 THEN 'abc' WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE CAST(o_orderkey AS VARCHAR) END AS agent FROM orders)"""


@plan(f"""WITH {_FILL} SELECT o_orderkey, CASE WHEN focus LIKE 'f%' THEN 'N/A' ELSE focus END AS focus, CASE WHEN agent = 'abc' THEN 'N/A' ELSE agent END AS agent,
CASE WHEN agent = 'abc' THEN 'N/A' ELSE 'a term' END AS term, CASE WHEN focus LIKE 'f%' OR focus = 'N/A' OR agent = 'abc' THEN 'N/A' ELSE 'POSTCOORD_OK' END AS decision FROM f""")
def reset_faulty_ids(spark, d):
    r = pl.reset_ids(F.col("focus"), F.col("fills"), F.lit("POSTCOORD_OK"))
    x = _fill(spark, d).select("o_orderkey", r.alias("r"))
    return x.select("o_orderkey", "r.focus", F.col("r.fills")["agent"]["id"].alias("agent"), F.col("r.fills")["agent"]["term"].alias("term"), "r.decision")


@plan(f"""WITH {_FILL}, s AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'DIRECT' WHEN 'O' THEN 'POSTCOORD' ELSE 'UNRESOLVED' END AS status FROM f)
SELECT o_orderkey, CASE status WHEN 'DIRECT' THEN 'verified' WHEN 'POSTCOORD' THEN 'postcoord' ELSE 'unresolved' END AS mapping_source,
CASE status WHEN 'DIRECT' THEN CAST(o_orderkey AS VARCHAR) WHEN 'POSTCOORD' THEN focus ELSE 'N/A' END AS final_concept_id, CASE status WHEN 'DIRECT' THEN 'direct' WHEN 'POSTCOORD' THEN 'focus' ELSE 'N/A' END AS final_concept_term,
CASE status WHEN 'DIRECT' THEN CAST(o_orderkey AS VARCHAR) WHEN 'POSTCOORD' THEN focus || ':x' ELSE 'N/A' END AS postcoord_expression,
CASE WHEN status = 'POSTCOORD' AND agent <> 'N/A' THEN 'agent=' || agent ELSE '' END AS attributes FROM s""")
def aggregated_items(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "DIRECT").when(F.col("o_orderstatus") == "O", "POSTCOORD").otherwise("UNRESOLVED")
    cols = pl.aggregated(status, (F.col("o_orderkey"), F.lit("direct")), (F.col("focus"), F.lit("focus")), F.concat("focus", F.lit(":x")), F.col("fills"))
    x = _fill(spark, d).select("o_orderkey", *cols)
    return x.withColumn("attributes", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["id"])), ","))


@plan("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'POSTCOORD_OK' WHEN 'O' THEN 'UNMAPPABLE' ELSE 'N/A' END AS decision FROM orders")
def triage_field(spark, d):
    said = F.when(F.col("o_orderstatus") == "F", " postcoord_ok ").when(F.col("o_orderstatus") == "O", "Unmappable").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", pl.triage(said).alias("decision"))


@plan("""SELECT DISTINCT o_custkey AS term, l_partkey AS rxcui, p_name AS name, l_returnflag AS tty FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('A', 'R')""")
def ingredient_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag").join(p, "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    terms = li.groupBy(F.col("o_custkey").alias("term")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("rxcui"), F.col("p_name").alias("name"), F.col("l_returnflag").alias("tty"))).alias("parts"))
    return pl.ingredients(terms, "term", "parts", ["A", "R"])


@plan(f"""WITH {_ROWS}, top AS (SELECT * FROM hr WHERE pos <= 2) SELECT l_orderkey AS query, string_agg(id || ':' || (id // 2), ', ' ORDER BY pos) AS exemplars FROM (
SELECT l_orderkey, id, pos FROM top WHERE l_orderkey % 2 = 1 UNION ALL SELECT l_orderkey, id, pos FROM hr WHERE l_orderkey % 2 = 0 AND pos = 2
UNION ALL SELECT l_orderkey, id, pos FROM top WHERE l_orderkey % 2 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM hr WHERE pos = 2)) GROUP BY 1""")
def exemplar_payload(spark, d):
    """Even orders have their second candidate as exemplar; odd ones, and those without a second, fall back to the top."""
    ranked = _hits(spark, d).select(F.col("l_orderkey").alias("query"), F.posexplode("hits").alias("pos", "h")).select("query", F.col("h.id").alias("node"), (F.col("pos") + 1).alias("rank"))
    chosen = ranked.filter("query % 2 = 0 and rank = 2")
    expressions = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr("cast(p_partkey div 2 as string)").alias("expression"))
    e = pl.exemplar_payload(ranked, chosen, expressions, "query", 2)
    return e.select("query", F.array_join(F.transform("exemplars", lambda x: F.concat_ws(":", x["node"].cast("string"), x["expression"])), ", ").alias("exemplars"))


@plan("SELECT o_orderkey, o_orderstatus = 'F' AS pattern_found, CASE WHEN o_orderstatus = 'F' THEN 'e' || o_orderkey ELSE '' END AS expression FROM orders")
def exemplar_answers(spark, d):
    said = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("pattern_found"), F.concat(F.lit("e"), F.col("o_orderkey")).alias("expression")))
    a = table(spark, d, "orders").select("o_orderkey", pl.exemplar_answer(said).alias("a"))
    return a.select("o_orderkey", "a.*")


@plan("SELECT item_id, 'Fill these fields from the text, '''' where it says nothing.' || chr(10) || '- agent: what it is about' || chr(10) || '- course: how it runs' || chr(10) || 'Text: ' || text || chr(10) || 'Answer with one JSON object.' AS prompt FROM benchmark")
def fields_prompts(spark, d):
    from ..operators import mapping as mp

    t = pl.fields_prompt({"agent": "what it is about", "course": "how it runs"})
    return mp.prompts(table(spark, d, "benchmark"), t, {"text": F.col("text")}).select("item_id", "prompt")


@plan(f"""WITH {_ROWS} SELECT l_orderkey, 'Choose the concept that means the same as the statement, or N/A if none does.' || chr(10) || 'Statement: order ' || l_orderkey || chr(10) || 'Candidates:' || chr(10)
|| string_agg(pos || '. ' || label || ' [' || id || ']', chr(10) ORDER BY pos) || chr(10) || 'Answer with JSON: {{"selected_id": ...}}' AS prompt FROM hr WHERE pos <= 5 GROUP BY 1""")
def task_prompts(spark, d):
    from ..operators import mapping as mp

    fields = {"text": F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), "candidates": pl.block(F.col("hits"), 5)}
    return mp.prompts(_hits(spark, d), pl.TEMPLATES["verify"], fields).select("l_orderkey", "prompt")


@plan(f"WITH {_ROWS} SELECT DISTINCT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS attribute, id AS conceptId FROM hr")
def candidate_pools(spark, d):
    h = _hits(spark, d).select(F.filter("hits", lambda x: x["id"] % 2 == 0).alias("even"), F.filter("hits", lambda x: x["id"] % 2 == 1).alias("odd"))
    return fr.pools(h, ["even", "odd"])


@plan(f"WITH {_ROWS}, o AS (SELECT o_custkey, id, o_orderkey, pos FROM hr JOIN orders ON l_orderkey = o_orderkey) SELECT o_custkey AS key, string_agg(id, ',' ORDER BY o_orderkey, pos) AS vals FROM o GROUP BY 1")
def flat_groups(spark, d):
    h = _hits(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), F.transform("hits", lambda x: x["id"]).alias("ids"))
    f = fr.flat_lists(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")).join(h, "o_orderkey"), "key", "ids", ["o_orderkey"])
    return f.select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("vals"))


@plan("SELECT o_orderkey, o_custkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN 'N/A ' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END LIKE 'N/A%'")
def problem_rows(spark, d):
    e = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("N/A "), F.col("o_orderkey"))).otherwise(F.col("o_custkey").cast("string"))
    return fr.problems(table(spark, d, "orders").withColumn("expression", e), "expression").select("o_orderkey", "o_custkey")


@plan("SELECT o_orderkey, o_orderstatus = 'O' OR o_orderstatus = 'F' AS evaluable, o_custkey % 4 = 0 AS ignored FROM orders")
def evaluable_rows(spark, d):
    o = table(spark, d, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "S").when(F.col("o_orderstatus") == "F", "PO").otherwise("X").alias("state"), F.when(F.col("o_custkey") % 4 == 0, " n/a ").otherwise(F.col("o_custkey").cast("string")).alias("concept"))
    return fr.evaluable(o, "state", "concept").select("o_orderkey", "evaluable", "ignored")


@plan("""WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) AS n FROM documents GROUP BY 1) SELECT doc_id, d.source FROM documents d JOIN f ON f.source = d.source WHERE n = 3""")
def nth_distinct_rows(spark, d):
    return fr.nth_distinct(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@plan("""SELECT a.o_orderkey, a.o_custkey, a.l AS label_x, b.l AS label_y, coalesce(a.l = b.l, false) AS same FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS l FROM orders) a
LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS l FROM customer WHERE c_custkey % 3 <> 0) b ON o_custkey = c_custkey""")
def suffix_equal_join(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("label"))
    b = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "O").otherwise("F").alias("label"))
    return fr.join_compared(a, b, ["o_custkey"], "label")


@plan("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def shard_restore(spark, d):
    """Orders dealt to four shards, each handled by itself, and put back in order."""
    from pyspark.sql import Window

    dealt = fr.shard(table(spark, d, "orders").select("o_orderkey"), 4, ["o_orderkey"])
    back = fr.restore_order([dealt.filter(F.col("shard") == k).select("o_orderkey", (F.col("o_orderkey") * 1).alias("at")) for k in (3, 1, 0, 2)], "at")
    return back.select("o_orderkey", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@plan(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '[0-9]+'), regexp_extract_all(coalesce(source, ''), '[0-9]+'), [CAST(doc_id AS VARCHAR)]))), '|') AS ids,
array_to_string(list_sort(list_distinct(list_filter([trim(coalesce(lang, '')), source], lambda x: upper(x) NOT IN ('', 'NA', 'N/A')))), '|') AS present FROM documents""")
def union_id_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.id_set(T.union_ids([F.col("text"), F.col("source"), F.col("doc_id").cast("string")])).alias("ids"), T.id_set(T.present_ids([F.col("lang"), F.col("source")])).alias("present"))


def _labels(spark, d):
    """A label document per customer: a title that may be blank, two coded sections, one of them not in all."""
    c = table(spark, d, "customer")
    title = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name"))
    product = F.concat(F.lit("<component><section><code code='48780-1'/><subject><manufacturedProduct><manufacturedProduct><name>Product\n  "), F.col("c_custkey"), F.lit("</name></manufacturedProduct></manufacturedProduct></subject></section></component>"))
    contra = F.concat(F.lit('<component><section ID="s4"><id/><code code="34070-3" codeSystem="x"/><title>T</title><text><paragraph>Not with <content>'), F.col("c_mktsegment"), F.lit("</content> .</paragraph><list><item>one</item><item>two</item></list></text></section></component>"))
    other = F.concat(F.lit('<component><section><code code="1-8"/><text>Nation '), F.col("c_nationkey"), F.lit("<br/>end</text></section></component>"))
    xml = F.concat(F.lit('<document xmlns="urn:hl7-org:v3"><title>'), title, F.lit("</title>"), F.when(F.col("c_custkey") % 3 == 0, product).otherwise(""), other, F.when(F.col("c_custkey") % 5 != 0, contra).otherwise(""), F.lit("</document>"))
    return c.select("c_custkey", xml.alias("xml"))


_CONTRA = "'Not with ' || c_mktsegment || '.' || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || 'two'"
_NAME = "CASE WHEN c_custkey % 3 = 0 THEN 'Product ' || c_custkey WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END"


@plan(f"SELECT c_custkey, {_NAME} AS product_name, true AS found, CASE WHEN c_custkey % 5 <> 0 THEN {_CONTRA} END AS contra FROM customer")
def label_sections(spark, d):
    s = sc.sections(_labels(spark, d), "c_custkey", "xml", ["34070-3", "1-8"])
    return s.select("c_custkey", "product_name", "found", F.try_element_at("sections", F.lit("34070-3")).alias("contra"))


@plan(f"""SELECT c_custkey, '1-8' AS code, 'Nation ' || c_nationkey || chr(10) || 'end' AS section_text FROM customer UNION ALL SELECT c_custkey, '34070-3', {_CONTRA} FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, '48780-1', '' FROM customer WHERE c_custkey % 3 = 0""")
def coded_sections(spark, d):
    return sc.coded_sections(_labels(spark, d), "c_custkey", "xml").drop("pos")


@plan(f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own text' WHEN c_custkey % 5 <> 0 THEN {_CONTRA} ELSE '' END AS section_text, c_custkey % 2 = 0 OR c_custkey % 5 <> 0 AS found,
CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 <> 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'extract_section_failed: timeout' ELSE 'section_not_found' END AS error FROM customer""")
def resolved_sections(spark, d):
    """Even customers bring their own text; of the others, some have no section and some cannot be fetched."""
    records = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, " own text ").alias("contra_text"))
    fetched = _labels(spark, d).select("c_custkey", sc.section_text(F.col("xml"), "34070-3").alias("section_text"), F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 5 == 0), "timeout").alias("error"))
    return sc.resolved(records, fetched, "c_custkey", ["contra_text"]).drop("contra_text")


@plan("""WITH m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT coalesce(n, 0) AS n FROM customer LEFT JOIN m ON o_custkey = c_custkey)
SELECT count(*) AS sections, count(*) FILTER (WHERE n > 0) AS with_mention, count(*) FILTER (WHERE n = 0) AS without_mention, CAST(sum(n) AS BIGINT) AS mentions, round(avg(n), 3) AS mean_per_section FROM p""")
def section_summary(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("x").alias("code"))
    mentions = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit("x").alias("code"))
    return sc.corpus_summary(docs, mentions, "id")


@plan(f"WITH {graphs._E} SELECT DISTINCT child AS node FROM e WHERE child NOT IN (SELECT parent FROM e)")
def class_leaves(spark, d):
    return fr.leaves(graphs._edges(spark, d))


@plan(f"""WITH RECURSIVE {graphs._E}, w(node, path, spot) AS (SELECT p_partkey, [p_partkey], p_partkey FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT w.node, list_append(w.path, e.parent), e.parent FROM w JOIN e ON w.spot = e.child WHERE len(w.path) <= 4 AND NOT list_contains(w.path, e.parent))
SELECT DISTINCT node, array_to_string(path, '>') AS path FROM w WHERE len(path) > 1""")
def simple_paths(spark, d):
    p = g.simple_paths(graphs._nodes(spark, d).filter("node % 20 = 0"), graphs._edges(spark, d), 4)
    return p.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@plan(f"""WITH RECURSIVE {graphs._C}, f AS (SELECT p_partkey AS focus FROM part WHERE p_partkey % 3 = 0), r AS (SELECT focus, focus AS root FROM f UNION SELECT focus, ancestor FROM f JOIN c ON node = focus),
dm AS (SELECT 'd2' AS domain, 2 AS root UNION ALL SELECT 'd3', 3), att AS (SELECT 'd2' AS domain, 246112005 AS attribute UNION ALL SELECT 'd3', 246112005 UNION ALL SELECT 'd3', 246075003),
rg AS (SELECT 246112005 AS attribute, '<< 5' AS c UNION ALL SELECT 246075003, '< 7')
SELECT DISTINCT focus, attribute, c AS "constraint" FROM r JOIN dm USING (root) JOIN att USING (domain) JOIN rg USING (attribute)""")
def attribute_ranges(spark, d):
    make = spark.createDataFrame
    focus = graphs._nodes(spark, d).filter("node % 3 = 0").select(F.col("node").alias("focus"))
    domains = make([("d2", 2), ("d3", 3)], "domain string, root long")
    attributes = make([("d2", 246112005), ("d3", 246112005), ("d3", 246075003)], "domain string, attribute int")
    ranges = make([(246112005, "<< 5"), (246075003, "< 7")], "attribute int, constraint string")
    return g.attribute_ranges(focus, g.below(graphs._edges(spark, d), [2, 3]), domains, attributes, ranges)


def _relations(spark, d):
    p = table(spark, d, "part").filter("p_partkey > 3")
    own = p.select(F.col("p_partkey").alias("sourceId"), F.lit(116680003).cast("long").alias("typeId"), F.expr("p_partkey div 2").alias("destinationId"), F.lit(0).alias("relationshipGroup"))
    more = p.select(F.col("p_partkey").alias("sourceId"), F.lit(1).cast("long").alias("typeId"), F.expr("p_partkey div 3").alias("destinationId"), F.lit(1).alias("relationshipGroup"))
    labels = table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("conceptId"), F.concat("p_name", F.lit(" (part)")).alias("term"))
    return own.unionByName(more), labels


@plan("""WITH n AS (SELECT p_partkey AS id, p_name AS t FROM part WHERE p_partkey % 10 <> 0), r AS (SELECT p_partkey AS s, 116680003 AS ty, p_partkey // 2 AS de, 0 AS g FROM part WHERE p_partkey > 3 UNION ALL SELECT p_partkey, 1, p_partkey // 3, 1 FROM part WHERE p_partkey > 3)
SELECT CAST(s AS VARCHAR) AS sourceId, CAST(ty AS VARCHAR) AS typeId, CAST(de AS VARCHAR) AS destinationId, coalesce(a.t, CAST(ty AS VARCHAR)) AS typeId_term, coalesce(b.t, CAST(de AS VARCHAR)) AS destinationId_term, g AS relationshipGroup FROM r LEFT JOIN n a ON a.id = ty LEFT JOIN n b ON b.id = de""")
def labelled_relations(spark, d):
    return g.labelled_relations(*_relations(spark, d))


@plan("""WITH n AS (SELECT p_partkey AS id, ' |' || p_name || ' (part)|' AS t FROM part WHERE p_partkey % 10 <> 0), p AS (SELECT p_partkey AS s FROM part WHERE p_partkey > 3)
SELECT s AS sourceId, (s // 2) || coalesce(a.t, '') || ' : {1' || coalesce(x.t, '') || ' = ' || (s // 3) || coalesce(b.t, '') || '}' AS expression FROM p LEFT JOIN n a ON a.id = s // 2 LEFT JOIN n b ON b.id = s // 3 LEFT JOIN n x ON x.id = 1""")
def scg_labelled(spark, d):
    r, labels = _relations(spark, d)
    return g.composition(r, 116680003, labels)


@plan("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, d):
    """The first rows: the limit is the feature."""
    return fr.sample_rows(table(spark, d, "documents").select("doc_id"), 25, ["doc_id"])


@plan("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 10)")
def first_groups(spark, d):
    """All rows of the first ids: the limit is the feature."""
    return fr.sample_groups(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 10)
