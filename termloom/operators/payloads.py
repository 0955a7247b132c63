"""Candidate lists, slots, payloads and results of items: what goes to a model and what is kept of its answers.

A candidate list is an array of struct(id, label); slots name such lists. Everything is a column or a join; the model
itself is a function given to mapping.chat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .mapping import NOT_FOUND, prefilter

#: The attributes of an expression, and the slots whose candidates fill them.
ATTRIBUTES = {"causative_agent": 246075003, "severity": 246112005, "clinical_course": 263502005}
#: What a triage may decide.
TRIAGE = ["POSTCOORD_OK", "NEEDS_CONSTRAINTS", "UNMAPPABLE"]
#: Fixed names of the columns of an aggregated item.
AGGREGATED = ["mapping_source", "final_concept_id", "final_concept_term", "postcoord_expression"]

TEMPLATES = {
    "verify": "Choose the concept that means the same as the statement, or N/A if none does.\nStatement: {text}\nCandidates:\n{candidates}\nAnswer with JSON: {\"selected_id\": ...}",
    "fill": "Choose the focus of the statement and a value for each attribute, or N/A.\nStatement: {text}\nFocus:\n{focus}\nAgents:\n{causative_agent}\nSeverities:\n{severity}\nCourses:\n{clinical_course}",
    "split": "Split the statement into statements that each name one condition, as a JSON list.\nStatement: {text}",
    "pick": "Name the one of these ontologies that fits the term, or NONE.\nTerm: {text}\nOntologies:\n{candidates}",
    "reactions": "List the adverse reactions that the section reports, as a JSON list.\nSection: {text}",
}


def clean_hits(hits: Column) -> Column:
    """Candidates that have an id and a label, both as text; null gives an empty list."""
    kept = F.filter(F.coalesce(hits, F.array().cast("array<struct<id:bigint,label:string>>")), lambda h: h["id"].isNotNull() & h["label"].isNotNull())
    return F.transform(kept, lambda h: F.struct(h["id"].cast("string").alias("id"), h["label"].cast("string").alias("label")))


def project_hits(hits: Column, keys: list[str]) -> Column:
    """A candidate list as JSON with the chosen fields alone."""
    return F.to_json(F.transform(hits, lambda h: F.struct(*(h[k].alias(k) for k in keys))))


def label_of(hits: Column, ident: Column) -> Column:
    """The label of the candidate with the id, N/A without one."""
    return F.coalesce(F.get(F.filter(hits, lambda h: h["id"].cast("string") == ident), F.lit(0))["label"], F.lit(NOT_FOUND))


def block(hits: Column, n: int = 10) -> Column:
    """The first n candidates as numbered lines 'k. label [id]'."""
    lines = F.transform(F.slice(hits, 1, n), lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["label"], F.lit(" ["), h["id"].cast("string"), F.lit("]")))
    return F.array_join(lines, "\n")


def route_slots(state: Column, statement: Column, others: dict[str, Column]) -> dict[str, Column]:
    """The lists of an item's slots: the focus from the state's hits or else the statement's, direct from the
    statement's, others as they are; none is null."""
    empty = F.array().cast("array<struct<id:bigint,label:string>>")
    some = lambda c: F.coalesce(c, empty)
    return {"focus": F.when(F.size(some(state)) > 0, state).otherwise(some(statement)), "direct": some(statement), **{k: some(v) for k, v in others.items()}}


def unresolved(mapped: DataFrame, verified: DataFrame, keys: list[str], selected: str = "selected_id") -> DataFrame:
    """mapped rows of the items that verification left at N/A, with the verified text; the last verified row of a key
    counts."""
    open_ = verified.filter(F.col(selected) == NOT_FOUND).groupBy(*keys).agg(F.max_by("query_text", "seq").alias("verified_text"))
    return mapped.join(open_, keys)


def filter_slots(items: DataFrame, keys: list[str], slots: list[str], memberships: DataFrame) -> DataFrame:
    """items with each slot's list cut to what its attribute's memberships (attribute, conceptId, allowed) allow, order
    kept; a slot without memberships stays whole. Lists become rows and are gathered again, so neither the memberships
    nor the lists of many items meet in one task."""
    long_ = items.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("attribute"), F.col(s).alias("hits")) for s in slots))).alias("s"))
    rows = long_.select(*keys, "s.attribute", F.posexplode("s.hits").alias("pos", "h")).select(*keys, "attribute", "pos", F.col("h.id").alias("conceptId"), F.col("h.label").alias("label"))
    kept = prefilter(rows, memberships)[0]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("conceptId").alias("id"), "label"))), lambda s: F.struct(s["id"].alias("id"), s["label"].alias("label")))
    lists = kept.groupBy(*keys, "attribute").agg(ordered.alias("hits")).groupBy(*keys).agg(*(F.first(F.when(F.col("attribute") == s, F.col("hits")), ignorenulls=True).alias(f"{s}__") for s in slots))
    joined = items.join(lists, keys, "left")
    kinds = dict(items.dtypes)
    return joined.select(*(F.coalesce(f"{c}__", F.array().cast(kinds[c])).alias(c) if c in slots else F.col(c) for c in items.columns))


def payload(items: DataFrame, text: Column, slots: list[str], n: int = 10) -> DataFrame:
    """items with query_text, each slot's block of lines, and the number of its candidates."""
    out = {"query_text": F.trim(F.coalesce(text, F.lit("")))}
    for s in slots:
        out[f"{s}_block"], out[f"{s}_count"] = block(F.col(s), n), F.size(s)
    return items.withColumns(out)


def normal_fill(value: Column) -> Column:
    """A fill's id: the id field of a JSON object, else the value; N/A for null."""
    v = F.trim(value)
    return F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.id"), F.lit(NOT_FOUND))).otherwise(F.coalesce(v, F.lit(NOT_FOUND)))


def normal_fills(fills: dict[str, Column], lists: dict[str, Column]) -> Column:
    """MAP<name, struct(id, term)> of fills with the labels that their slots' candidates give."""
    entries = []
    for name, value in fills.items():
        ident = normal_fill(value)
        entries += [F.lit(name), F.struct(ident.alias("id"), label_of(lists[name], ident).alias("term"))]
    return F.create_map(*entries)


def checked(ident: Column, hits: Column) -> Column:
    """struct(id, term): the id if it is one of the candidates', else N/A for both."""
    term = label_of(hits, ident)
    known = F.exists(hits, lambda h: h["id"].cast("string") == ident)
    none = F.struct(F.lit(NOT_FOUND).alias("id"), F.lit(NOT_FOUND).alias("term"))
    return F.when(known, F.struct(ident.alias("id"), term.alias("term"))).otherwise(none)


def reset_ids(focus: Column, fills: Column, decision: Column) -> Column:
    """struct(focus, fills, decision): ids that are neither N/A nor numbers become N/A, and so does the decision if the
    focus is missing or any id was no number."""
    bad = lambda c: (c != NOT_FOUND) & ~c.rlike("^[0-9]+$")
    f = F.coalesce(focus, F.lit(NOT_FOUND))
    none = F.struct(F.lit(NOT_FOUND).alias("id"), F.lit(NOT_FOUND).alias("term"))
    faulty = (f == NOT_FOUND) | bad(f) | F.exists(F.map_values(fills), lambda v: bad(v["id"]))
    good = F.transform_values(fills, lambda _, v: F.when(bad(v["id"]), none).otherwise(v))
    return F.struct(F.when(bad(f), NOT_FOUND).otherwise(f).alias("focus"), good.alias("fills"), F.when(faulty, NOT_FOUND).otherwise(F.coalesce(decision, F.lit(NOT_FOUND))).alias("decision"))


def aggregated(status: Column, direct: tuple[Column, Column], focus: tuple[Column, Column], expression: Column, fills: Column) -> list[Column]:
    """The AGGREGATED columns and attributes (MAP<name, struct(id, term)>) of an item's result."""
    s = F.coalesce(status, F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(NOT_FOUND))
    composed = s.isin("POSTCOORD", "MINIMAL")
    pick = lambda d, c: F.when(s == "DIRECT", text(d)).when(composed, text(c)).otherwise(NOT_FOUND)
    source = F.when(s == "DIRECT", "verified").when(s == "", "unmapped").otherwise(F.lower(s))
    none = F.create_map().cast("map<string,struct<id:string,term:string>>")
    attributes = F.when(composed, F.map_filter(fills, lambda _, v: v["id"] != NOT_FOUND)).otherwise(none)
    values = [source, pick(direct[0], focus[0]), pick(direct[1], focus[1]), pick(direct[0], expression)]
    return [v.alias(n) for n, v in zip(AGGREGATED, values, strict=True)] + [attributes.alias("attributes")]


def triage(decision: Column) -> Column:
    """A triage's decision, N/A for anything that is none."""
    d = F.upper(F.trim(F.coalesce(decision, F.lit(""))))
    return F.when(d.isin(*TRIAGE), d).otherwise(NOT_FOUND)


def ingredients(terms: DataFrame, ident: str, parts: str, kinds: list[str]) -> DataFrame:
    """(ident, rxcui, name, tty) of the parts (array of struct) whose term type is one of kinds."""
    rows = terms.select(ident, F.explode(parts).alias("p")).select(ident, "p.*")
    return rows.filter(F.col("tty").isin(*kinds)).distinct()


def exemplar_payload(ranked: DataFrame, exemplars: DataFrame, expressions: DataFrame, query: str, n: int = 8) -> DataFrame:
    """(query, exemplars): per query the exemplars' (node, expression) in rank order; the best-ranked candidates where a
    query has no exemplar. ranked and exemplars have (query, node, rank), expressions (node, expression)."""
    have = exemplars.select(query).distinct()
    rest = ranked.join(have, query, "left_anti").filter(F.col("rank") <= n)
    chosen = exemplars.select(query, "node", "rank").unionByName(rest.select(query, "node", "rank"))
    named = chosen.join(expressions, "node", "left")
    return named.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node", "expression"))), lambda s: F.struct(s["node"].alias("node"), s["expression"].alias("expression"))).alias("exemplars"))


def exemplar_answer(answer: Column) -> Column:
    """struct(pattern_found, expression) of a JSON answer; the expression is '' where no pattern was found."""
    found = T.lenient_bool(F.get_json_object(answer, "$.pattern_found"))
    return F.struct(found.alias("pattern_found"), F.when(found, F.coalesce(F.get_json_object(answer, "$.expression"), F.lit(""))).otherwise("").alias("expression"))


def fields_prompt(fields: dict[str, str]) -> str:
    """A template that asks for the given fields (name: what it holds) of {text}, as JSON."""
    return "\n".join(["Fill these fields from the text, '' where it says nothing.", *(f"- {k}: {v}" for k, v in fields.items()), "Text: {text}", "Answer with one JSON object."])
