"""Mapping of items to concepts: prefilter, verification, slot filling, expressions, aggregation, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import frames

NOT_FOUND = "N/A"


def range_constraints(ranges: DataFrame, content_type: int | None) -> DataFrame:
    """(attribute, constraints): trimmed non-blank constraints; the content type only chooses where several rows stand."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("attribute"))
    r = ranges.withColumn("n__", n)
    if content_type is not None:
        r = r.filter((F.col("n__") == 1) | (F.col("content_type") == content_type))
    return frames.present(r, "constraint").groupBy("attribute").agg(F.array_sort(F.collect_set("constraint")).alias("constraints"))


def prefilter(candidates: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, diagnostics): candidates (attribute, conceptId, ...) that the membership table (attribute, conceptId,
    allowed) allows; ids it lacks are not members; attributes without any row pass. Diagnostics count per attribute."""
    m = memberships.groupBy("attribute", "conceptId").agg(F.bool_or("allowed").alias("allowed"))
    constrained = memberships.select("attribute").distinct().withColumn("constrained", F.lit(True))
    joined = candidates.join(m, ["attribute", "conceptId"], "left").join(constrained, "attribute", "left")
    keep = F.coalesce("allowed", F.col("constrained").isNull())
    stats = joined.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(F.col("allowed").isNotNull()).alias("cache_hits"),
        F.count_if(F.col("allowed").isNull()).alias("cache_misses"),
        F.count_if(keep).alias("kept"),
        F.count_if(~keep).alias("dropped"),
    )
    return joined.filter(keep).drop("allowed", "constrained"), stats


def membership_stats(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("attribute").agg(F.countDistinct("conceptId").alias("concept_count"), F.count_if("allowed").alias("allowed_count"), F.count_if(F.col("allowed").isNull()).alias("error_count"))


def verify_choice(choice: Column, candidate_ids: Column, candidate_labels: Column, text: Column) -> Column:
    """The chosen id if it is a candidate's, else the id of the candidate whose label equals the text, else N/A."""
    same = F.try_element_at(F.map_from_entries(F.transform(F.arrays_zip(candidate_labels.alias("l"), candidate_ids.alias("i")), lambda s: F.struct(F.lower(F.trim(s["l"])), s["i"].cast("string")))), F.lower(F.trim(text)))
    ids = F.transform(candidate_ids, lambda i: i.cast("string"))
    return F.when(F.array_contains(ids, choice), choice).otherwise(F.coalesce(same, F.lit(NOT_FOUND)))


def focus_or_first(choice: Column, candidate_ids: Column) -> Column:
    """The chosen focus, or the first candidate where none was chosen."""
    c = T.blank_missing(choice)
    return F.when(c != "", c).otherwise(F.coalesce(F.get(candidate_ids, F.lit(0)).cast("string"), F.lit(NOT_FOUND)))


def id_faults(focus: Column, fills: dict[str, Column]) -> Column:
    """Reason codes of ids that are missing or not numeric."""
    f = T.blank_missing(focus)
    faults = [F.when(f == "", "FOCUS_MISSING").when(~f.rlike("^[0-9]+$"), "FOCUS_NOT_NUMERIC")]
    for name, c in fills.items():
        v = T.blank_missing(c)
        faults.append(F.when((v != "") & ~v.rlike("^[0-9]+$"), f"{name.upper()}_NOT_NUMERIC"))
    return F.array_compact(F.array(*faults))


def compose(focus: Column, fills: list[tuple[Column, Column]]) -> Column:
    """'focus:{attribute=value,...}' of the fills that are there; the focus alone if none is; null without a focus."""
    parts = F.array_compact(F.array(*(F.when(T.blank_missing(v.cast("string")) != "", F.concat_ws("=", a.cast("string"), v.cast("string"))) for a, v in fills)))
    return F.when(F.size(parts) == 0, focus.cast("string")).otherwise(F.concat(focus.cast("string"), F.lit(":{"), F.array_join(parts, ","), F.lit("}")))


def focus_of(expression: Column) -> Column:
    """The focus id an expression begins with; null if that is no number."""
    head = F.trim(F.substring_index(expression, ":", 1))
    return F.when(head.rlike("^[0-9]+$"), head)


def status(direct: Column, expression: Column) -> Column:
    return F.when(T.blank_missing(direct.cast("string")) != "", "DIRECT").when(expression.contains(":"), "POSTCOORD").otherwise("MINIMAL")


def merge_verified(verified: DataFrame, composed: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Each verified item with its final concept: its own, or where that is N/A the composed one of the same keys. The
    last composed row by `seq` wins. If strict, an item without either raises an error."""
    last = frames.first_by(composed, keys, [F.desc("seq")]).select(*keys, "focus_id", "expression")
    joined = verified.join(last, keys, "left")
    own = T.blank_missing(F.col("selected_id").cast("string"))
    missing = F.raise_error(F.lit("no composed row for an unverified item")).cast("string") if strict else F.lit(NOT_FOUND)
    final = F.when(own != "", own).when(F.col("focus_id").isNotNull(), F.col("focus_id").cast("string")).otherwise(missing)
    return joined.select(*verified.columns, F.when(own != "", "verified").otherwise("postcoord").alias("mapping_source"), final.alias("final_concept_id"), F.when(own == "", F.col("expression")).alias("expression"))


def attribute_columns(fills: Column, names: list[str]) -> list[Column]:
    """Flat <name>_id and <name>_term columns of a MAP<STRING, STRUCT<id, term>>; missing ones are ''."""
    out = []
    for n in names:
        s = F.try_element_at(fills, F.lit(n))
        out += [F.coalesce(s["id"].cast("string"), F.lit("")).alias(f"{n}_id"), F.coalesce(s["term"], F.lit("")).alias(f"{n}_term")]
    return out


def nested_schema(focus: Column, fills: Column) -> Column:
    """MAP<focus, MAP<attribute, value>> of the fills that are there."""
    return F.create_map(focus, F.map_filter(fills, lambda _, v: v.isNotNull() & (v != "")))


def prompts(items: DataFrame, template: str, fields: dict[str, Column], out: str = "prompt") -> DataFrame:
    """items with a template's {names} filled."""
    c = F.lit(template)
    for name, value in fields.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return items.withColumn(out, c)


def chat(items: DataFrame, prompt: str, out: str, chat_fn: Callable[[str, int], str], budgets: tuple[int, ...] = (1024, 2048, 4096), done: Callable[[str], bool] = lambda t: "<<END_JSON>>" in t) -> DataFrame:
    """items with the answer of an injected model call, asked again with a larger budget until the end mark comes."""

    @F.pandas_udf("string")
    def run(prompts_):
        def ask(p):
            answer = ""
            for b in budgets:
                answer = chat_fn(p, b)
                if done(answer):
                    break
            return answer

        return prompts_.map(ask)

    return items.withColumn(out, run(prompt))


def slots(items: DataFrame, names: dict[str, str], ident: list[str]) -> DataFrame:
    """Long form (ident, slot, query) of the slots' texts, blanks dropped."""
    pairs = F.explode(F.array(*(F.struct(F.lit(slot).alias("slot"), F.trim(c).alias("query")) for slot, c in names.items())))
    return items.select(*ident, pairs.alias("p")).select(*ident, "p.slot", "p.query").filter(F.col("query") != "")


def split_atoms(items: DataFrame, text: str, ident: list[str]) -> DataFrame:
    """One row per atomic statement of a coordinated text, numbered from 0; others stay whole."""
    parts = F.when(T.looks_coordinated(F.col(text)), F.filter(F.transform(F.split(text, r"\s*(?:,|\bor\b|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(F.trim(F.coalesce(text, F.lit("")))))
    return items.select(*ident, F.posexplode(parts).alias("atom_index", "atom"))


def audit_lookup(events: DataFrame, keys: dict[str, object], fields: list[str], order: list) -> DataFrame:
    """The first event, in the given order, that matches all keys."""
    for k, v in keys.items():
        events = events.filter(F.col(k) == v)
    return events.orderBy(*order).limit(1).select(*fields)


def best_substance(agent: Column, hits: Column) -> Column:
    """The hit (struct id, label) that names the substance best: equal, containing, sharing words; shorter is better."""
    a = F.lower(F.trim(agent))
    subs = F.filter(hits, lambda h: F.lower(h["label"]).contains("(substance)"))

    def score(h):
        label = F.trim(F.regexp_replace(F.lower(h["label"]), r"\s*\(substance\)\s*$", ""))
        words = F.size(F.array_intersect(F.split(a, " "), F.split(label, " ")))
        points = F.when(label == a, 100).otherwise(0) + F.when(label.contains(a), 10).otherwise(0) + words
        return F.struct(points.alias("points"), (-F.length(label)).alias("short"), (-h["id"]).alias("low"), h["id"].alias("id"), h["label"].alias("label"))

    return F.when(a != "", F.array_max(F.transform(subs, score)))


def decompose_hypersensitivity(text: Column, hits: Column, base: int, realization: int, process: int, agent_attribute: int) -> Column:
    """struct(template, direct_id, expression, agent, agent_id) of a statement and its hits (array of struct id, label)."""
    q = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    findings = F.filter(hits, lambda h: F.lower(h["label"]).contains("hypersensitivity") & F.lower(h["label"]).contains("(finding)"))
    words = F.split(F.lower(q), " ")
    best = F.array_max(F.transform(findings, lambda h: F.struct(F.exists(words, lambda w: F.lower(h["label"]).contains(w)).alias("named"), (-F.length(h["label"])).alias("short"), (-h["id"]).alias("low"), h["id"].alias("id"))))
    agent = T.hypersensitivity_agent(q)
    substance = best_substance(agent, hits)
    expression = F.concat(F.lit(f"{base}:{{{realization}={process},{agent_attribute}="), substance["id"].cast("string"), F.lit("}"))
    none = F.lit(NOT_FOUND)
    out = lambda template, direct, expr, a, i: F.struct(F.lit(template).alias("template"), direct.alias("direct_id"), expr.alias("expression"), a.alias("agent"), i.alias("agent_id"))
    return (
        F.when(~T.is_hypersensitivity(q), out("NOT_HYPERSENSITIVITY", none, none, none, none))
        .when(F.size(findings) > 0, out("T1_HYPERSENSITIVITY_DIRECT", best["id"].cast("string"), none, none, none))
        .otherwise(out("T1_HYPERSENSITIVITY_POSTCOORD", none, F.coalesce(expression, none), F.coalesce(agent, none), F.coalesce(substance["id"].cast("string"), none)))
    )
