"""Relational operators over terminology tables, documents and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage

# Vocabulary names of one catalogue and their abbreviations in another.
VOCABULARIES = {
    "MeSH": "MSH", "RxNorm Extension": "RXNORM_EXT", "RxNorm": "RXNORM", "GCN_SEQNO": "NDDF", "SPL": "MTHSPL",
    "NDC": "NDC", "SNOMED": "SNOMEDCT_US", "CVX": "CVX", "CPT4": "CPT", "VANDF": "VANDF", "ATC": "ATC",
    "EphMRA ATC": "ATC", "HCPCS": "HCPCS", "SNOMED Veterinary": "SNOMEDCT_VET", "NDFRT": "VANDF", "NCCD": "NCCD",
    "OMOP Invest Drug": "OMOPID", "ICD10PCS": "ICD10PCS", "GGR": "GGR", "KDC": "KDC", "AMT": "AMT",
    "Nebraska Lexicon": "NEB_LEX", "CO-CONNECT": "CO-CONNECT", "VA Class": "VANDF", "dm+d": "DM+D",
    "HemOnc": "HemOnc", "JMDC": "JMDC", "BDPM": "BDPM", "CTD": "CTD", "EDI": "EDI", "DPD": "DPD", "Multum": "MMSL",
    "Read": "RCD", "CIEL": "CIEL",
}


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("active") == 1)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn__", F.row_number().over(w)).filter("rn__ = 1").drop("rn__")


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is neither null nor blank, trimmed."""
    return df.withColumn(column, F.trim(column)).filter(F.length(column) > 0)


def without_substring(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column does not hold part in any case; nulls stay."""
    return df.filter(~F.coalesce(F.lower(column).contains(part.lower()), F.lit(False)))


def not_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column differs from value; nulls stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def map_values(column: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; null where the mapping has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), column)


def concepts(concept: DataFrame, description: DataFrame, full_name_type: int) -> DataFrame:
    """conceptId, term and semantic_tag of active concepts with an active full name; the smallest term wins."""
    names = active(description).filter(F.col("typeId") == full_name_type).join(active(concept).select(F.col("id").alias("conceptId")), "conceptId", "left_semi")
    return first_by(names.select("conceptId", "term", T.semantic_tag(F.col("term")).alias("semantic_tag")), ["conceptId"], ["term"])


def synonyms(concept: DataFrame, description: DataFrame, synonym_type: int) -> DataFrame:
    """Distinct (conceptId, term) of active concepts' active, non-blank synonyms."""
    s = active(description).filter(F.col("typeId") == synonym_type).join(active(concept).select(F.col("id").alias("conceptId")), "conceptId", "left_semi")
    return present(s.select("conceptId", "term"), "term").distinct()


def terms(concept_frame: DataFrame, synonym_frame: DataFrame) -> DataFrame:
    """One row per (conceptId, term_text), preferred before synonym."""
    both = concept_frame.select("conceptId", F.col("term").alias("term_text"), F.lit("preferred").alias("term_type")).unionByName(
        synonym_frame.select("conceptId", F.col("term").alias("term_text"), F.lit("synonym").alias("term_type"))
    )
    return first_by(present(both, "term_text"), ["conceptId", "term_text"], ["term_type"])


def complete(concept_frame: DataFrame, synonym_frame: DataFrame) -> DataFrame:
    """Concepts with their sorted distinct synonyms, an empty array where there is none."""
    lists = present(synonym_frame, "term").groupBy("conceptId").agg(F.array_sort(F.collect_set("term")).alias("synonyms"))
    return concept_frame.join(lists, "conceptId", "left").withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))


def in_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids, column, "left_semi")


def not_in_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids, column, "left_anti")


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """df with the key's label, or the key itself as text."""
    named = labels.select(F.col(key).alias("k__"), F.col(label).alias("l__"))
    return df.join(named, F.col(key) == F.col("k__"), "left").withColumn(out, F.coalesce("l__", F.col(key).cast("string"))).drop("k__", "l__")


def compare_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of key in both tables, 0 where one lacks it."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("n_b"))
    return x.join(y, key, "full").na.fill(0, ["n_a", "n_b"])


def nest_items(items: DataFrame, doc: str, index: str, fields: list[str]) -> DataFrame:
    """One row per document: item_count and items in index order."""
    return items.groupBy(doc).agg(F.count(F.lit(1)).alias("item_count"), F.array_sort(F.collect_list(F.struct(index, *fields))).alias("items"))


def running_key(df: DataFrame, group: str, order: list, width: int = 3) -> DataFrame:
    """df with idx, 1-based within its group, and key '<group>_<idx>' with leading zeros."""
    idx = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("idx", idx).withColumn("key", F.concat_ws("_", F.col(group).cast("string"), F.lpad(F.col("idx").cast("string"), width, "0")))


def shard(df: DataFrame, n: int, order: list) -> DataFrame:
    """df with shard, the row's place in the order of the whole table modulo n. Rows are numbered within ranges, and the
    ranges' first places are sums over one small row a range, so that no task numbers all rows."""
    parts = df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id())
    parts = cut_lineage(parts)
    first = F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part__").agg(F.count(F.lit(1)).alias("n__")).select("part__", first.alias("start__"))
    nth = F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1
    return parts.withColumn("nth__", nth).join(starts, "part__").withColumn("shard", F.pmod(F.col("start__") + F.col("nth__"), F.lit(n))).drop("part__", "nth__", "start__")


def restore_order(parts: list[DataFrame], place: str) -> DataFrame:
    """The rows of all shards in their original order, those without a place last."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col(place).asc_nulls_last())


def nth_distinct(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The rows of the n-th distinct value, from 1, in the order in which values first appear."""
    first = df.groupBy(value).agg(F.min(order).alias("first__"))
    chosen = first.orderBy("first__", value).limit(n).withColumn("rank__", F.row_number().over(Window.orderBy("first__", value))).filter(F.col("rank__") == n)  # n rows
    return df.join(chosen.select(value), value, "left_semi")


def problems(df: DataFrame, expression: str) -> DataFrame:
    """Rows whose expression begins with N/A."""
    return df.filter(F.col(expression).startswith("N/A"))


def evaluable(df: DataFrame, state: str, concept: str) -> DataFrame:
    """df with evaluable (a state of S or PO) and ignored (no concept)."""
    return df.withColumns({"evaluable": F.coalesce(F.col(state).isin("S", "PO"), F.lit(False)), "ignored": T.blank_missing(F.col(concept).cast("string")) == ""})


def join_compared(a: DataFrame, b: DataFrame, keys: list[str], compare: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """a left-joined with b, common columns with suffixes, and same: whether both values are there and equal."""
    rename = lambda df, s, other: df.select(*(F.col(c) if c in keys or c not in other.columns else F.col(c).alias(c + s) for c in df.columns))
    joined = rename(a, suffixes[0], b).join(rename(b, suffixes[1], a), keys, "left")
    return joined.withColumn("same", F.coalesce(F.col(compare + suffixes[0]) == F.col(compare + suffixes[1]), F.lit(False)))


def flat_lists(df: DataFrame, key: str, lists: str, order: list[str]) -> DataFrame:
    """(key, values): the lists of a key's rows as one, in row order."""
    return df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(lists).alias("l__")))), lambda s: s["l__"])).alias("values"))


def pools(items: DataFrame, slots: list[str]) -> DataFrame:
    """(attribute, conceptId): the distinct candidates of each slot, ids that are no numbers dropped."""
    long_ = items.select(F.explode(F.array(*(F.struct(F.lit(s).alias("attribute"), F.col(s).alias("hits")) for s in slots))).alias("s"))
    rows = long_.select("s.attribute", F.explode("s.hits").alias("h")).select("attribute", F.col("h.id").cast("string").try_cast("bigint").alias("conceptId"))
    return rows.filter("conceptId is not null").distinct()


def leaves(edges: DataFrame) -> DataFrame:
    """(node): children of the tree that are no parents."""
    return edges.select(F.col("child").alias("node")).distinct().join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def sample_rows(df: DataFrame, n: int, order: list, how: str = "first", seed: int = 0) -> DataFrame:
    """n rows: the first in order, or a random choice fixed by the seed. A sample is the feature here."""
    return df.orderBy(*order).limit(n) if how == "first" else df.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(n)


def sample_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the first n ids."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows per key, ranked in rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def document_frequencies(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """df and idf = ln((n + 1) / (df + 1)) of every token; tokens is distinct on (doc, token)."""
    n = tokens.agg(F.countDistinct(doc).alias("n"))
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("df"))
    return counts.join(F.broadcast(n)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1))).drop("n")  # n is one row


def best_duplicate(df: DataFrame, keys: list[str], ident: str, score: str, fields: list[str]) -> DataFrame:
    """Per key and id the best-scoring row, with the id's count over the whole table in global_count."""
    counts = df.groupBy(ident).agg(F.count(F.lit(1)).alias("global_count"))
    best = df.groupBy(*keys, ident).agg(F.max_by(F.struct(*fields), F.struct(score, *fields)).alias("b"), F.max(score).alias(score))
    return best.select(*keys, ident, score, *(F.col(f"b.{f}").alias(f) for f in fields)).join(counts, ident)


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the last in the given order."""
    return first_by(df, keys, [F.desc(c) if isinstance(c, str) else c for c in order])


def crosswalk(seeds: DataFrame, *maps: DataFrame) -> DataFrame:
    """Follows (src, dst) tables from seed ids, nulls and repeats dropped at each step."""
    out = seeds.select(F.col(seeds.columns[0]).alias("id")).filter("id is not null").distinct()
    for m in maps:
        out = out.join(m.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).filter("id is not null").distinct()
    return out


def expand_seeds(seeds: DataFrame, atoms: DataFrame, relations: DataFrame, labels: list[str]) -> DataFrame:
    """(seed, related): concepts whose atoms are related to an atom of the seed by one of the labels, the seed left out.

    atoms has (concept, atom); relations has (atom, label, related_atom)."""
    a = seeds.select(F.col(seeds.columns[0]).alias("concept")).join(atoms, "concept").select(F.col("concept").alias("seed"), "atom")
    r = a.join(relations.filter(F.col("label").isin(*labels)), "atom").select("seed", F.col("related_atom").alias("atom"))
    return r.join(atoms, "atom").select("seed", F.col("concept").alias("related")).filter("seed <> related").distinct()
