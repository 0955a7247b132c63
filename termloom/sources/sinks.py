"""Writers of results; every write is a Spark job to any store that Spark opens."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an aggregated table, in this order.
AGGREGATE_COLUMNS = [
    "SPL_SET_ID", "item_index", "query_text", "mapping_source", "final_concept_id", "final_concept_term",
    "postcoord_expression", "causative_agent_id", "causative_agent_term", "severity_id", "severity_term",
    "clinical_course_id", "clinical_course_term",
]


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Headed CSV of the given columns in order; nulls as ''."""
    c = columns or df.columns
    df.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in c)).write.mode(mode).csv(path, header=True, emptyValue="")


def aggregate_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An aggregated table as CSV: AGGREGATE_COLUMNS in order, '' for those that df lacks."""
    full = df.withColumns({c: F.lit("") for c in AGGREGATE_COLUMNS if c not in df.columns})
    csv(full, path, AGGREGATE_COLUMNS, mode)


def metrics(df: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """One row (value): a JSON object of the inputs and the metrics row."""
    return df.select(F.to_json(F.struct(F.struct(*(F.lit(v).alias(k) for k, v in inputs.items())).alias("inputs"), F.struct(*df.columns).alias("metrics"))).alias("value"))


def membership_cache(memberships: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    """One row (value): {"meta": {...}, "memberships": {attribute: {concept: allowed}}} in key order, as
    readers.membership_cache reads it."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("conceptId").cast("string"), "allowed"))))
    each = memberships.groupBy("attribute").agg(m.alias("m"))
    every = F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", F.to_json("m").alias("m")))))
    body = F.array_join(F.transform(F.map_entries(every), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ",")
    told = json.dumps(meta or {}, sort_keys=True)
    return each.agg(F.concat(F.lit('{"meta": ' + told + ', "memberships": {'), body, F.lit("}}")).alias("value"))


def index(postings: DataFrame, path: str, rebuild: bool = False, buckets: int = 64) -> None:
    """Postings as Parquet by token hash; an index that is there stays unless rebuild."""
    part = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    part.write.mode("overwrite" if rebuild else "ignore").partitionBy("bucket").parquet(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)
