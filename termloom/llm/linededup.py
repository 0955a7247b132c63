"""Line dedup over hashes of normalised lines; texts are never shuffled to find what repeats.

A line's key is the line with blanks, tabs and line ends stripped at both ends and A-Z lower-cased. Hashes of keys of
at least 20 code points are range-partitioned by hash and sorted by document and position within. The sorted ranges are
streamed once: a row whose document differs from the row's before is the key's first occurrence in that document, so
their number is the documents of the key, the last document is the largest, and the rows that go are named by the same
stream. Keys that fill much of the table, at most HOT_KEYS of them, told by a mergeable frequent-items sketch, are dealt
to HOT_PARTS ranges each by document; their partial counts, HOT_KEYS x HOT_PARTS rows, are added up and broadcast back.
The sketch only balances the work: counts are exact whatever it says. Documents get sparse bitmaps (64 lines a word) of
the lines that go; the complement is what stays.

Null and empty texts are one empty line. A null doc_id counts as one document that is smaller than any other. Rows
that repeat a doc_id count as one document for the limit, and each row gets its own bitmap. Ties cannot arise: the
largest doc_id is unique. An empty table gives an empty result; other columns of the input pass through untouched,
unless their names begin with line_ and end in __.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, materialise, table

MIN_POINTS = 20
MIN_DOCS = 3
NO_ID = -(2**63)
HOT_KEYS, HOT_PARTS = 1000, 256


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(h1, h2, k, th, pos) of every line whose key is long enough; (k, th) names the row by id and text."""
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    return (
        docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("k", "th", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_points)
        .select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "k", "th", "pos")
    )


def hot_keys(hashes: DataFrame, keys: int = HOT_KEYS) -> list[int]:
    """First hashes of the keys that hold a HOT_KEYS-th of all rows or more, by a sketch: at most `keys` numbers."""
    n, top = hashes.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h1, {keys}, {10 * keys})")).first()
    return [x["item"] for x in top or [] if x["count"] * keys >= n]


def gone_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, hot: list[int] | None = None, parts: int = HOT_PARTS) -> DataFrame:
    """(k, th, pos) of every line whose key at least min_docs documents hold, but in the largest of them."""
    hot = hot_keys(hashes) if hot is None else hot
    by = ["h1", "h2", "part"] if hot else ["h1", "h2"]
    dealt = hashes.withColumn("part", F.when(F.col("h1").isin(hot), F.pmod(F.xxhash64("k"), F.lit(parts))).otherwise(F.lit(-1))) if hot else hashes
    order = ["k", "th", "pos"]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by, *order)
    # the windows follow the ranges and their order: neither another shuffle nor another sort
    in_order = Window.partitionBy(*by).orderBy(*order)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag("k").over(in_order)
    seen = dealt.withColumn("first", (before.isNull() | (before != F.col("k"))).cast("int"))
    seen = seen.withColumns({"n": F.sum("first").over(whole), "keeper": F.last("k").over(whole)})
    n, keeper = F.col("n"), F.col("keeper")
    if hot:  # at most HOT_KEYS rows: the sums of the parts of a split key
        total = seen.filter("part >= 0 and first = 1").groupBy("h1", "h2").agg(F.count("first").alias("all_n"), F.max("k").alias("all_keeper"))
        seen = seen.join(F.broadcast(total), ["h1", "h2"], "left")
        n, keeper = F.coalesce("all_n", n), F.coalesce("all_keeper", keeper)
    return seen.filter((n >= min_docs) & (F.col("k") != keeper)).select(*order)


def drop_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, th, bits, n_dropped) of documents that lose lines; bits maps line div 64 to the lines that go."""
    hashes = materialise(docs.sparkSession, line_hashes(docs, min_points), "line-hashes")
    words = gone_lines(hashes, min_docs).groupBy("k", "th", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bit"))
    return words.groupBy("k", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bit"))).alias("bits"), F.sum(F.bit_count("bit")).alias("n_dropped"))


def with_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input's rows with line_bits__ and line_dropped__ (null and 0 where nothing goes)."""
    b = drop_bitmaps(docs, min_points, min_docs).select(F.col("k").alias("k__"), F.col("th").alias("th__"), F.col("bits").alias("line_bits__"), F.col("n_dropped").alias("dropped__"))
    keyed = docs.withColumns({"line_k__": F.coalesce("doc_id", F.lit(NO_ID)), "line_th__": F.xxhash64("text")})
    return (
        keyed.join(b.hint("shuffle_hash"), (F.col("line_k__") == F.col("k__")) & (F.col("line_th__") == F.col("th__")), "left")
        .withColumn("line_dropped__", F.coalesce("dropped__", F.lit(0)))
        .drop("k__", "th__", "line_k__", "line_th__", "dropped__")
    )


def kept_text() -> Column:
    """The text without the lines that line_bits__ names."""
    stay = F.expr("filter(split(coalesce(text, ''), '\\n', -1), (x, i) -> shiftright(coalesce(try_element_at(line_bits__, i div 64L), 0L), i % 64) & 1L = 0L)")
    return F.when(F.col("line_bits__").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input with the repeated lines taken out of text; all rows and columns stay."""
    return with_bitmaps(docs, min_points, min_docs).withColumn("text", kept_text()).select(*docs.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs).select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.col("line_dropped__").cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_POINTS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
