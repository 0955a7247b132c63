"""Quality rules with adaptive limits: mergeable quantile sketches per language and source, then a joined filter.

Each document's statistics are computed inside its row, without a shuffle, and written once. KLL sketches are built per
(lang, source) with map-side partials and merged upwards to the language and to the whole table; each limit is read from
the finest level whose sketch holds at least MIN_GROUP values, or else from the whole table's. All limits are quantiles:

- mean_word lies within WIDTH interquartile ranges of the quartiles, or within the outer tenths if those reach further,
  so a group of very even documents keeps its own;
- symbol_rate and dup_line_rate, which are 0 in most documents, are at most the upper tenth's quantile, or the median of
  the documents where they are not 0 if that is larger.

Limits are written once before they are joined, so that a sketch that is built again changes nothing. They have one row
per language and source: up to BROADCAST_GROUPS rows are broadcast, more are joined by salted keys, so that a source that
holds much of the table is many tasks' work either way.

A null text has no words and fails the base rule. A null lang or source is a group of its own. Repeated rows are judged
each by itself and all count in the sketches. A document with fewer than five words has no repeated windows. Sketches
keep SKETCH_K values exactly, so smaller groups get exact quantiles; larger ones are off by about 0.3 % in rank. Empty
tables give empty results. statistics adds its columns, and replaces input columns of the same names; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD_SPLIT, materialise, table

SKETCH_K = 1024
MIN_GROUP = 50
WIDTH = 6.0
SPREAD, INFLATED = "mean_word", ("symbol_rate", "dup_line_rate")
#: Rows of limits, of some 100 bytes each, that are broadcast; and the parts of each key of a join beyond that.
BROADCAST_GROUPS, SALT = 100_000, 64
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def statistics(docs: DataFrame) -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_full_lines, n_dup_lines and n_repeat_words (all long)."""
    t = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    worded = docs.withColumn("words__", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_SPLIT)))
    window = "xxhash64(get(words__, i), get(words__, i + 1), get(words__, i + 2), get(words__, i + 3), get(words__, i + 4))"
    windowed = worded.withColumns({
        "n_words": F.size("words__").cast("long"),
        "word_chars": F.char_length(F.array_join("words__", "")).cast("long"),
        "windows__": F.expr(f"if(size(words__) < 5, cast(array() as array<bigint>), transform(sequence(0, size(words__) - 5), i -> {window}))"),
    }).drop("words__")
    # only texts in which a window comes back pay for the sort
    again = windowed.withColumn("sorted__", F.expr("if(size(array_distinct(windows__)) = size(windows__), cast(null as array<struct<h: bigint, i: int>>), array_sort(transform(windows__, (h, i) -> struct(h, i))))")).drop("windows__")
    spots = again.withColumn("spots__", F.expr("""
        if(sorted__ is null, cast(null as array<int>), array_sort(transform(filter(
            transform(sorted__, (x, j) -> struct(x.i as i,
                (j > 0 and get(sorted__, j - 1).h = x.h) or (j + 1 < size(sorted__) and get(sorted__, j + 1).h = x.h) as twice)),
            y -> y.twice), y -> y.i)))""")).drop("sorted__")
    symbols = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[#*$%&|<>]", ""))
    full = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return spots.withColumns({
        "n_symbols": symbols.cast("long"),
        "full__": full,
        "n_repeat_words": F.expr("""coalesce(aggregate(transform(spots__, (p, j) -> if(j + 1 < size(spots__), least(5, get(spots__, j + 1) - p), 5)),
            0L, (a, x) -> a + x), 0L)"""),
    }).withColumns({"n_full_lines": F.size("full__").cast("long"), "n_dup_lines": (F.size("full__") - F.size(F.array_distinct("full__"))).cast("long")}).drop("spots__", "full__")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The rates that the limits hold; null without words."""
    return {
        "mean_word": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")),
        "symbol_rate": F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars")),
        "dup_line_rate": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_full_lines")),
    }


#: sketch: (rate, whether only values above 0 go in, the quantiles read from it)
SKETCHES = {
    "mean_word": ("mean_word", False, (0.1, 0.25, 0.75, 0.9)),
    **{f"{r}_all": (r, False, (0.9,)) for r in INFLATED},
    **{f"{r}_some": (r, True, (0.5,)) for r in INFLATED},
}


def sketches(stats: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One row per language and source with each mergeable sketch and the number of its values."""
    value = {s: F.when(F.col(r) > 0, F.col(r)) if some else F.col(r) for s, (r, some, _) in SKETCHES.items()}
    return stats.filter("n_words > 0").groupBy("lang", "source").agg(*(F.count(v).alias(f"n_{s}") for s, v in value.items()), *(F.kll_sketch_agg_double(v, F.lit(k)).alias(s) for s, v in value.items()))


def fences(group: DataFrame, min_group: int = MIN_GROUP, width: float = WIDTH, k: int = SKETCH_K) -> DataFrame:
    """(lang__, source__, lo_mean_word, hi_<rate>) of every language and source."""

    def quantiles(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
        cols = [F.col(x).alias(f"{x}_{tag}") for x in keys]
        for s, (_, _, at) in SKETCHES.items():
            got = F.kll_sketch_get_quantile_double(s, F.array(*map(F.lit, at)))
            cols += [F.col(f"n_{s}").alias(f"n_{s}_{tag}"), F.when(F.col(f"n_{s}") > 0, got).alias(f"{s}_{tag}")]
        return df.select(*cols)

    merge = [F.sum(f"n_{s}").alias(f"n_{s}") for s in SKETCHES] + [F.kll_merge_agg_double(s, F.lit(k)).alias(s) for s in SKETCHES]
    fine, lang = quantiles(group, "f", ["lang", "source"]), quantiles(group.groupBy("lang").agg(*merge), "l", ["lang"])
    top = quantiles(group.agg(*merge), "t", []).first()  # one row
    both = fine.join(lang, F.col("lang_f").eqNullSafe(F.col("lang_l")))
    q = {}
    for s in SKETCHES:
        whole = F.lit(None).cast("array<double>") if top[f"{s}_t"] is None else F.array(*(F.lit(float(x)) for x in top[f"{s}_t"]))
        q[s] = F.when(F.col(f"n_{s}_f") >= min_group, F.col(f"{s}_f")).when(F.col(f"n_{s}_l") >= min_group, F.col(f"{s}_l")).otherwise(whole)
    m = q["mean_word"]
    out = [F.least(m[0], m[1] - width * (m[2] - m[1])).alias("lo_mean_word"), F.greatest(m[3], m[2] + width * (m[2] - m[1])).alias("hi_mean_word")]
    out += [F.greatest(q[f"{r}_all"][0], q[f"{r}_some"][0]).alias(f"hi_{r}") for r in INFLATED]  # greatest skips nulls
    return both.select(F.col("lang_f").alias("lang__"), F.col("source_f").alias("source__"), *out)


def with_limits(stats: DataFrame, limits: DataFrame, broadcast_groups: int = BROADCAST_GROUPS, salt: int = SALT) -> DataFrame:
    """stats with the limits of its language and source."""
    same = F.col("lang").eqNullSafe(F.col("lang__")) & F.col("source").eqNullSafe(F.col("source__"))
    if limits.count() <= broadcast_groups:
        return stats.join(F.broadcast(limits), same, "left")
    dealt = stats.withColumn("salt__", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salt)))
    spread = limits.withColumn("salted__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return dealt.join(spread, same & (F.col("salt__") == F.col("salted__")), "left").drop("salt__", "salted__")


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with base_failed and kept."""
    inside = F.col("mean_word").between(F.col("lo_mean_word"), F.col("hi_mean_word"))
    for r in INFLATED:
        inside = inside & (F.col(r) <= F.col(f"hi_{r}"))
    return with_limits(stats, limits).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = materialise(spark, statistics(docs).drop("text").withColumns(rates()), "text-statistics")
    limits = materialise(spark, fences(materialise(spark, sketches(stats), "rate-sketches")), "rate-limits")
    return judge(stats, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    ws = r"[\x20\x09-\x0D]+"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    value = {s: f"CASE WHEN {r} > 0 THEN {r} END" if some else r for s, (r, some, _) in SKETCHES.items()}
    quant = ", ".join(f"count({v}) AS n_{s}, " + ", ".join(f"quantile_disc({v}, {x}) AS {s}_{j}" for j, x in enumerate(SKETCHES[s][2])) for s, v in value.items())
    pick = lambda s, j: f"CASE WHEN f.n_{s} >= {MIN_GROUP} THEN f.{s}_{j} WHEN l.n_{s} >= {MIN_GROUP} THEN l.{s}_{j} ELSE t.{s}_{j} END"
    lims = ", ".join(f"{pick(s, j)} AS {s}_{j}" for s, (_, _, at) in SKETCHES.items() for j in range(len(at)))
    iqr = f"{WIDTH} * (mean_word_2 - mean_word_1)"
    ok = f"s.mean_word BETWEEN least(mean_word_0, mean_word_1 - {iqr}) AND greatest(mean_word_3, mean_word_2 + {iqr})"
    ok += "".join(f" AND s.{r} <= greatest({r}_all_0, {r}_some_0)" for r in INFLATED)
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {blanks}) <> '') AS full_lines
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(words) - 4)) AS i,
         unnest(list_transform(range(len(words) - 4), lambda j: list_slice(words, j + 1, j + 5))) AS gram
  FROM w WHERE len(words) >= 5),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
s0 AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(full_lines) AS BIGINT) AS n_full_lines,
         CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
s AS (
  SELECT *, CAST(word_chars AS DOUBLE) / nullif(n_words, 0) AS mean_word,
         CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0) AS symbol_rate,
         CAST(n_dup_lines AS DOUBLE) / nullif(n_full_lines, 0) AS dup_line_rate,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM s0),
worded AS (SELECT * FROM s WHERE n_words > 0),
f AS (SELECT lang, source, {quant} FROM worded GROUP BY lang, source),
l AS (SELECT lang, {quant} FROM worded GROUP BY lang),
t AS (SELECT {quant} FROM worded),
lim AS (SELECT f.lang, f.source, {lims} FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({ok}, false) AS kept
FROM s LEFT JOIN lim ON s.lang IS NOT DISTINCT FROM lim.lang AND s.source IS NOT DISTINCT FROM lim.source
"""


OP8_SQL = _sql()
