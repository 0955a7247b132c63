"""Sections of label documents held as XML strings: product names, narratives by code, and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Where a label may name its product, the best place first.
PRODUCT_NAMES = [
    "//section[code[@code='48780-1']]/subject/manufacturedProduct/manufacturedProduct/name",
    "/document/title",
    "//manufacturedProduct//manufacturedMedicine/name",
    "//manufacturedProduct//name",
]


def plain_xml(xml: Column) -> Column:
    """The document without namespace declarations, so that paths name elements as they are written."""
    return F.regexp_replace(xml, r"""\sxmlns(?::\w+)?=("[^"]*"|'[^']*')""", "")


def product_name(xml: Column) -> Column:
    """The first of PRODUCT_NAMES that is there and not blank, white space squeezed; null if none is."""
    doc = plain_xml(xml)
    names = [F.trim(F.regexp_replace(F.xpath_string(doc, F.lit(p)), r"\s+", " ")) for p in PRODUCT_NAMES]
    return F.coalesce(*(F.when(n != "", n) for n in names))


def section(xml: Column, code: str) -> Column:
    """The markup of the first section with the code, from its code element to its end or the next section; null if the
    document has none."""
    body = F.regexp_extract(xml, rf"""(?s)<section\b[^>]*>((?:(?!</?section\b).)*?<code\b[^>]*\bcode=["']{code}["'](?:(?!</?section\b).)*)""", 1)
    return F.when(body != "", body)


def section_text(xml: Column, code: str) -> Column:
    """The narrative of the first section with the code; '' if it has none, null without the section."""
    body = section(xml, code)
    return F.when(body.isNotNull(), T.flat_narrative(F.regexp_extract(body, r"(?s)<text\b[^>]*>(.*?)</text>", 1)))


def sections(documents: DataFrame, ident: str, xml: str, codes: list[str]) -> DataFrame:
    """(ident, product_name, found, sections): sections is a MAP<code, text> of the codes that the document has."""
    entries = F.map_filter(F.create_map(*(x for c in codes for x in (F.lit(c), section_text(F.col(xml), c)))), lambda _, v: v.isNotNull())
    out = documents.select(ident, product_name(F.col(xml)).alias("product_name"), entries.alias("sections"))
    return out.withColumn("found", F.size("sections") > 0)


def coded_sections(documents: DataFrame, ident: str, xml: str) -> DataFrame:
    """(ident, pos, code, section_text) of every coded section in document order, one row a section."""
    parts = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<section\b[^>]*>((?:(?!</?section\b).)*)"), F.lit(1))
    rows = documents.select(ident, F.posexplode(parts).alias("pos", "body"))
    code = F.regexp_extract("body", r"""<code\b[^>]*\bcode=["']([^"']*)["']""", 1)
    text = T.flat_narrative(F.regexp_extract("body", r"(?s)<text\b[^>]*>(.*?)</text>", 1))
    return rows.select(ident, "pos", code.alias("code"), text.alias("section_text")).filter("code <> ''")


def resolved(records: DataFrame, fetched: DataFrame, ident: str, texts: list[str]) -> DataFrame:
    """records with section_text, found and error: the first of their own texts that is not blank, else the fetched
    one; error says why where neither is there. fetched has (ident, section_text, error)."""
    own = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in texts))
    got = fetched.select(ident, F.col("section_text").alias("fetched__"), F.col("error").alias("fetch_error__"))
    joined = records.join(got, ident, "left").withColumn("own__", own)
    text = F.coalesce("own__", F.when(F.trim("fetched__") != "", F.col("fetched__")), F.lit(""))
    error = F.when((text == "") & F.col("fetch_error__").isNotNull(), F.concat(F.lit("extract_section_failed: "), F.col("fetch_error__"))).when(text == "", "section_not_found")
    return joined.select(*records.columns, text.alias("section_text"), (text != "").alias("found"), error.alias("error"))


def corpus_summary(documents: DataFrame, mentions: DataFrame, ident: str) -> DataFrame:
    """One row: sections, sections with and without a mention, mentions, and their mean per section to 3 places.
    documents has (ident, code), mentions (ident, code)."""
    n = mentions.groupBy(ident, "code").agg(F.count(F.lit(1)).alias("n"))
    per = documents.join(n, [ident, "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.agg(F.count(F.lit(1)).alias("sections"), F.count_if(F.col("n") > 0).alias("with_mention"), F.count_if(F.col("n") == 0).alias("without_mention"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.round(F.avg("n"), 3).alias("mean_per_section"))
