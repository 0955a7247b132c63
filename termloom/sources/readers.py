"""Readers of terminology releases, CSV, JSON lines, XML and id lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_repair
from ..operators import sections

RELEASE_FILES = {
    "concept": ("sct2_Concept_Snapshot_", "id BIGINT, effectiveTime STRING, active INT, moduleId BIGINT, definitionStatusId BIGINT"),
    "description": ("sct2_Description_Snapshot-en_", "id BIGINT, effectiveTime STRING, active INT, moduleId BIGINT, conceptId BIGINT, languageCode STRING, typeId BIGINT, term STRING, caseSignificanceId BIGINT"),
    "relationship": ("sct2_Relationship_Snapshot_", "id BIGINT, effectiveTime STRING, active INT, moduleId BIGINT, sourceId BIGINT, destinationId BIGINT, relationshipGroup INT, typeId BIGINT, characteristicTypeId BIGINT, modifierId BIGINT"),
    "domain": ("der2_sssssssRefset_MRCMDomainSnapshot_", None),
    "attribute_domain": ("der2_cissccRefset_MRCMAttributeDomainSnapshot_", None),
    "attribute_range": ("der2_ssccRefset_MRCMAttributeRangeSnapshot_", None),
    "module_scope": ("der2_ciRefset_MRCMModuleScopeSnapshot_", None),
    "text_definition": ("sct2_TextDefinition_Snapshot-en_", "id BIGINT, effectiveTime STRING, active INT, moduleId BIGINT, conceptId BIGINT, languageCode STRING, typeId BIGINT, term STRING, caseSignificanceId BIGINT"),
}


def newest(spark: SparkSession, folder: str, prefix: str) -> str:
    """The last of the folder's <prefix>*.txt by name, listed by Spark's file system; an error if there is none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*.txt")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath()) for f in found or [])
    if not names:
        raise FileNotFoundError(f"no {prefix}*.txt in {folder}")
    return names[-1]


def release_table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One table of a release: tab-separated, headed, never quoted; ids as BIGINT where the schema is known."""
    prefix, schema = RELEASE_FILES[kind]
    path = newest(spark, folder, prefix)
    strings = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    if schema is None:
        return strings
    kinds = dict(c.split() for c in schema.split(", "))
    return strings.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in strings.columns))


def release(spark: SparkSession, folder: str, kinds: list[str] | None = None, dump: str | None = None) -> dict[str, DataFrame]:
    """The tables of a release by kind; with dump, each is also written there as headed CSV."""
    tables = {kind: release_table(spark, folder, kind) for kind in kinds or RELEASE_FILES}
    for kind, df in tables.items() if dump else ():
        df.write.mode("overwrite").csv(f"{dump}/{kind}", header=True)
    return tables


def csv(spark: SparkSession, path: str, required: list[str] | None = None, sep: str = ",") -> DataFrame:
    """All-string rows of a headed CSV, a byte-order mark dropped from the header; an error if a column is missing."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    df = df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; it has {df.columns}")
    return df


def json_lines(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON lines of one or more paths or globs, blank lines skipped, with the file's name in source_file."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(paths).withColumn("source_file", F.input_file_name())


def predictions(spark: SparkSession, paths: str | list[str], id_fields: tuple[str, ...] = ("spl_set_id", "SPL_SET_ID", "item_index")) -> DataFrame:
    """(SPL_SET_ID, item_index, item as JSON) of raw model outputs: the first id field that is there, the output repaired
    and its items numbered from 0."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    ident = F.coalesce(*(F.get_json_object("value", f"$.{f}") for f in id_fields))
    fixed = json_repair.repaired(F.get_json_object("value", "$.raw_output"))
    items = F.from_json(F.get_json_object(fixed, "$.items"), "array<string>")
    return lines.select(ident.alias("SPL_SET_ID"), F.posexplode(items).alias("item_index", "item"))


def id_list(spark: SparkSession, path: str, header: bool = False, names: tuple[str, ...] = ("SPL_SET_ID", "spl_set_id", "setid", "SETID")) -> DataFrame:
    """(id) from a CSV with one of the known headers, or from text lines without blanks and '#' comments."""
    if header:
        df = csv(spark, path)
        column = next((n for n in names if n in df.columns), None)
        if column is None:
            raise ValueError(f"{path} has none of {names}")
        return df.select(F.trim(column).alias("id")).filter("id <> ''")
    return spark.read.text(path).select(F.trim("value").alias("id")).filter((F.col("id") != "") & ~F.col("id").startswith("#"))


def membership_cache(spark: SparkSession, path: str) -> DataFrame:
    """(attribute, conceptId, allowed) of a membership cache; keys that are no numbers are dropped."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json(F.get_json_object("value", "$.memberships"), "map<string, map<string, boolean>>")
    flat = text.select(F.explode(m).alias("attribute", "m")).select("attribute", F.explode("m").alias("k", "allowed"))
    return flat.select("attribute", F.expr("try_cast(k as bigint)").alias("conceptId"), "allowed").filter("conceptId is not null")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of a headed CSV, trimmed, blanks dropped."""
    df = csv(spark, path, ["parent", "child"]).select(F.trim("parent").alias("parent"), F.trim("child").alias("child"))
    return df.filter("parent <> '' and child <> ''")


def xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Rows of an XML document by tag; broken parts go to _corrupt_record."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").load(path)


def xml_sections(documents: DataFrame, xml: str, ident: str) -> DataFrame:
    """(ident, code, section_text) of every coded section of label documents held as strings, one row a section, its
    whole narrative flattened."""
    return sections.coded_sections(documents, ident, xml).select(ident, "code", "section_text")


def xml_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml) of every XML file of a folder or glob, each read whole."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("xml"))


def owl_classes(spark: SparkSession, path: str, prefix: str, annotation: str) -> DataFrame:
    """(class, label, value) of an ontology's classes whose name begins with prefix: the English label before others, and
    the annotation as BIGINT, null where it is no number."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<owl:Class\b[^>]*rdf:about=(.*?)</owl:Class>"), F.lit(1))).alias("c"))
    name = F.regexp_extract("c", r"""^["'][^"']*[/#]([^"'/#]+)["']""", 1)
    label = lambda attribute: F.regexp_extract("c", rf"(?s)<rdfs:label{attribute}>([^<]*)<", 1)
    english, any_ = label(r"[^>]*xml:lang=[\"']en[\"'][^>]*"), label(r"\b[^>]*")
    value = F.trim(F.regexp_extract("c", rf"(?s)<{annotation}\b[^>]*>([^<]*)<", 1)).try_cast("bigint")
    return rows.select(name.alias("class"), F.when(english != "", english).otherwise(any_).alias("label"), value.alias("value")).filter(F.col("class").startswith(prefix))


def prediction_lists(spark: SparkSession, paths: str | list[str], id_fields: tuple[str, ...] = ("spl_set_id", "SPL_SET_ID"), field: str = "ci_text", truthy: bool = False) -> DataFrame:
    """(SPL_SET_ID, pred_terms) of raw model outputs, one row a record: the first id that is there, or with truthy the
    first that is not blank."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    ids = [F.get_json_object("value", f"$.{f}") for f in id_fields]
    ident = F.coalesce(*(F.when(i != "", i) for i in ids)) if truthy else F.coalesce(*ids)
    items = F.from_json(F.get_json_object(json_repair.repaired(F.get_json_object("value", "$.raw_output")), "$.items"), "array<string>")
    terms = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.get_json_object(x, f"$.{field}"))), lambda x: x != "")
    return lines.select(ident.alias("SPL_SET_ID"), F.coalesce(terms, F.array().cast("array<string>")).alias("pred_terms"))


def paged(spark: SparkSession, keys: DataFrame, key: str, fetch: Callable[[str, int], list[str] | None], interval: float = 0.0, retries: int = 2, partitions: int = 4) -> DataFrame:
    """(key, page, value, error) of a paged source: fetch(key, page) gives a page's values, from page 1 until it gives
    none. Each partition asks at most once every `interval` seconds, so partitions / interval bounds the rate. A page that
    fails more than `retries` times gives one row with the error and ends its key."""

    def run(batches):
        import time

        import pandas as pd

        last = 0.0
        for batch in batches:
            for k in batch[key].tolist():
                page, out = 1, []
                while True:
                    values, error = None, None
                    for _ in range(retries + 1):
                        time.sleep(max(0.0, last + interval - time.monotonic()))
                        last = time.monotonic()
                        try:
                            values, error = fetch(k, page), None
                            break
                        except Exception as e:  # noqa: BLE001 - any failure of an outside service becomes a row
                            error = f"{type(e).__name__}: {e}"
                    if error is not None:
                        out.append((k, page, None, error))
                    out += [(k, page, v, None) for v in values or []]
                    if not values:
                        break
                    page += 1
                yield pd.DataFrame(out, columns=[key, "page", "value", "error"]).astype(object)

    dealt = keys.select(F.col(key).cast("string").alias(key)).distinct().repartition(partitions, key)
    return dealt.mapInPandas(run, f"{key} string, page int, value string, error string")


def json_nodes(answers: DataFrame, ident: str, value: str, path: str, schema: str) -> DataFrame:
    """answers' ident with the array at a path of their JSON as rows; answers without it give none."""
    items = F.from_json(F.get_json_object(value, path), f"array<{schema}>")
    return answers.select(ident, F.explode(items).alias("n")).select(ident, "n.*")
