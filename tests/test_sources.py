"""Readers, sinks and streams on small written files."""

import json

import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import frames, graph
from termloom.sources import readers, sinks
from termloom.streaming import events


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_releases_take_the_newest_file_and_keep_quotes(spark, tmp_path):
    head = "id\teffectiveTime\tactive\tmoduleId\tconceptId\tlanguageCode\ttypeId\tterm\tcaseSignificanceId\n"
    put(tmp_path, "sct2_Description_Snapshot-en_INT_20240101.txt", head + "1\t20240101\t1\t9\t5\ten\t3\told\t0\n")
    put(tmp_path, "sct2_Description_Snapshot-en_INT_20250101.txt", head + '1\t20250101\t1\t9\t5\ten\t3\ta "quoted term\t0\n')
    put(tmp_path, "der2_ssccRefset_MRCMAttributeRangeSnapshot_1.txt", "id\trangeConstraint\nx\t<< 5\n")
    tables = readers.release(spark, str(tmp_path), ["description", "attribute_range"], str(tmp_path / "dump"))
    row = tables["description"].first()
    assert (row.id, row.conceptId, row.term, row.effectiveTime) == (1, 5, 'a "quoted term', "20250101")
    assert tables["attribute_range"].first().rangeConstraint == "<< 5"
    assert spark.read.csv(str(tmp_path / "dump" / "attribute_range"), header=True).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.release_table(spark, str(tmp_path), "concept")


def test_csv_json_lines_and_id_lists(spark, tmp_path):
    path = put(tmp_path, "a.csv", '\ufeffSPL_SET_ID,term\n a ,"x, ""y"""\nb,\n')
    assert [r.term for r in readers.csv(spark, path, ["term"]).collect()] == ['x, "y"', None]
    with pytest.raises(ValueError, match="lacks"):
        readers.csv(spark, path, ["nothing"])
    assert [r.id for r in readers.id_list(spark, path, header=True).collect()] == ["a", "b"]
    assert [r.id for r in readers.id_list(spark, put(tmp_path, "ids.txt", "# c\n\n 7 \n8\n")).collect()] == ["7", "8"]
    rows = readers.json_lines(spark, put(tmp_path, "x.jsonl", '{"a": 1}\n\n{"a": 2}\n')).collect()
    assert [r.a for r in rows] == [1, 2] and rows[0].source_file.endswith("x.jsonl")
    pairs = readers.edge_list(spark, put(tmp_path, "e.csv", "parent,child\n 1 ,2\n,3\n")).collect()
    assert [(r.parent, r.child) for r in pairs] == [("1", "2")]


def test_predictions_as_rows_and_as_lists(spark, tmp_path):
    lines = [{"spl_set_id": "s1", "raw_output": '```json {"items": [{"ci_text": "a"}, {"ci_text": " b "}, {"x": 1}'}, {"spl_set_id": "", "SPL_SET_ID": "s2", "raw_output": "none"}]
    path = put(tmp_path, "p.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")
    got = readers.predictions(spark, path).collect()
    assert [(r.SPL_SET_ID, r.item_index) for r in got][:2] == [("s1", 0), ("s1", 1)]
    lists = {r.SPL_SET_ID: r.pred_terms for r in readers.prediction_lists(spark, path, truthy=True).collect()}
    assert lists["s1"][:2] == ["a", "b"] and lists["s2"] == []
    assert {r.SPL_SET_ID for r in readers.prediction_lists(spark, path).collect()} == {"s1", ""}


def test_sections_and_classes_of_xml(spark, tmp_path):
    put(tmp_path / "x", "l.xml", "<document xmlns='u'><section><code code='1-8'/><text>One <b>bold</b> word<paragraph>two</paragraph></text></section><section><code code='2-8'/><text>three</text></section></document>")
    got = readers.xml_sections(readers.xml_folder(spark, str(tmp_path / "x")), "xml", "file").collect()
    assert [(r.file, r.code, r.section_text) for r in got] == [("l.xml", "1-8", "One bold word\ntwo"), ("l.xml", "2-8", "three")]
    owl = '<rdf:RDF><owl:Class rdf:about="http://x/VO_1"><rdfs:label xml:lang="fr">un</rdfs:label><rdfs:label xml:lang="en">one</rdfs:label><cvx>12</cvx></owl:Class><owl:Class rdf:about="http://x#VO_2"><rdfs:label>two</rdfs:label><cvx>n</cvx></owl:Class><owl:Class rdf:about="http://x/OTHER_3"></owl:Class></rdf:RDF>'
    got = readers.owl_classes(spark, put(tmp_path, "o.owl", owl), "VO_", "cvx").collect()
    assert [tuple(r) for r in got] == [("VO_1", "one", 12), ("VO_2", "two", None)]
    rows = readers.xml_rows(spark, put(tmp_path, "r.xml", "<a><r><n>1</n></r><r><n>2</n></r></a>"), "r").collect()
    assert sorted(int(r.n) for r in rows) == [1, 2]


def test_paged_sources_stop_at_the_last_page_and_report_failures(spark):
    def fetch(key, page):
        if key == "bad" and page == 2:
            raise OSError("down")
        return [f"{key}{page}{i}" for i in range(2)] if page < 3 else []

    got = readers.paged(spark, spark.createDataFrame([("a",), ("bad",), ("a",)], "k string"), "k", fetch, interval=0.001).collect()
    assert sorted(r.value for r in got if r.k == "a") == ["a10", "a11", "a20", "a21"]
    assert sorted((r.page, r.value or r.error) for r in got if r.k == "bad") == [(1, "bad10"), (1, "bad11"), (2, "OSError: down")]
    answers = spark.createDataFrame([("x", '{"r": {"m": [{"id": "1", "n": "a"}, {"id": "2"}]}}'), ("y", "{}")], "k string, v string")
    assert [tuple(r) for r in readers.json_nodes(answers, "k", "v", "$.r.m", "struct<id:string,n:string>").collect()] == [("x", "1", "a"), ("x", "2", None)]


def test_sinks_write_what_readers_read(spark, tmp_path):
    m = spark.createDataFrame([("a b", 1, True), ("a b", 2, None), ("c", 3, False)], "attribute string, conceptId long, allowed boolean")
    path = put(tmp_path, "cache.json", sinks.membership_cache(m, {"made": "now"}).first().value)
    assert json.loads(open(path, encoding="utf-8").read())["meta"] == {"made": "now"}
    assert {(r.attribute, r.conceptId, r.allowed) for r in readers.membership_cache(spark, path).collect()} >= {("a b", 1, True), ("c", 3, False)}
    rows = spark.createDataFrame([("s", 0, None)], "SPL_SET_ID string, item_index int, query_text string")
    sinks.aggregate_csv(rows, str(tmp_path / "agg"))
    back = spark.read.csv(str(tmp_path / "agg"), header=True)
    assert back.columns == sinks.AGGREGATE_COLUMNS and back.first().SPL_SET_ID == "s"
    sinks.json_lines(rows, str(tmp_path / "j"))
    sinks.append_audit(rows, str(tmp_path / "audit"))
    sinks.append_audit(rows, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    assert json.loads(sinks.metrics(spark.createDataFrame([(1, 0.5)], "tp int, f1 double"), {"gold": "g"}).first().value) == {"inputs": {"gold": "g"}, "metrics": {"tp": 1, "f1": 0.5}}
    tokens = spark.createDataFrame([("t", 1, 2)], "token string, doc long, tf int")
    for _ in range(2):
        sinks.index(tokens, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 1


def test_streams_drop_late_rows_and_append_once(spark, tmp_path):
    schema = "ts timestamp, k string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    make = lambda days: spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00", "a") for d in days], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    make([1, 1, 10]).coalesce(1).write.parquet(src)
    assert events.windowed_counts(spark.read.schema(schema).parquet(src), "ts", "k").count() == 2

    def once(name, frame):
        events.append(frame, f"{out}/{name}", f"{out}/{name}-cp").awaitTermination()

    stream = lambda: events.read_events(spark, src, schema)
    once("rows", stream())
    once("counts", events.windowed_counts(stream(), "ts", "k"))
    make([2, 20]).coalesce(1).write.mode("append").parquet(src)
    once("rows", stream())
    once("counts", events.windowed_counts(stream(), "ts", "k"))
    assert spark.read.json(f"{out}/rows").count() == 5
    got = {r.window_start[:10]: r.n for r in spark.read.json(f"{out}/counts").collect()}
    assert got["2024-01-01"] == 2 and "2024-01-02" not in got


def test_narratives_statements_and_synonyms(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    for text, want in [
        ("Use  tablets .\r\n\r\n\r\nNext", "Use tablets.\n\nNext"), ("one •two â€¢  three", "one \n• two \n• three"), ("( a ) [\nb ]", "(a) [b]"),
        ("10mgtablets", "10mg tablets"), ("a\u00a0b\n\n•\n c", "a b\n\n• c"), (None, ""),
    ]:
        assert one(T.narrative, text) == want
    for text, want in [("Hypersensitivity to any of the penicillins.", "penicillins"), ("Severe peanut allergy in children", "Severe peanut"), ("asthma", None), ("known ALLERGY against the drug;", "drug")]:
        assert one(T.hypersensitivity_agent, text) == want
    assert one(T.canonical_statement, "Patients with any of the ingredients of X") == "ingredients|x"
    assert one(T.canonical_statement, "known anaphylaxis to the drug") == "hypersensitivity|drug"
    rules = T.parse_synonym_rules(["# c", "flu shot, influenza vaccine, flu (shot)", "a+b => c$1"])
    assert one(lambda c: T.rewrite_synonyms(c, rules), "Influenza vaccine or flu (shot) and a+b") == "flu shot or flu shot and c$1"


def test_edges_seeds_and_small_frames(spark):
    r = spark.createDataFrame([(1, 1, 2, 116, 7), (1, 1, 2, 116, 7), (0, 1, 3, 116, 7), (1, 4, 5, 9, 7)], "active int, sourceId long, destinationId long, typeId long, characteristicTypeId long")
    edges = graph.edges_of(r, 116, 7)
    assert [tuple(x) for x in edges.collect()] == [(1, 2)]
    down = graph.below(spark.createDataFrame([(2, 1), (3, 2), (4, 3), (2, 4)], "child long, parent long"), [1])
    assert sorted((x.node, x.dist) for x in down.collect()) == [(2, 1), (3, 2), (4, 3)]  # a cycle ends
    assert graph.seeds_of("<< 5 |Five 5| AND < 30") == [5, 30]
    assert frames.sample_rows(spark.range(10), 3, ["id"], "random", 5).count() == 3
    assert spark.createDataFrame([("MeSH",), ("none",)], "v string").select(frames.map_values(F.col("v"), frames.VOCABULARIES).alias("x")).collect()[0].x == "MSH"
