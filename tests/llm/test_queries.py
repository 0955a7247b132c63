"""The contract queries on small tables with edge cases: against their SQL, against the library, and against plants."""

import re
import struct
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from termloom.llm import jaccard_join, linededup, packing, quality_rules, toxicity
from termloom.llm.common import tokenizer_path

LINE = "This very same line is found in many documents."
BODY = " ".join(f"word{i}" for i in range(120))
SF = "/root/testdata/sf0.001"


def texts() -> list:
    near = " ".join(["other", *BODY.split()[1:]])
    out = [None, "", " \n\t ", "one two", "one two", "ONE two", BODY, BODY, near, BODY.upper(), "x " * 5000, "Ünï ß 日本 🎉\x0b\x0c a b", "x <|endoftext|> y", "<|endoftext|>"]
    out += [f"{LINE}\nown line number {i} of this text\n  {LINE.upper()}\t" for i in range(6)]
    out += [" ".join(f"d{i}w{j}" for j in range(40)) for i in range(30)]
    out += ["spam spam spam spam spam spam spam spam spam spam spam spam", "# $ % & | < > *", "a\n\n\nb\r\nc"]
    return out


def write(folder, table, rows: dict, schema):
    pq.write_table(pa.table(rows, schema=schema), folder / f"{table}.parquet")


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    d, t = tmp_path_factory.mktemp("small"), texts()
    n = len(t)
    write(d, "documents", {"doc_id": range(n), "text": t, "lang": [None, "en", "de"] * (n // 3) + ["en"] * (n % 3), "source": ["hot"] * n, "n_chars": [len(x or "") for x in t]}, DOCS)
    write(d, "labels", {"doc_id": range(n), "quality": [i % 2 for i in range(n)], "toxic": [i % 2 for i in range(n)]}, LABELS)
    write(d, "benchmark", {"item_id": [1, 2, 3], "text": [" ".join(BODY.split()[:60]), None, ""]}, ITEMS)
    return str(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", ITEMS), ("pages", PAGES)):
        pq.write_table(schema.empty_table(), d / f"{name}.parquet")
    return str(d)


def run(spark, name, d):
    return [r.asDict() for r in entry.queries()[name](spark, d).collect()]


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op8_quality_rules", "op10_line_dedup"])
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted(tuple(r[c] for c in columns) for r in run(spark, name, small))
    assert got == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(x for x in entry.queries() if re.match(r"op\d+_", x) or x == "pipeline"))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert run(spark, name, empty) == []


def encoded(text):
    tok = Tokenizer.from_file(tokenizer_path())
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_written_ids_read_back(spark, small):
    rows, start = {r["doc_id"]: r for r in run(spark, "op3_repair_token_output", small)}, 0
    assert len(rows) == len(texts())
    for doc, text in enumerate(texts()):
        ids = encoded(text)
        assert (rows[doc]["start"], rows[doc]["n_tokens"], rows[doc]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_packed_pieces_hold_every_document_without_gaps(spark, small):
    rows, bins = run(spark, "op7_best_fit_packing", small), {}
    for doc, text in enumerate(texts()):
        ids, own = encoded(text), sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // 1024)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024


def test_placement_minimises_the_sum_of_squares():
    sizes, cap = [6, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 1], 10
    bins, offsets = packing.place(sizes, cap)
    fill: dict[int, int] = {}
    for size, b, o in zip(sizes, bins, offsets, strict=True):
        def cost(c, size=size):
            after = dict(fill)
            after[c] = after.get(c, 0) + size
            gaps = [cap - x for x in after.values() if x < cap]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = {c: cost(c) for c in [*[c for c in fill if fill[c] + size <= cap], max(fill, default=-1) + 1]}
        assert o == fill.get(b, 0) and options[b] == min(options.values())
        fill[b] = fill.get(b, 0) + size


def test_leaks_are_found_and_clean_documents_are_not(spark, small):
    found = {r["doc_id"] for r in run(spark, "op5_benchmark_decontamination", small)}
    assert found == {6, 7, 8, 9}


@pytest.mark.parametrize(("name", "label", "folds", "out"), [("op6_toxicity", "toxic", 4, 2), ("op9_quality_classifier", "quality", 5, 0)])
def test_scores_rank_held_out_documents(spark, name, label, folds, out):
    sf = SF.replace("0.001", "0.01")
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = run(spark, name, sf)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    pos = [r["score"] for r in rows if r["held_out"] and y.get(r["doc_id"]) == 1]
    neg = [r["score"] for r in rows if r["held_out"] and y.get(r["doc_id"]) == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert wins / (len(pos) * len(neg)) > 0.85


def test_keys_that_are_split_over_ranges_lose_the_same_lines(spark):
    rows = [(i if i % 7 else None, "\n".join([LINE, f"a line of its own number {i}", LINE.upper(), f"shared by a few of them {i % 9}"])) for i in range(60)]
    hashes = linededup.line_hashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    h1 = sorted({r.h1 for r in hashes.collect()})
    plain, split = (sorted(map(tuple, linededup.gone_lines(hashes, hot=hot, parts=4).collect())) for hot in ([], h1))
    assert plain == split and len(plain) > 100
    hot = linededup.hot_keys(hashes, 5)
    assert 1 <= len(hot) <= 5 and sorted(map(tuple, linededup.gone_lines(hashes, hot=hot, parts=4).collect())) == plain


def test_other_columns_and_null_ids_do_not_matter(spark):
    rows = [(None, LINE, "k", 1), (1, LINE, "k", 2), (1, LINE, "k", 2), (2, LINE, "h1", 3), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n long")
    kept = linededup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, ""), (1, ""), (1, ""), (2, LINE), (3, "")]
    groups = jaccard_join.similar_groups(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in groups if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert quality_rules.statistics(docs).count() == 5
    model = toxicity.NbLinear(__import__("numpy").zeros(0, "int64"), __import__("numpy").zeros(0), -5.0)
    assert toxicity.reject(docs, model).count() == 5


def test_join_equals_brute_force_on_many_near_copies(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts_ = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
        texts_.append(" ".join(w[: rng.randrange(40, 61)]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts_]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(sets))}
