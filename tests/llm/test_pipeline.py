"""The pipeline against plain Python, stage by stage, on a small corpus with plants."""

import random
import struct
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_decontamination import brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from termloom.llm import toxicity
from termloom.llm.common import table, tokenizer_path

LINE = "One and the same line stands in many of these documents."


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Clean and toxic prose, copies, near copies, a shared line, a leak, null and empty texts, repeated and null ids."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    items = [prose(30) for _ in range(3)]
    texts = [prose(rng.randrange(20, 120)) for _ in range(60)]
    texts += [f"{t} vile hateful slur {t[:20]}" for t in texts[:20]]
    texts += texts[25:30] + [" ".join([*t.split()[:-1], "changed"]) for t in texts[30:36]]
    texts += [f"{prose(30)}\n  {LINE}\n{prose(20)}" for _ in range(5)]
    texts += [f"{prose(15)} {items[k % 3]} {prose(10)}" for k in range(4)] + [None, "", prose(1500)]
    ids = list(range(len(texts)))
    texts += [texts[40], prose(30)]
    ids += [40, None]
    folder = tmp_path_factory.mktemp("corpus")
    n = len(texts)
    rows = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(rows), folder / "documents.parquet")
    toxic = ["hateful" in (t or "") for t in texts]
    labels = {"doc_id": pa.array(range(90), pa.int64()), "quality": pa.array([1] * 90, pa.int32()), "toxic": pa.array([int(x) for x in toxic[:90]], pa.int32())}
    pq.write_table(pa.table(labels), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3], pa.int64()), "text": items}), folder / "benchmark.parquet")
    return str(folder), items, dict(zip(range(n), zip(ids, texts, strict=True), strict=True))


def without_shared_lines(docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    low = -(2**63)
    held = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(low if doc is None else doc)
    gone = lambda doc, line: len(key(line)) >= 20 and len(held[key(line)]) >= 3 and max(held[key(line)]) != (low if doc is None else doc)
    return [(doc, "\n".join(x for x in (text or "").split("\n") if not gone(doc, x))) for doc, text in docs]


def one_of_each_group(docs):
    sets = []
    for _, text in docs:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    ids = sorted({d for d, _ in docs if d is not None})
    root = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for i, (a, _) in enumerate(docs):
            for j, (b, _) in enumerate(docs[:i]):
                if a is not None and b is not None and root[a] != root[b] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low, high = sorted((root[a], root[b]))
                    root = {d: low if r == high else r for d, r in root.items()}
                    changed = True
    return [(d, t) for d, t in docs if d is None or root[d] == d]


def test_every_stage_equals_plain_python(spark, corpus):
    folder, items, rows = corpus
    docs = sorted(rows.values(), key=lambda r: (r[0] is None, r[0]))
    model = toxicity.train_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scores = model.score(pa.array([t for _, t in docs]), model.table_of())
    docs = [r for r, s in zip(docs, scores.tolist(), strict=True) if s < 0.3]
    assert not any("hateful" in (t or "") for _, t in docs) and len(docs) > 60
    docs = one_of_each_group(without_shared_lines(docs))
    leaks = {d for d, _ in brute_force([t for _, t in docs], items)}
    assert len(leaks) >= 3
    docs = [r for i, r in enumerate(docs) if i not in leaks]
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc if doc is not None else -1, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 1024


def test_stages_keep_columns_and_rows_of_their_own_input(spark, corpus):
    folder, _, _ = corpus
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
