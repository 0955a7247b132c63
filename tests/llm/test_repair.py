"""Re-Pair goes on while pairs repeat, is smaller than plain 16-bit ids, and decodes to the same ids, whole or in part."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from termloom.llm import repair
from termloom.llm.bpe import ChunkEncoder
from termloom.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("length", "copies", "most"), [(3000, 300, 6000), (500, 6, 800), (2000, 40, 3000)])
def test_repeated_passages_are_compressed_and_read_back(length, copies, most):
    rng = np.random.default_rng(length)
    text = rng.integers(0, 60000, length)
    ids = np.concatenate([np.r_[text, rng.integers(0, 60000, 5)] for _ in range(copies)])
    rules, lengths, seq = repair.compress(ids)
    assert (repair.expand(rules, lengths, seq) == ids).all()
    row = repair.encode_shard(ids)
    assert (repair.decode_shard(row) == ids).all()
    assert (repair.decode_slice(row, 17, length + 9) == ids[17 : length + 26]).all()
    # 5 own ids a copy stay; the passage is one symbol, and as many rules as it has ids but one
    assert len(seq) <= 8 * copies and len(rules) <= most


@pytest.mark.parametrize("ids", [[], [1], [1, 1], [7] * 1000, [1, 2] * 5, [1, 2, 3] * 4, [5, 5, 6] * 9])
def test_small_and_even_sequences(ids):
    rules, lengths, seq = repair.compress(ids)
    assert repair.expand(rules, lengths, seq).tolist() == ids
    row = repair.encode_shard(np.array(ids, dtype="<u4"))
    assert repair.decode_shard(row).tolist() == ids
    for a in range(len(ids)):
        assert repair.decode_slice(row, a, 3).tolist() == ids[a : a + 3]


def test_no_pair_is_left_four_times():
    rng = np.random.default_rng(4)
    _, _, seq = repair.compress(np.minimum(rng.geometric(0.05, 50_000), 60000))
    pairs = seq[:-1].astype(np.int64) << 32 | seq[1:]
    value, count = np.unique(pairs[(seq[:-1] != seq[1:])], return_counts=True)
    assert len(value) and count.max() < repair.LEVELS[-1]


def test_ids_beyond_the_base_are_refused():
    with pytest.raises(ValueError, match="ids"):
        repair.compress([1, repair.BASE])


@pytest.mark.parametrize("width", [16, 17, 19])
def test_packed_symbols_are_read_from_anywhere(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1000).astype("<u4")
    data = repair.packed(x, width)
    assert len(data) == 2000 + (width - 16) * 125
    for a, b in ((0, 1000), (7, 9), (999, 1000), (512, 777), (1000, 1000)):
        assert (repair.unpacked(data, 1000, width, a, b) == x[a:b]).all()


def test_a_shard_of_documents_is_smaller_than_plain_ids_and_gives_single_documents():
    text = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text")
    enc = ChunkEncoder(tokenizer_path())
    ids, ends = enc.encode_with_end(text)
    row = repair.encode_shard(ids)
    held = sum(len(row[c]) for c in ("rules", "lengths", "body", "marks"))
    assert held < 0.7 * 2 * len(ids)
    row["n_tokens"] = np.diff(ends).tolist()
    for i in range(0, len(text), 41):
        assert (repair.document(row, i) == ids[ends[i] : ends[i + 1]]).all()


def test_wanted_documents_come_from_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    repair.write_ids(docs, tokenizer_path(), str(tmp_path / "ids"), shard_tokens=20_000)
    texts = {r.doc_id: r.text for r in docs.filter("doc_id in (3, 77, 500)").collect()}
    tok = ChunkEncoder(tokenizer_path()).tok
    got = {r.doc_id: r.ids for r in repair.read_documents(spark, str(tmp_path / "ids"), [3, 77, 500, 10**9]).collect()}
    assert got == {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}


def test_repeated_and_null_ids_stay_apart_in_a_fixed_order(spark, tmp_path):
    rows = [(2, "two words"), (2, "other"), (None, "no id"), (2, "two words"), (1, None), (3, "")]
    got = []
    for k, parts in enumerate((1, 3)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        repair.write_ids(docs, tokenizer_path(), str(tmp_path / f"ids{k}"))
        got.append(sorted(repair.read_ids(spark, str(tmp_path / f"ids{k}")).collect(), key=lambda r: r.start))
    assert got[0] == got[1] and [r.doc_id for r in got[0]] == [None, 1, 2, 2, 2, 3]
    assert [r.start for r in got[0]][1:] == list(np.cumsum([r.n_tokens for r in got[0]])[:-1])
