"""Token-id output compressed with Re-Pair grammars, one grammar per shard, with random access to documents.

File format. A table of Parquet files in the shared folder, one row per shard of consecutive documents:
  part int, shard int     order of the shards: by part, then by shard
  doc_id array<long>      the shard's documents in ascending order
  n_tokens array<int>     ids of each document, end id included
  width int               bits of a symbol
  n_rules int             rule r, a pair of symbols, is symbol BASE + r
  rules binary            left and right symbol of each rule, packed: see packed
  lengths binary          expansion length of each rule, little-endian unsigned 32-bit, zlib level 1
  n_symbols int           symbols left
  body binary             the sequence of symbols left, packed
  marks binary            ids before every BLOCK-th symbol of the body, little-endian unsigned 64-bit
A packed array holds the low 16 bits of all its symbols, then one plane of bits for each further bit of width, so any
stretch of symbols is read without the rest. A document's ids are found from n_tokens, marks and lengths: see document.

Re-Pair repeatedly replaces the most frequent pairs of adjacent symbols by new symbols. A round here takes all pairs
that occur at least so many times; where two overlap the more frequent pair wins. Rounds go on until no such pair is
left, for each of LEVELS in turn; within a level, rounds after the first count only pairs that hold a symbol of the last
round, as the others were counted before, and at the end those that lost places to others. At the last level a rule no longer pays: its two symbols and its length
against one symbol saved an occurrence.

Ids must be below BASE; others raise ValueError. Null and empty texts hold the end id alone. Rows that repeat a doc_id
stay apart, in the order of their text hash. A null doc_id comes first. Texts of any length are held whole in one
shard. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import shared_path, ship, table, tidy, tokenizer_path

BASE = 1 << 16
SHARD_TOKENS = 1 << 20
LEVELS = (4,)
BLOCK = 1024
COLUMNS = ["part", "shard", "doc_id", "n_tokens", "width", "n_rules", "rules", "lengths", "n_symbols", "body", "marks"]
SHARD_SCHEMA = "part int, shard int, doc_id array<long>, n_tokens array<int>, width int, n_rules int, rules binary, lengths binary, n_symbols int, body binary, marks binary"
DECODED = "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long"


def _frequent(seq: np.ndarray, at: np.ndarray | None, least: int):
    """(left symbols, right symbols, counts) of the adjacent pairs that occur at least so many times, and the places
    where they begin with the number of the pair there. Only pairs that begin at the places at (None: everywhere)."""
    left, right = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
    at = np.arange(len(left)) if at is None else at
    high, wide = max(1, int(seq.max()).bit_length()), max(1, len(seq).bit_length())
    pair = left.astype(np.int64)
    pair <<= high
    pair |= right
    joint = 2 * high + wide <= 63
    if joint:  # pair and place in one number: one sort groups them
        pair <<= wide
        pair |= at
        pair.sort()
        place, pair = pair, pair >> wide
    else:
        order = np.argsort(pair, kind="stable")
        place, pair = at[order], pair[order]
    begin = np.r_[0, np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(pair)]
    count = np.diff(begin)
    often = count >= least
    pair, place, count = pair[begin[:-1][often]], place[np.repeat(often, count)], count[often]
    if joint:
        place &= (1 << wide) - 1
    k = np.repeat(np.arange(len(pair), dtype=np.int32), count)
    # a pair of equal symbols overlaps itself in a run: every other one counts, from the left
    again = np.flatnonzero((place[1:] == place[:-1] + 1) & (k[1:] == k[:-1])) + 1
    if len(again):
        start = np.ones(len(place), dtype=bool)
        start[again] = False
        first = np.flatnonzero(start)
        nth = np.arange(len(place)) - np.repeat(first, np.diff(np.r_[first, len(place)]))
        place, k = place[nth % 2 == 0], k[nth % 2 == 0]
        count = np.bincount(k, minlength=len(pair))
        stay = (count >= least)[k]
        place, k = place[stay], k[stay]
    return pair >> high, pair & ((1 << high) - 1), count, place, k


def _winners(n: int, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of places no two of which are neighbours: three times those that outrank both neighbours."""
    worth = np.zeros(n + 2, dtype=np.int32)  # of place i at i + 1
    if len(place) > n // 16:  # many places: over the whole sequence
        worth[place + 1] = rank
        left, win = worth.copy(), np.zeros(n, dtype=bool)
        for _ in range(3):
            won = (left[1:-1] > left[:-2]) & (left[1:-1] > left[2:])
            win |= won
            free = ~won
            left[1:-1] *= free
            left[:-2] *= free
            left[2:] *= free
        at = np.flatnonzero(win)
        return at, worth[at + 1]
    out = []
    for _ in range(3):
        worth[place + 1] = rank
        won = (rank > worth[place]) & (rank > worth[place + 2])
        at = place[won]
        out.append((at, rank[won]))
        worth[place + 1] = 0
        taken = np.zeros(n + 2, dtype=bool)
        taken[at] = taken[at + 1] = taken[at + 2] = True
        free = ~taken[place + 1]
        place, rank = place[free], rank[free]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _choose(seq: np.ndarray, at: np.ndarray | None, least: int):
    """(pairs, places, number of the pair at each place, pairs that wait) of a round: no two places overlap, every pair
    has at least `least` of them. Pairs wait that lost so many places to others that they may still repeat as often.
    The most frequent pair always takes all its places, so rounds come to an end."""
    none, no_pairs = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    if (len(seq) - 1 if at is None else len(at)) < least:
        return no_pairs, none, none, no_pairs
    left, right, count, place, k = _frequent(seq, at, least)
    if not len(place):
        return no_pairs, none, none, no_pairs
    # equal counts fall to the larger mixed number, so that neighbours of one count do not win left to right
    order = np.lexsort(((np.arange(len(left)) * 0x9E3779B1) & 0xFFFFFFFF, count))
    rank = np.zeros(len(left), np.int32)
    rank[order] = np.arange(1, len(left) + 1)
    at, won = _winners(len(seq), place, rank[k])
    k = order[won - 1]
    taken = np.bincount(k, minlength=len(left))
    many = taken >= least
    at, k = at[many[k]], k[many[k]]
    pairs = np.stack([left, right], axis=1)
    return pairs[many], at, (np.cumsum(many) - 1)[k], pairs[count - np.where(many, taken, 0) >= least]


def _places_of(seq: np.ndarray, pairs: np.ndarray, n_symbols: int) -> np.ndarray:
    """Places that may begin one of the pairs."""
    left, right = np.zeros(n_symbols, dtype=bool), np.zeros(n_symbols, dtype=bool)
    left[pairs[:, 0]], right[pairs[:, 1]] = True, True
    return np.flatnonzero(left[seq[:-1]] & right[seq[1:]])


def compress(ids, levels: tuple[int, ...] = LEVELS):
    """(rules, lengths, sequence) of an array of ids below BASE."""
    ids = np.asarray(ids)
    if len(ids) and (ids.max() >= BASE or ids.min() < 0):
        raise ValueError(f"ids must lie in 0 .. {BASE - 1}")
    seq = ids.astype(np.int32)
    size, rules = np.ones(BASE, dtype=np.int64), [np.zeros((0, 2), np.int64)]
    for least in levels:
        at, wait = None, []
        while len(seq) > 1:
            pairs, at, k, later = _choose(seq, at, least)
            wait.append(later)
            if len(pairs):
                fresh = len(size)
                rules.append(pairs)
                size = np.r_[size, size[pairs[:, 0]] + size[pairs[:, 1]]]
                seq[at] = fresh + k
                keep = np.ones(len(seq), dtype=bool)
                keep[at + 1] = False
                seq = seq[keep]
                # only pairs with a symbol of this round are new; the others cannot have grown
                new = seq >= fresh
                at = np.flatnonzero(new[:-1] | new[1:])
                continue
            waiting = np.concatenate(wait)
            if not len(waiting) or least != levels[-1]:  # the next level counts all pairs anyway
                break
            at, wait = _places_of(seq, waiting, len(size)), []
    return np.concatenate(rules).astype("<u4"), size[BASE:].astype("<u4"), seq.astype("<u4")


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin[i] .. begin[i] + size[i] - 1 of all i, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)


def expand(rules, lengths, seq) -> np.ndarray:
    """The ids of a sequence of symbols. Rules are written out in runs whose parts are all known before the run."""
    rules, lengths, seq = rules.astype(np.int64), lengths.astype(np.int64), seq.astype(np.int64)
    size = np.r_[np.ones(BASE, np.int64), lengths]
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), dtype="<u4")
    flat[:BASE] = np.arange(BASE)
    newest = np.maximum(rules[:, 0], rules[:, 1]) if len(rules) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(rules):
        ahead, step = None, 1024
        while ahead is None:
            late = np.flatnonzero(newest[lo : lo + step] >= BASE + lo)
            ahead = lo + int(late[0]) if len(late) else (len(rules) if lo + step >= len(rules) else None)
            step *= 8
        parts = rules[lo:ahead].ravel()
        flat[begin[BASE + lo] : begin[BASE + ahead - 1] + size[BASE + ahead - 1]] = flat[_stretches(begin[parts], size[parts])]
        lo = ahead
    return flat[_stretches(begin[seq], size[seq])]


def expand_some(rules, seq) -> np.ndarray:
    """The ids of a few symbols, by their own rules alone."""
    seq = seq.astype(np.int64)
    while (deep := seq >= BASE).any():
        n = 1 + deep
        out = seq[np.repeat(np.arange(len(seq)), n)]
        at = (np.cumsum(n) - n)[deep]
        out[at], out[at + 1] = rules[seq[deep] - BASE].astype(np.int64).T
        seq = out
    return seq.astype("<u4")


def packed(symbols: np.ndarray, width: int) -> bytes:
    """The low 16 bits of all symbols, then a plane of bits for each further bit of width."""
    planes = [np.packbits((symbols >> np.uint32(b)).astype(np.uint8) & 1, bitorder="little").tobytes() for b in range(16, width)]
    return b"".join([symbols.astype("<u2").tobytes(), *planes])


def unpacked(data: bytes, n: int, width: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Symbols start .. stop - 1 of n packed ones; nothing else is read."""
    stop = n if stop is None else min(stop, n)
    out = np.frombuffer(data, "<u2", stop - start, 2 * start).astype("<u4")
    first, last = start // 8, -(-stop // 8)
    for k, b in enumerate(range(16, width)):
        plane = np.frombuffer(data, np.uint8, last - first, 2 * n + k * -(-n // 8) + first)
        out |= np.unpackbits(plane, bitorder="little")[start - 8 * first : stop - 8 * first].astype("<u4") << np.uint32(b)
    return out


def encode_shard(ids: np.ndarray) -> dict:
    """The columns of a shard that hold its ids."""
    rules, lengths, seq = compress(ids)
    width = max(16, int(max(seq.max(initial=0), rules.max(initial=0))).bit_length())
    size = np.where(seq < BASE, 1, lengths[np.maximum(seq, BASE) - BASE] if len(lengths) else 1).astype(np.int64)
    marks = (np.cumsum(size) - size)[::BLOCK].astype("<u8")
    return {"width": width, "n_rules": len(rules), "rules": packed(rules.ravel(), width), "lengths": zlib.compress(lengths.tobytes(), 1), "n_symbols": len(seq), "body": packed(seq, width), "marks": marks.tobytes()}


def decode_shard(row: dict) -> np.ndarray:
    """All ids of a shard."""
    rules = unpacked(row["rules"], 2 * row["n_rules"], row["width"]).reshape(-1, 2)
    return expand(rules, np.frombuffer(zlib.decompress(row["lengths"]), "<u4"), unpacked(row["body"], row["n_symbols"], row["width"]))


def decode_slice(row: dict, start: int, length: int) -> np.ndarray:
    """Ids start .. start + length - 1 of a shard: only the blocks of symbols that cover them are read and expanded."""
    marks = np.frombuffer(row["marks"], "<u8").astype(np.int64)
    a = max(0, int(np.searchsorted(marks, start, side="right")) - 1)
    b = int(np.searchsorted(marks, start + length, side="left"))
    symbols = unpacked(row["body"], row["n_symbols"], row["width"], a * BLOCK, b * BLOCK)
    lengths = np.frombuffer(zlib.decompress(row["lengths"]), "<u4").astype(np.int64)
    ends = np.cumsum(np.where(symbols < BASE, 1, lengths[np.maximum(symbols, BASE) - BASE] if len(lengths) else 1)) + (marks[a] if len(marks) else 0)
    p, q = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + length, side="left") + 1
    before = ends[p - 1] if p else (marks[a] if len(marks) else 0)
    rules = unpacked(row["rules"], 2 * row["n_rules"], row["width"]).reshape(-1, 2)
    return expand_some(rules, symbols[p:q])[start - before : start - before + length]


def document(row: dict, i: int) -> np.ndarray:
    """The ids of the shard's i-th document."""
    return decode_slice(row, sum(row["n_tokens"][:i]), row["n_tokens"][i])


def _pack_shards(tokenizer: str, shard_tokens: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        shard, docs, sizes, parts, held = 0, [], [], [], 0
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

        def row():
            cols = {"part": part, "shard": shard, "doc_id": sum(docs, []), "n_tokens": np.concatenate(sizes), **encode_shard(np.concatenate(parts))}
            return pa.RecordBatch.from_arrays([pa.array([cols[c]], t) for c, t in zip(COLUMNS, types, strict=True)], COLUMNS)

        for batch in batches:
            for lo, n in slices(batch.column(1)):
                names = batch.column(0).slice(lo, n).to_pylist()
                ids, ends = enc.encode_with_end(batch.column(1).slice(lo, n))
                at = 0
                while at < n:
                    # documents up to the one that fills the shard
                    to = min(n, int(np.searchsorted(ends, ends[at] + shard_tokens - held)))
                    docs.append(names[at:to])
                    sizes.append(np.diff(ends[at : to + 1]))
                    parts.append(ids[ends[at] : ends[to]])
                    held += int(ends[to] - ends[at])
                    at = to
                    if held >= shard_tokens:
                        yield row()
                        shard, docs, sizes, parts, held = shard + 1, [], [], [], 0
        if docs:
            yield row()

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes docs and writes the shards in ascending doc_id order."""
    ship(docs.sparkSession)
    first = F.col("doc_id").asc_nulls_first()
    ordered = docs.select("doc_id", "text").repartitionByRange(first).sortWithinPartitions(first, F.xxhash64("text"))
    ordered.mapInArrow(tidy(_pack_shards(tokenizer, shard_tokens)), SHARD_SCHEMA).write.parquet(path)


def _unpack(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(k)[i].as_py() for k, c in enumerate(COLUMNS)}
            size = np.asarray(row["n_tokens"], dtype=np.int64)
            ends = np.r_[0, np.cumsum(size)]
            view = memoryview(decode_shard(row)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            n = len(size)
            cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(ends[:-1]), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "shard", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """Per document doc_id, start, n_tokens and ids_crc32, decoded from the files.

    Starts add up in three levels: the parts before (a window over one small row a part), the shards before in the part
    (a window within it), and the documents before in the shard, which its decoder adds up.
    """
    ship(spark)
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = files.select("part", "shard", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before_shard = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.withColumn("in_part", F.coalesce(before_shard, F.lit(0))).join(parts.select("part", F.coalesce(before_part, F.lit(0)).alias("of_part")), "part")
    starts = starts.select("part", "shard", (F.col("of_part") + F.col("in_part")).alias("shard_start"))
    docs = files.mapInArrow(tidy(_unpack), DECODED).join(starts, ["part", "shard"])
    return docs.select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents by random access: shards without them are not decoded, and of the others
    only the blocks that hold them are. The list goes into the plan, so it must be short."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(COLUMNS)}
                got = [(d, document(row, j)) for j, d in enumerate(row["doc_id"]) if d in some]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    ship(spark)
    some = set(wanted)
    files = spark.read.schema(SHARD_SCHEMA).parquet(path).filter(F.arrays_overlap("doc_id", F.array(*map(F.lit, wanted)).cast("array<long>")))
    return files.mapInArrow(tidy(run), "doc_id long, ids array<long>")


def op3_repair_token_output(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "repair-ids")
    write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return read_ids(spark, path)
