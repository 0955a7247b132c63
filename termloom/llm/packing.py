"""Best-fit packing by the sum-of-squares rule.

Each document (its ids and the end id) is cut only if longer than the capacity; the first piece takes the remainder,
so at most one piece of a document is shorter than a whole sequence. Whole sequences need no place and never move.
Shorter pieces are placed one by one where the sum of squared counts of open bins per residual gap becomes smallest.
They are dealt to shards by a hash of their row, not of their id, and the number of shards follows their count, so a
shard holds about PIECES_PER_SHARD pieces whatever the ids are, and is packed alone in one task.

Null and empty texts are packed as one piece with the end id. Rows that repeat a doc_id are packed each by itself.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import materialise, ship, table, tidy, tokenizer_path

CAPACITY = 1024
PIECES_PER_SHARD = 131_072
#: Pieces of text that a worker remembers, and bytes of text that it encodes at once.
MEMO, AT_ONCE = 150_000, 1 << 22
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def place(sizes, capacity: int):
    """Bin and offset of each size, in the given order, by the sum-of-squares rule; ties go to the smallest gap.

    count[g] is the number of open bins with gap g. Putting size a into gap g changes the sum of squares by
    2 * (count[g - a] - count[g]) + 2, by 1 - 2 * count[a] if it fills the bin, and by 2 * count[capacity - a] + 1
    if it opens one.
    """
    import numpy as np

    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 0
    never = np.iinfo(np.int64).max
    for i, a in enumerate(map(int, sizes)):
        here = count[a:capacity]
        best, gap = (2 * count[capacity - a] + 1 if a < capacity else 0), capacity
        if here.size:
            change = np.where(here > 0, 2 * (count[: capacity - a] - here) + 2, never)
            if here[0]:
                change[0] = 1 - 2 * here[0]
            k = int(change.argmin())
            if change[k] != never and change[k] <= best:
                gap = a + k
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > a:
            open_bins[gap - a].append(b)
            count[gap - a] += 1
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, encoded in Arrow batches; row numbers the pieces, in no order."""

    def encode(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, row = encoder(tokenizer, MEMO), TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, n in slices(batch.column(1), AT_ONCE):
                ids, ends = enc.encode_with_end(batch.column(1).slice(lo, n))
                size = np.diff(ends)
                per = np.maximum(1, -(-size // capacity))
                doc = np.repeat(np.arange(n), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                first = (size - 1) % capacity + 1  # the remainder comes first
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                view = memoryview(ids).cast("B")
                at = 4 * (ends[doc] + start)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                cols = [batch.column(0).slice(lo, n).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(row + np.arange(len(doc)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "row"])
                row += len(doc)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(encode), PIECES + ", row long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Pieces with their sequence and offset. Whole sequences are numbered where they are read, below 0; only shorter
    pieces are dealt to shards and placed."""
    cut = materialise(docs.sparkSession, pieces(docs, tokenizer, capacity), "pieces")
    whole = cut.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // pieces_per_shard))

    def fill(key, frame):
        import numpy as np

        frame = frame.sort_values(["length", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        bins, offsets = place(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = np.int64(key[0]) * np.int64(1 << 36) + bins
        frame["offset"] = offsets
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    placed = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(fill, PACKED)
    return whole.unionByName(placed)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
