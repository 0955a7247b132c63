"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits with A-Z lowered, hashed to BUCKETS. Passages are WINDOW words long and begin
every STRIDE words (ITEM_STRIDE in items, so that some passage of an item lies where one of the document does).

1. Document frequencies of all buckets over all documents give (squared) idf weights.
2. A randomised SVD of passages' TF-IDF rows A gives the latent space: Y = A'(A R) for a random R is summed over the
   cluster, and the driver turns Y, BUCKETS x RANK numbers, into singular vectors by the single-pass (Nystroem) scheme.
   The space is fitted on all documents, whatever their number.
3. Chunks of every document are bounded first: a text with LCS_PARAPHRASE of an item's words holds a part of its rarest
   words, and near them enough of its words (see spots). This bound is exact: what fails it is no leak.
4. Passages of what is left are projected and compared with the item's passages by cosine. A cosine of COSINE gives a
   region aligned to the item; the grid regions of step 3 follow. Each aligned region lies within one of the grid, so
   which leaks there are, and their shares, never depends on the space: it gives the cosine and the place.
5. In each region with enough of the item's words, the longest common subsequence of the item's words and the
   document's decides: a share of LCS_SURE of the item is a leak; so is LCS_PARAPHRASE if the item's answer, its last
   ANSWER words, comes back with ANSWER_SHARE in order too.

Words that share a bucket raise the counts of steps 3 and 5's bounds and blur the cosine: a bound gets weaker, no leak
is lost. Items go through in blocks of ITEM_BLOCK; documents are read once a block. Null and empty texts and items have
no words and match nothing. Items shorter than MIN_WORDS words match only as a run of adjacent words. A document and
item give one row, with the best share; ties keep the first place. Repeated rows of a doc_id (null is one id too) or
item_id give one row. decontaminate judges each row by its own text, whatever its id. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import ship, table, tidy
from .hashing import PUNCTUATED, buffer_of, words_of

BUCKETS = 1 << 14
RANK = 48
OVERSAMPLE = 8
WINDOW, STRIDE, ITEM_STRIDE = 16, 8, 4
COSINE = 0.6
LCS_SURE, LCS_PARAPHRASE = 0.8, 0.6
ANSWER, ANSWER_SHARE = 8, 0.75
MIN_WORDS = 5
ITEM_BLOCK = 16_384
HITS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, place long"
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 20
#: Words at which the search by rare words cuts texts.
CHUNK = 256
#: Numbers in a work array of the search: cosines, region words or slots at once.
AT_ONCE = 1 << 22


def _words(texts) -> tuple[np.ndarray, np.ndarray, int]:
    """(word hashes, their rows, number of rows)."""
    raw, off = buffer_of(texts)
    h, rows, _ = words_of(raw, off, PUNCTUATED)
    return h, rows, len(off) - 1


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - int(np.log2(BUCKETS)))).astype(np.int64)


def _window_sums(rows: np.ndarray, vectors: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the word vectors of each passage; its row; its first word. Passages never cross rows."""
    n = len(rows)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros((0, vectors.shape[1]), np.float32), z, z
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    per = -(-count // stride)
    block_row = np.repeat(np.arange(len(first)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = first[block_row] + nth * stride
    sums = np.add.reduceat(vectors, begin, axis=0)
    out = sums.copy()
    for k in range(1, WINDOW // stride):
        same = np.flatnonzero(nth[k:] >= k)
        out[same] += sums[same + k]
    # a passage that only repeats the tail of the one before it says nothing new
    full = (nth == 0) | (nth * stride + WINDOW - stride < count[block_row])
    return out[full], rows[begin][full], begin[full]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket and in all: BUCKETS numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for lo, m in slices(batch.column(0), SLICE):
                h, rows, _ = _words(batch.column(0).slice(lo, m))
                df += np.bincount(np.unique(rows * BUCKETS + _buckets(h)) % BUCKETS, minlength=BUCKETS)
                n += m
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(BUCKETS), -1], pa.int32()), pa.array(np.r_[df, n], pa.int64())], ["bucket", "df"])

    ship(docs.sparkSession)
    got = docs.select("text").mapInArrow(tidy(run), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[got["bucket"].to_numpy()] = got["df"].to_numpy()
    return df[:-1], int(df[-1])


def idf_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Squared idf: words of most documents, which would fill the leading singular vectors, fade out."""
    return (np.log((n + 1) / (df + 1)) ** 2).astype(np.float32)


def latent_basis(docs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """BUCKETS x rank: right singular vectors of the passages' TF-IDF matrix over their singular values."""
    k = rank + OVERSAMPLE
    random = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, k)))[0].astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((idf, random))  # BUCKETS x k numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        idf, random = shared.value
        weighted = random * idf[:, None]
        y = np.zeros((BUCKETS, k), dtype=np.float32)
        for batch in batches:
            for lo, m in slices(batch.column(0), SLICE):
                h, rows, _ = _words(batch.column(0).slice(lo, m))
                b = _buckets(h)
                if not len(b):
                    continue
                # disjoint passages here: every word counts once
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                place = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
                start = np.flatnonzero(place % WINDOW == 0)
                passage = np.add.reduceat(weighted[b], start, axis=0)
                of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(b)]))
                order = np.argsort(b.astype(np.uint16), kind="stable")  # two bytes: a radix sort
                at = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
                y[b[order][at]] += np.add.reduceat(passage[of[order]], at, axis=0)
        some = np.flatnonzero(np.abs(y).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(y[some, j], pa.float32()) for j in range(k))], ["bucket", *(f"y{j}" for j in range(k))])

    schema = "bucket int, " + ", ".join(f"y{j} float" for j in range(k))
    got = docs.select("text").mapInArrow(tidy(run), schema).groupBy("bucket").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(k))).toPandas()
    y = np.zeros((BUCKETS, k))
    y[got["bucket"].to_numpy()] = got[[f"y{j}" for j in range(k)]].to_numpy()
    y *= idf[:, None]  # the left factor's weights
    if not np.abs(y).sum():
        return np.zeros((BUCKETS, rank), dtype=np.float32)
    shift = 1e-6 * np.linalg.norm(y)
    y = y + shift * random
    middle = random.T.astype(float) @ y
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    values = np.maximum(values, values.max() * 1e-9)
    u, s, _ = np.linalg.svd(y @ (vectors / np.sqrt(values)) @ vectors.T, full_matrices=False)
    return (u[:, :rank] / np.maximum(s[:rank], s[0] * 1e-3)).astype(np.float32)


def lcs(masks: dict, words: list[int], size: int) -> int:
    """Longest common subsequence by bit-parallel rows; masks has the places of each of the item's size words."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(words: list[int]) -> dict:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class ItemBlock:
    """Latent passages and words of a block of items, in flat arrays that grow with the items' words."""

    def __init__(self, ids: list[int], texts: list[str | None], weighted: np.ndarray, idf: np.ndarray | None = None):
        import pyarrow as pa

        h, rows, _ = _words(pa.array(texts, pa.string()))
        vectors, at, begin = _window_sums(rows, weighted[_buckets(h)], ITEM_STRIDE)
        norm = np.linalg.norm(vectors, axis=1)
        live = norm > 0
        self.vectors, self.owner = vectors[live] / norm[live, None], at[live]
        first = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.place = begin[live] - first[self.owner]
        self.passage_at = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        self.ids = ids
        self.words = [h[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self._masks: dict[int, tuple[dict, dict]] = {}
        # keys: item and bucket; times: the item's words there
        self.keys, self.times = np.unique(rows * BUCKETS + _buckets(h), return_counts=True)
        item = self.keys // BUCKETS
        self.size = np.bincount(rows, minlength=len(ids))
        # words of a grid region: an aligned one, and a stride, so that each aligned one lies within one of the grid
        self.span = self.size + 2 * (STRIDE + self.size // 4) + STRIDE
        # the fewest words that can be a leak, and the rarest buckets of which a leak needs `least` words
        self.need = np.ceil(LCS_PARAPHRASE * self.size - 1e-9).astype(np.int64)
        rarity = idf if idf is not None else np.linalg.norm(weighted, axis=1)
        order = np.lexsort((-rarity[self.keys % BUCKETS], item))
        item, bucket, times = item[order], self.keys[order] % BUCKETS, self.times[order]
        before = np.cumsum(times) - times
        before -= before[np.searchsorted(item, item)]
        rare = before < (self.size - self.need + np.maximum(1, self.size // 4))[item]
        item, bucket, times = item[rare], bucket[rare], times[rare]
        held = np.bincount(item, times, len(ids))
        self.least = np.where(self.size > 0, held - (self.size - self.need), np.inf)
        by = np.argsort(bucket, kind="stable")
        self.rare_item, self.rare_times = item[by], times[by]
        self.degree = np.bincount(bucket, minlength=BUCKETS)
        self.rare_at = np.cumsum(self.degree) - self.degree
        self.known = np.zeros(BUCKETS, dtype=bool)
        self.known[self.keys % BUCKETS] = True

    def slot(self, item: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The place in keys of each item and bucket, -1 where the item has no such word."""
        out = np.full(len(item), -1, dtype=np.int64)
        some = np.flatnonzero(self.known[buckets])
        key = item[some] * BUCKETS + buckets[some]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        out[some[hit]] = at[hit]
        return out

    def near(self, item: np.ndarray, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, item passage, cosine) of pairs of an item and a passage's vector that come at least so close."""
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-30)[:, None]
        n = self.passage_at[item + 1] - self.passage_at[item]
        out = []
        step = max(1, AT_ONCE // (max(1, int(n.max(initial=1))) * vectors.shape[1]))
        for lo in range(0, len(item), step):
            m = n[lo : lo + step]
            pair = np.repeat(np.arange(lo, lo + len(m)), m)
            own = np.arange(len(pair)) + np.repeat(self.passage_at[item[lo : lo + step]] - np.cumsum(m) + m, m)
            c = np.einsum("ij,ij->i", vectors[pair], self.vectors[own])
            ok = c >= cosine
            out.append((pair[ok], own[ok], c[ok]))
        z = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (z, z, z.astype(float))

    def spots(self, first: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, row, start, stop) of the regions, every STRIDE words, that hold as many of an item's words as a leak
        needs. Bounds only, so that no leak is lost: an LCS of need words leaves out size - need, so all other of the
        item's rarest words occur within its chunk; and need words of its region are the item's."""
        n, reach = len(self.ids), int(self.span.max(initial=0))
        per = -(-np.diff(first) // CHUNK)
        row = np.repeat(np.arange(len(per)), per)
        begin = first[row] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * CHUNK
        size = np.minimum(first[row + 1], begin + CHUNK + reach) - begin
        found = []
        for lo in range(0, len(row), step := max(1, AT_ONCE // (8 * (CHUNK + reach)))):
            z = size[lo : lo + step]
            word = np.arange(z.sum()) + np.repeat(begin[lo : lo + step] - np.cumsum(z) + z, z)
            chunk, b = np.repeat(np.arange(len(z)), z), buckets[word]
            known = self.degree[b] > 0
            chunk, b = np.divmod(np.unique(chunk[known] * BUCKETS + b[known]), BUCKETS)
            d = self.degree[b]
            at = np.arange(d.sum()) + np.repeat(self.rare_at[b] - np.cumsum(d) + d, d)
            cell = np.repeat(chunk, d) * n + self.rare_item[at]
            if len(z) * n > 4 * len(cell):  # few of many cells
                cell, inverse = np.unique(cell, return_inverse=True)
                total = np.bincount(inverse, self.rare_times[at], len(cell))
            else:
                total = np.bincount(cell, self.rare_times[at], len(z) * n)
                cell = np.arange(len(z) * n)
            found.append(cell[total >= self.least[cell % n]] + lo * n)
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        out = []
        for lo in range(0, len(pairs), step := max(1, AT_ONCE // (CHUNK + reach))):
            c, i = np.divmod(pairs[lo : lo + step], n)
            z = size[c]
            word = np.arange(z.sum()) + np.repeat(begin[c] - np.cumsum(z) + z, z)
            theirs = np.r_[0, np.cumsum(self.slot(np.repeat(i, z), buckets[word]) >= 0)]
            k = np.tile(np.arange(0, CHUNK, STRIDE), len(c))
            c, i, base = (np.repeat(x, CHUNK // STRIDE) for x in (c, i, np.cumsum(z) - z))
            start, end = begin[c] + k, first[row[c] + 1]
            # a region that only repeats the tail of the one before it says nothing new
            live = (start < end) & ((start == first[row[c]]) | (start - STRIDE + self.span[i] < end))
            c, i, k, base, start, end = c[live], i[live], k[live], base[live], start[live], end[live]
            stop = np.minimum(end, start + self.span[i])
            enough = theirs[base + k + stop - start] - theirs[base + k] >= self.need[i]
            out.append((i[enough], row[c[enough]], start[enough], stop[enough]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def possible(self, item: np.ndarray, start: np.ndarray, stop: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """True where enough of the item's words occur in the region, whatever their order: a bound on the LCS from
        above, so that no leak is lost."""
        ok = np.zeros(len(item), dtype=bool)
        step = max(1, AT_ONCE // max(1, int((stop - start).max(initial=1))))
        for lo in range(0, len(item), step):
            i, s, n = item[lo : lo + step], start[lo : lo + step], (stop - start)[lo : lo + step]
            word = np.arange(n.sum()) + np.repeat(s - np.cumsum(n) + n, n)
            slot = self.slot(np.repeat(i, n), buckets.take(word))
            there = np.unique((np.repeat(np.arange(len(i)), n) * len(self.keys) + slot)[slot >= 0])
            held = np.bincount(there // max(1, len(self.keys)), self.times[there % max(1, len(self.keys))], len(i))
            ok[lo : lo + step] = held >= LCS_PARAPHRASE * self.size[i]
        return ok

    def judge(self, item: int, region: list[int]) -> tuple[float, float]:
        """Shares of the item's words, and of its answer's, that come in order in the region; items shorter than
        MIN_WORDS come as a run of adjacent words or not at all."""
        words = self.words[item]
        n = len(words)
        if n < MIN_WORDS:
            return (float(any(region[k : k + n] == words for k in range(len(region) - n + 1))),) * 2
        if item not in self._masks:
            self._masks[item] = _masks(words), _masks(words[-ANSWER:])
        whole, answer = self._masks[item]
        a = min(ANSWER, n)
        return lcs(whole, region, n) / n, lcs(answer, region, a) / a


def is_leak(share: float, answer: float, n_words: int) -> bool:
    if n_words < MIN_WORDS:
        return share == 1.0
    return share >= LCS_SURE or (share >= LCS_PARAPHRASE and answer >= ANSWER_SHARE)


def _passages(item: np.ndarray, start: np.ndarray, stop: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (item, first word) of the passages that begin in the regions; head is the first word of each text."""
    n = -(-(stop - start) // STRIDE)
    begin = np.repeat(start, n) + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    head = np.repeat(head, n)
    begin = head + (begin - head) // STRIDE * STRIDE
    top = int(begin.max(initial=0)) + 1
    key = np.unique(np.repeat(item, n) * top + begin)
    return key // top, key % top


def leaks(texts, block: ItemBlock, weighted: np.ndarray, cosine: float = COSINE) -> dict[tuple[int, int], tuple]:
    """{(row, item): (cosine, LCS share, answer share, place)} of an Arrow column of texts; item counts in the block."""
    best: dict[tuple, tuple] = {}
    for lo, n in slices(texts, SLICE):
        h, rows, _ = _words(texts.slice(lo, n))
        if not len(h) or not block.size.any():
            continue
        first, buckets = np.searchsorted(rows, np.arange(n + 1)), _buckets(h)
        grid_item, grid_row, grid_start, grid_stop = block.spots(first, buckets)
        if not len(grid_item):
            continue
        # cosines of the passages in these regions
        item, begin = _passages(grid_item, grid_start, grid_stop, first[grid_row])
        once, which = np.unique(begin, return_inverse=True)
        size = np.minimum(once + WINDOW, first[rows[once] + 1]) - once
        vectors = np.zeros((len(once), weighted.shape[1]), np.float32)
        for k in range(WINDOW):
            there = np.flatnonzero(size > k)
            vectors[there] += weighted[buckets[once[there] + k]]
        pair, own, close = block.near(item, vectors[which], cosine)
        # the item would begin about here: its whole length and a margin on both sides
        near_item, at = item[pair], begin[pair]
        begins, length, row = at - block.place[own], block.size[near_item], rows[at]
        start = np.maximum(first[row], begins - STRIDE - length // 4)
        stop = np.maximum(start, np.minimum(first[row + 1], begins + length + STRIDE + length // 4))
        # near a text's first word regions start together and end apart: the key holds both ends
        top = int((stop - start).max(initial=0)) + 1
        one = np.sort(np.unique((start * top + stop - start) * len(block.ids) + near_item, return_index=True)[1])
        closest: dict[tuple, float] = {}
        for r, i, c in zip(row.tolist(), near_item.tolist(), close.tolist(), strict=True):
            closest[r, i] = max(c, closest.get((r, i), 0.0))
        item, row, start, stop = (np.r_[x[one], y] for x, y in ((near_item, grid_item), (row, grid_row), (start, grid_start), (stop, grid_stop)))
        ok = block.possible(item, start, stop, buckets)
        for i, r, s, e in zip(item[ok].tolist(), row[ok].tolist(), start[ok].tolist(), stop[ok].tolist(), strict=True):
            had = best.get((lo + r, i), (0.0, 0.0))
            if had[1] == 1.0:
                continue
            share, answer = block.judge(i, h[s:e].tolist())
            if is_leak(share, answer, len(block.words[i])) and share > had[1]:
                best[lo + r, i] = (closest.get((r, i), 0.0), share, answer, s - int(first[r]))
    return best


def item_blocks(items: DataFrame, weighted: np.ndarray, idf: np.ndarray) -> Iterator[ItemBlock]:
    """The distinct items in blocks of about ITEM_BLOCK, dealt by a hash."""
    items = items.select("item_id", "text").distinct()
    n_blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for b in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()  # about ITEM_BLOCK
        yield ItemBlock([r.item_id for r in rows], [r.text for r in rows], weighted, idf)


def latent_space(docs: DataFrame, basis_docs: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS x RANK weighted basis, idf weights) of all documents. A caller that asks for it gets the basis of about
    basis_docs of them, dealt by a hash of the text; the queries never do."""
    ship(docs.sparkSession)
    df, n = document_frequencies(docs)
    idf = idf_weights(df, n)
    some = docs if basis_docs is None or n <= basis_docs else docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * basis_docs / n))
    return latent_basis(some, idf) * idf[:, None], idf


def search(docs: DataFrame, block: ItemBlock, weighted: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """The leaks of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast((block, weighted))  # ITEM_BLOCK items, BUCKETS x RANK numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, weighted = shared.value
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            ids = batch.column(0)
            found = [(ids[r].as_py(), block.ids[i], *v) for (r, i), v in leaks(batch.column(1), block, weighted, cosine).items()]
            cols = zip(*found, strict=True) if found else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "place"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), HITS)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine (0 where none reaches COSINE), lcs_share, answer_share and place (the word where the
    item would begin, about) of every leak."""
    weighted, idf = latent_space(docs)
    out = None
    for block in item_blocks(items, weighted, idf):
        part = search(docs, block, weighted)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_share", "place"), F.struct("lcs_share", "cosine", -F.col("place"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no leak, all columns kept. Each row is judged by its own text: no join by id."""
    weighted, idf = latent_space(docs)
    at = docs.columns.index("text")
    for block in item_blocks(items, weighted, idf):
        docs = _without_leaks(docs, at, block, weighted)
    return docs


def _without_leaks(docs: DataFrame, at: int, block: ItemBlock, weighted: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((block, weighted))  # ITEM_BLOCK items, BUCKETS x RANK numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, weighted = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[r for r, _ in leaks(batch.column(at), block, weighted)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
