"""Vectorised hashing of words, word shingles and character n-grams over the raw bytes of an Arrow string column.

Everything works on whole batches: the texts stay in one byte buffer, white space is found by table look-up, and
rolling polynomial hashes modulo 2^64 give every word or n-gram in a few passes, without Python work per row.
"""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C55 | 1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Also splits at ASCII punctuation, so that words compare without it.
PUNCTUATED = np.zeros(256, dtype=bool)
PUNCTUATED[:128] = [not chr(c).isalnum() for c in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, p: np.uint64 = P) -> np.ndarray:
    out = np.full(n, p, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))


def buffer_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array, nulls as empty; offsets has one more entry than rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - (off[0] if len(off) else 0)


def words_of(raw: np.ndarray, off: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lowered, its row, its first byte); words are runs without blank bytes."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    solid = ~blank[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True  # texts touch in the buffer: a word never runs across rows
    begin = np.flatnonzero(solid & (edge[:-1] | np.r_[True, ~solid[:-1]]))
    end = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    rows = np.searchsorted(off, begin, side="right") - 1
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((FOLD[raw].astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(len(raw), _INVERSE)[begin]
    return mix(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), rows, begin


def shingles_of(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of size words within a row; a row with fewer words gives all its words as one."""
    n = len(h)
    if not n:
        return h, rows
    q = np.uint64(0xA24BAED4963EE407)
    acc, valid = np.zeros(max(n - size + 1, 0), dtype=np.uint64), None
    for k in range(size):
        acc = acc * q + h[k : n - size + 1 + k] if len(acc) else acc
    if len(acc):
        valid = rows[: n - size + 1] == rows[size - 1 :]
        acc, at = mix(acc)[valid], rows[: n - size + 1][valid]
    else:
        at = rows[:0]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    few = np.flatnonzero(count < size)
    if len(few):
        extra = []
        for f in few:
            x = np.uint64(1)
            for v in h[first[f] : first[f] + count[f]]:
                with np.errstate(over="ignore"):
                    x = x * q + v
            extra.append(x)
        acc = np.r_[acc, mix(np.array(extra, dtype=np.uint64) + np.uint64(7))]
        at = np.r_[at, rows[first[few]]]
    return acc, at


def sets_of(texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the distinct shingle hashes of each row, ascending as unsigned numbers."""
    raw, off = buffer_of(texts)
    h, rows, _ = words_of(raw, off)
    values, at = shingles_of(h, rows, size)
    order = np.lexsort((values, at))
    values, at = values[order], at[order]
    if len(values):
        fresh = np.r_[True, (values[1:] != values[:-1]) | (at[1:] != at[:-1])]
        values, at = values[fresh], at[fresh]
    return values, np.searchsorted(at, np.arange(len(off)))
