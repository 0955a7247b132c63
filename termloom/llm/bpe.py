"""Whole-text byte-level BPE encoding with the tokenizers library, memoised by piece.

The pre-token pattern of the vocabulary never joins a character that is no white space to white space on its right, nor
a letter or digit to a comma or full stop on its right, and looks only to the right. A text may therefore be cut before
a blank or line feed that follows such a character, and before a comma or full stop that follows a letter or digit;
encoding the pieces apart gives the ids of the whole text. Cuts are found in the bytes of a whole Arrow column, equal
pieces fall together in Arrow's hash table, and only pieces not met before go through the library. Texts that hold a
special token's string go through the library whole, because it looks for those before it cuts.
"""

from __future__ import annotations

import os

import numpy as np

from .hashing import buffer_of

END_ID = 2
#: Bytes of text that are cut and looked up at once.
AT_ONCE = 1 << 23

# Classes of bytes: 1 a blank or line feed, 2 a comma or full stop, 4 an ASCII character that is no white space,
# 8 an ASCII letter or digit, 16 the second byte of a character, 32 the first byte of U+00C0 to U+02BF (no white space),
# 64 the second bytes of the two signs (times, divide) among the letters that begin with C3.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[32, 10]] |= 1
_CLASS[[44, 46]] |= 2
_CLASS[33:127] |= 4
for _c in range(128):
    if chr(_c).isalnum():
        _CLASS[_c] |= 8
_CLASS[0x80:0xC0] |= 16
_CLASS[0xC3:0xCB] |= 32
_SIGNS = (0x97, 0xB7)
_CLASS[list(_SIGNS)] |= 64
_TABLE = _CLASS.tobytes()
_ALNUM = frozenset(np.flatnonzero(_CLASS & 8).tolist())
_WIDE = frozenset(np.flatnonzero(_CLASS & 32).tolist())


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places in the bytes of whole texts before which a text may be cut."""
    kind = np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8)
    wide = np.zeros_like(kind)  # 1 at the second byte of a character that is known to be no white space
    wide[1:] = (kind[1:] >> 4) & (kind[:-1] >> 5) & 1
    solid, letter = (kind >> 2) | wide, (kind >> 3) | (wide & ~(kind >> 6))
    return np.flatnonzero(((kind[1:] & solid[:-1]) | ((kind[1:] >> 1) & letter[:-1])) & 1) + 1


def _ends_in_letter(piece: bytes) -> bool:
    """True if piece ends in a letter or digit that is known as such."""
    return piece[-1] in _ALNUM or (len(piece) > 1 and piece[-2] in _WIDE and piece[-1] not in _SIGNS)


def slices(texts, at_once: int = AT_ONCE) -> list[tuple[int, int]]:
    """(first row, number of rows) of parts of an Arrow column of about at_once bytes; a longer text is a part."""
    off = buffer_of(texts)[1]
    at = np.unique(np.r_[0, np.searchsorted(off, np.arange(0, off[-1], at_once)), len(texts)])
    return [(a, b - a) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids. The memo has two generations of at most about max_entries
    pieces of at most max_bytes: a full one becomes the old one, whose pieces live on when they are met again. Longer
    pieces stay only for their batch, so memory is bounded."""

    def __init__(self, path: str, max_entries: int = 400_000, max_bytes: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.max_entries, self.max_bytes = max_entries, max_bytes
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # the vocabulary writes each byte as one character
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        self.n_bytes[list(vocab.values())] = [len(x) for x in vocab]

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, straight from the library."""
        from array import array

        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces by the library. Those that begin with a blank or line feed and end in a letter or digit may
        follow each other in one text, which is far cheaper than a text for each."""
        out: list[bytes] = [b""] * len(pieces)
        joint = [i for i, p in enumerate(pieces) if p[0] in b" \n" and _ends_in_letter(p)]
        alone = sorted(set(range(len(pieces))).difference(joint))
        for lo in range(0, len(joint), 32_768):
            some = joint[lo : lo + 32_768]
            got = self.raw([b"".join([pieces[i] for i in some[k : k + 256]]).decode() for k in range(0, len(some), 256)])
            data = b"".join(got)
            ends = np.cumsum(self.n_bytes[np.frombuffer(data, "<u4")])
            want = np.cumsum([len(pieces[i]) for i in some])
            last = np.searchsorted(ends, want)
            if not (ends[last] == want).all():
                raise RuntimeError("pieces did not end where ids end")
            cut = 4 * np.r_[0, last + 1]
            for i, a, b in zip(some, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[i] = data[a:b]
        for lo in range(0, len(alone), 4096):
            some = alone[lo : lo + 4096]
            for i, ids in zip(some, self.raw([pieces[i].decode() for i in some]), strict=True):
                out[i] = ids
        return out

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        out = list(map(self.young.get, pieces))
        rest = [i for i, x in enumerate(out) if x is None]
        some = [pieces[i] for i in rest]
        ids = list(map(self.old.get, some))
        new = [j for j, x in enumerate(ids) if x is None]
        for j, x in zip(new, self._learn([some[j] for j in new]), strict=True):
            ids[j] = x
        for i, x in zip(rest, ids, strict=True):
            out[i] = x
        self.young.update(zip(some, ids, strict=True))
        for p in [p for p in some if len(p) > self.max_bytes]:
            del self.young[p]
        if len(self.young) > self.max_entries:
            self.old, self.young = self.young, {}
        return out

    def encode_arrow(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets with one more entry than texts); nulls are empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            whole |= np.asarray(pc.fill_null(pc.match_substring(texts, token), False))
        ids, sizes = [], []
        at = np.unique(np.r_[[a for a, _ in slices(texts)], np.flatnonzero(whole), np.flatnonzero(whole) + 1, len(texts)]).astype(int)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if whole[a]:
                part = np.frombuffer(self.raw([texts[a].as_py()])[0], "<u4")
                size = np.array([len(part)])
            else:
                part, size = self._encode_cut(texts.slice(a, b - a))
            ids.append(part)
            sizes.append(size)
        zero = np.zeros(0, np.int64)
        return np.concatenate([zero.astype("<u4"), *ids]), np.r_[0, np.cumsum(np.concatenate([zero, *sizes]))]

    def _encode_cut(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts without special tokens."""
        import pyarrow as pa

        raw, off = buffer_of(texts)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        mark = np.zeros(len(raw) + 1, dtype=bool)
        mark[cuts(raw)] = True
        mark[off] = True  # texts touch in the buffer
        begin = np.flatnonzero(mark)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(raw)]).dictionary_encode()
        known = pa.array(self.look_up(pieces.dictionary.to_pylist()), pa.large_binary())
        got = known.take(pieces.indices)
        _, ends, data = got.buffers()
        ends = np.frombuffer(ends, np.int64)[got.offset : got.offset + len(got) + 1]
        ids = np.frombuffer(data, "<u4")[ends[0] // 4 : ends[-1] // 4]
        return ids, np.diff(ends[np.searchsorted(begin, off)]) // 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; None and '' give no ids."""
        import pyarrow as pa

        ids, off = self.encode_arrow(pa.array(texts, pa.large_string()))
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        """Numbers of ids of single pieces, memoised."""
        return [len(x) // 4 for x in self.look_up([p.encode() for p in pieces])]

    def encode_with_end(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """As encode_arrow, with END_ID after the ids of each text."""
        ids, off = self.encode_arrow(texts)
        out = np.full(len(ids) + len(off) - 1, END_ID, dtype="<u4")
        ends = off + np.arange(len(off))
        body = np.ones(len(out), dtype=bool)
        body[ends[1:] - 1] = False
        out[body] = ids
        return out, ends


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, max_entries: int = 400_000) -> ChunkEncoder:
    """One encoder per worker process and vocabulary; it takes on the last size of memo that was asked for."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, max_entries)
    enc = _ENCODERS[path]
    if max_entries < enc.max_entries:
        enc.young, enc.old = {}, {}
    enc.max_entries = max_entries
    return enc
