"""Edit-aware token counts: a segment tree of pre-token counts per document.

The text is cut into segments at places where the vocabulary's pre-token pattern always ends one pre-token (before a
blank or line feed that follows a non-space, before a comma or full stop that follows a letter or digit). Two trees over the
segments hold sums of tokens and of code points. An edit is found by code point, and only the segments from the one
that holds the character before it to the one that holds the character after it are encoded again: both outer ends are
untouched text, so all other counts stand. The new region takes the slot of its first segment, the other slots fall to
0, and the sums above them are updated.

Null and empty texts have no segments and 0 tokens. Edits beyond the end apply at the end; null edits or replacements
do nothing or delete. Edits apply in order, each to the text that the last one left. Repeated rows are counted each by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import cuts, encoder
from .common import ship, table, tidy, tokenizer_path

COUNTS = "doc_id long, n_chars long, n_segments long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_chars_encoded_again long"


def segments(text: str) -> list[str]:
    """The parts of text between the places where it may be cut."""
    if not text:
        return []
    data = text.encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    at = cuts(raw)
    if b"\x01" in data:
        ends = [0, *at.tolist(), len(data)]
        return [data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]
    return np.insert(raw, at, 1).tobytes().decode().split("\x01")


class TokenTree:
    """Segments of one text with two sum trees; node 1 is the root, leaf i is node cap + i."""

    def __init__(self, parts: list[str], counts: list[int]):
        self.parts = list(parts)
        self.cap = 1 << max(0, len(parts) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.cap), dtype=np.int64)
        self.sums[0, self.cap : self.cap + len(parts)] = counts
        self.sums[1, self.cap : self.cap + len(parts)] = [len(p) for p in parts]
        lo = self.cap
        while lo > 1:
            half = lo // 2
            self.sums[:, half:lo] = self.sums[:, lo : 2 * lo : 2] + self.sums[:, lo + 1 : 2 * lo : 2]
            lo = half

    @property
    def tokens(self) -> int:
        return int(self.sums[0, 1]) if self.parts else 0

    @property
    def chars(self) -> int:
        return int(self.sums[1, 1]) if self.parts else 0

    def locate(self, pos: int) -> tuple[int, int]:
        """(segment, place in it) of a code point before the end."""
        node = 1
        while node < self.cap:
            node *= 2
            if pos >= self.sums[1, node]:
                pos -= int(self.sums[1, node])
                node += 1
        return node - self.cap, pos

    def _set(self, i: int, part: str, tokens: int) -> None:
        self.parts[i] = part
        node = self.cap + i
        change = np.array([tokens, len(part)]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def edit(self, start: int, length: int, new: str, count) -> int:
        """Replaces length code points at start by new; count gives the tokens of a text. Returns the code points
        that were encoded again."""
        size = self.chars
        start, length = min(max(start, 0), size), max(length, 0)
        end = min(start + length, size)
        if not self.parts:
            self.__init__([new], [count(new)])
            return len(new)
        a, _ = self.locate(max(start - 1, 0)) if size else (0, 0)
        b, _ = self.locate(end) if end < size else (len(self.parts) - 1, 0)
        region = "".join(self.parts[a : b + 1])
        offset = start - self._before(a)
        region = region[:offset] + new + region[offset + end - start :]
        for i in range(a + 1, b + 1):
            if self.parts[i]:
                self._set(i, "", 0)
        self._set(a, region, count(region))
        return len(region)

    def _before(self, i: int) -> int:
        """Code points before segment i, from the sums beside its path."""
        node, n = self.cap + i, 0
        while node > 1:
            if node & 1:
                n += int(self.sums[1, node - 1])
            node //= 2
        return n

    def text(self) -> str:
        return "".join(self.parts)


def count_tokens(docs: DataFrame, edits: Column, tokenizer: str) -> DataFrame:
    """Counts of every text before and after its edits, an array of struct(start, length, text) per row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(tokenizer)
        one = lambda t: len(enc.raw([t])[0]) // 4
        for batch in batches:
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                cut = [segments(t) for t in piece.column(1).to_pylist()]
                memo = dict(zip(keys := list(set().union(*cut)), enc.encode_pieces(keys), strict=True))
                for doc, parts, todo in zip(piece.column(0).to_pylist(), cut, piece.column(2).to_pylist(), strict=True):
                    tree = TokenTree(parts, [memo[p] for p in parts])
                    n_chars, n_tokens, again, done = tree.chars, tree.tokens, 0, 0
                    for e in todo or ():
                        if e is not None:
                            again += tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "", one)
                            done += 1
                    out.append((doc, n_chars, len(parts), n_tokens, done, tree.chars, tree.tokens, again))
            names = [c.split()[0] for c in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text", edits.alias("edits")).mapInArrow(tidy(run), COUNTS)


def sample_edits() -> Column:
    """The query's edits: words put into the middle, five code points taken out at a quarter, a stop at the end."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    e = lambda start, length, text: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(text).alias("text"))
    return F.array(e(n / 2, 0, " edited, twice"), e(n / 4, 5, ""), e(n + 9, 0, "."))


def op1_edit_aware_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), sample_edits(), tokenizer_path())
