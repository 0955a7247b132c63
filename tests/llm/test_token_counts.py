import random

from termloom.llm.bpe import ChunkEncoder
from termloom.llm.common import tokenizer_path
from termloom.llm.token_counts import TokenTree, segments


def test_trees_follow_random_edits_like_a_whole_encoding():
    enc = ChunkEncoder(tokenizer_path())
    one = lambda t: len(enc.raw([t])[0]) // 4
    rng = random.Random(5)
    alphabet = ["the ", "a", " ", "\n", ",", ".", "Ünder", "12", "'s", "  ", "\t", "日本", "!!"]
    for _ in range(60):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        parts = segments(text)
        assert "".join(parts) == text
        tree = TokenTree(parts, [one(p) for p in parts])
        assert tree.tokens == (one(text) if text else 0)
        for _ in range(8):
            start, length = rng.randrange(0, len(text) + 3), rng.randrange(0, 6)
            new = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 4)))
            again = tree.edit(start, length, new, one)
            at = min(start, len(text))
            text = text[:at] + new + text[at + length :]
            assert tree.text() == text
            assert tree.chars == len(text)
            assert tree.tokens == (one(text) if text else 0)
            assert again <= len(text)


def test_memoised_encoding_equals_the_library():
    texts = ["", None, "a  b\n\n c \td", " x", "don't  'll", "a. b., c", "..", "x", ",a", "é.b", "日本.、, a", "one two\nthree, four.\nfive", "<|endoftext|> x"]
    for room in (3, 500_000):
        enc = ChunkEncoder(tokenizer_path(), max_entries=room)
        for _ in range(2):
            assert enc.encode(texts) == [enc.raw([t or ""])[0] for t in texts]


def test_random_texts_equal_the_library():
    parts = ["the ", "a", " ", "\n", ",", ".", "Ü", "ß", "×", "÷", " ", "12", "'s", "'ll", "  ", "\t", "日本", "!!", ")", "\x85", "\x1c", "é", "\u3000", "<|endoftext|>", "٣", "🎉", "ʰ", "\u0300"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(5000)]
    enc = ChunkEncoder(tokenizer_path())
    assert enc.encode(texts) == enc.raw(texts)
