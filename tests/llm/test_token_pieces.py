"""Pieces of texts in front of the tokenizer: each is encoded once, and ids are the library's."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("tokenizers")

from tessera.llm import tokenfiles
from tessera.llm.queries import tokenizer_path


class Counted:
    """A model that counts its calls."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


def test_words_are_encoded_once():
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:130_000]
    texts = ["".join(f" {w}" for w in words[i : i + 500]) for i in range(0, len(words), 500)]
    encoder = tokenfiles.Encoder(tokenizer_path())
    encoder.model = counted = Counted(encoder.model)
    first, again = list(encoder.encode(texts)), list(encoder.encode(texts))
    assert counted.calls == len(words) and first == again
    assert all(ids == encoder.whole(text) for ids, text in zip(first[::20], texts[::20], strict=True))


@pytest.mark.parametrize(("block", "max_bytes"), [(1, 1), (40, 200), (1000, 5000), (2_000_000, 12 << 20)])
def test_ids_are_those_of_the_library(block, max_bytes):
    signs = ["a", "Is", "é", "ÿ", "ß", "ſ", "中", "😀", "'s", "'", ",", ".", "..", "12", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "-", "²", "ab" * 50]
    draw = random.Random(7)
    texts = ["", *("".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(1500)), "", " ", "word, " * 500]
    encoder = tokenfiles.Encoder(tokenizer_path(), block=block, max_bytes=max_bytes)
    for _ in range(2):
        assert list(encoder.encode(texts)) == [encoder.whole(text) for text in texts]
    assert encoder.pieces.nbytes + encoder.coded.nbytes <= max(max_bytes, 1000) and len(encoder.asked) == len(encoder.pieces) == len(encoder.coded)
    assert list(encoder.encode([])) == []
