"""Shortcut encoding against the library, over texts of tricky characters and batches of any size."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from duelwise.llm.encode import Encoder

TRICKY = ["a", "b", "S", "t", "é", "ß", "Ö", "×", "÷", "°", "ø", "'", "'s", "'ll", ".", ",", "$", "%%", "_", "-", "(", "<", "<|endoftext|>", "1", "23", "½", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", " ", "́", "日", "한", "😀", "’", "—", "Ā", "ſ", "the", "ing", "\x00", "﻿"]


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_agrees_with_the_library(name, spaces):
    path, r = public_tokenizers.path(name), random.Random(spaces)
    library, own = Tokenizer.from_file(path), Encoder(path, spaces)
    texts = ["".join(r.choice(TRICKY[: r.choice([17, 30, len(TRICKY)])]) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    texts += ["x.'s", "a'$b", "°$a", "$°", "×$", "a×b", "é$é", "$é", "a$1", "1$a", "a.b.c", "...a", "a...", "'", "$'s", "é$", "$́a", "á$"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for limit in (50, 1 << 22):
        got = list(own.rows(pa.array(texts, pa.string()), limit))
        assert [i for i, (x, y) in enumerate(zip(got, want, strict=True)) if x.tolist() != y] == []


def test_encoder_forgets(monkeypatch):
    """With a memory of a few pieces the ids are the same, and the memory stays small."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, small = Encoder(path, True), Encoder(path, True)
    monkeypatch.setattr(small, "MOST", 5, raising=False)
    r = random.Random(1)
    texts = [" ".join(f"word{r.randint(0, 300)}" for _ in range(9)) for _ in range(300)]
    for t in texts:
        assert (small.ids(t) == whole.ids(t)).all()
        assert len(small.known) <= 5 + 9
        assert len(small.known.old) <= 5 + 9


def test_columns_with_nulls_and_slices():
    own = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    column = pa.array(["a b", None, "", "c\x0bd", "e", None], pa.string())
    want = [own.ids(t or "").tolist() for t in column.to_pylist()]
    assert [x.tolist() for x in own.rows(column)] == want
    assert [x.tolist() for x in own.rows(column.slice(2, 3))] == want[2:5]
    assert list(own.rows(column.slice(0, 0))) == []
    assert next(own.rows(pa.array(["x " * 300_000]))).dtype == np.uint16
