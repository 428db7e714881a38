"""Remembered pieces give the tokenizer's own ids."""

from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftlake.llm import tokens


def raw(texts):
    return [t.encode() for t in texts]


@cache
def tokenizer(added=True):
    t = Tokenizer.from_file(tokens.vocabulary_path())
    if not added:
        t.encode_special_tokens = True
    return t


def plain(texts, added=True):
    return [e.ids for e in tokenizer(added).encode_batch(list(texts), add_special_tokens=False)]


CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "a b", "Don't stop 12 3's\n\n x  y  z", "\n a \n b", "x  y", "é à ü ñ 漢字 かな 😀 👩‍👩‍👧", "<|endoftext|> a <|endoftext|>", "a" * 5000 + " b", "1 22 333 !!! ... a.b, c", "�\u0000 ​", "tab\tx \tb", "a \x1c b\x1cc \x85 d"]


def test_cases():
    e = tokens.Encoder(tokens.vocabulary_path())
    for got, want in zip(e.batch(raw(CASES)), plain(CASES)):
        assert got.tolist() == want
    e.forget()
    assert [x.tolist() for x in e.batch(raw(CASES * 2))] == plain(CASES * 2)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\tab'sé1!.  漢\x1c\x1f\x85"), max_size=30), max_size=4))
def test_random(texts):
    e = tokens.encoder(tokens.vocabulary_path())
    assert [x.tolist() for x in e.batch(raw(texts))] == plain(texts)


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b", "x<|endoftext|>y <|endof", "text|> <|endoftext|", "a <|endoftext|>!\n", "é<|endoftext|>é"]


def test_strings_of_added_tokens():
    assert plain(["hello <|endoftext|> world"]) == [[31373, 220, 50256, 995]]
    for added in (True, False):
        e = tokens.Encoder(tokens.vocabulary_path(), added)
        assert [x.tolist() for x in e.batch(raw(SPECIAL + CASES))] == plain(SPECIAL + CASES, added)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "\n", "a", "endoftext", "é", "!"]), max_size=8).map("".join), max_size=4))
def test_random_around_added_tokens(texts):
    assert [x.tolist() for x in tokens.encoder(tokens.vocabulary_path()).batch(raw(texts))] == plain(texts)


def test_pieces_of_one_hash(monkeypatch):
    """Pieces that share a hash are told apart by their bytes."""
    e = tokens.Encoder(tokens.vocabulary_path())
    monkeypatch.setattr(tokens, "mix64", lambda x: x & np.uint64(0xFF) | np.uint64(1 << 60))
    texts = [" ".join(f"word{k * 7919 % 1000}" for k in range(n)) for n in (3, 40, 200)]
    for _ in range(2):
        assert [x.tolist() for x in e.batch(raw(texts))] == plain(texts)
