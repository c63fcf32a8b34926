"""Pieces of texts cut all at once against the pattern, text by text."""

import random

import numpy as np

from stylometra.llm import pretokens

SIGNS = ["'", "s", "re", "ve", "ll", "a", "Z", "\xe9", " ", " ", "\n", "\t", "\xa0", "1", "\xb2", ".", "\xd7", "'s", "\x1c", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq"]


def characters(items):
    return np.frombuffer("".join(items).encode("utf-32-le"), np.int32), [len(x) for x in items]


def test_latin_texts_are_cut_at_once_as_by_the_pattern(monkeypatch):
    rnd = random.Random(4)
    texts = ["", *("".join(rnd.choices(SIGNS, k=rnd.randrange(25))) for _ in range(3000)), " ", "a  ", "'s"]
    raw = [t.encode("latin-1") for t in texts]
    want = [pretokens.pieces(t) for t in texts]
    pieces = pretokens.Pieces(characters, {})
    found = pieces._numbers_of_latin(raw)
    names = list(pieces.number)
    assert [[names[k] for k in own] for own in found] == want
    monkeypatch.setattr(pretokens, "pieces", lambda text: 1 / 0)  # not one by one
    assert ["".join(map(chr, x)) for x in pretokens.Pieces(characters, {})(texts)] == texts


def test_other_texts_beside_latin_ones_keep_their_places():
    texts = ["one two", "αβ it's", "", "a\0b \0", "x<end>y", "caf\xe9  it's"]
    pieces = pretokens.Pieces(characters, {"<end>": 7})
    assert ["".join(map(chr, x)) for x in pieces(texts)] == [t.replace("<end>", "\x07") for t in texts]
