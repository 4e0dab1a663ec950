"""Merges side by side against merges one by one, and the cache they fill."""

import pickle
import random

import numpy as np
import pytest

from braidseq.llm import sentencepiece_scan as sp
from braidseq.llm.labelled import Lookup


@pytest.fixture(scope="module")
def coder():
    with open(sp.MODEL, "rb") as f:
        return sp.Coder(sp.Pieces.read(f.read()))


def test_side_by_side(coder):
    draw = random.Random(4)
    letters = "etaoinshrdlu" * 4 + "xqz0123456789.,-\"'\n\téü中م\U0001f600\x00\x7f"
    units = {sp.MARK * draw.choice([0, 1, 1, 1, 3]) + "".join(draw.choices(letters, k=draw.choice([1, 2, 5, 6, 7, 9, 10, 18, 19, 48, 49, 90]))) for _ in range(4000)}
    got = coder.merger.all(sorted(units), coder.pieces.merged)
    assert set(got) == units
    for u in units:
        assert got[u] == coder.one(u), u
    assert coder.merger.all([], coder.pieces.merged) == {}


def test_equal_scores_merge_from_the_left(coder):
    for u in ("aaaaaaaaaaa", "----------------", "0000000", sp.MARK * 9, "abababab"):
        assert coder.merger.all([u], coder.pieces.merged)[u] == coder.one(u)


def test_units():
    for text in ("", "a", " a", "a ", "a  b", "  ", "a b c", "a\nb c\td", " a  b "):
        marked = sp.MARK + text.replace(" ", sp.MARK)
        assert sp.units_of(marked) == sp.UNIT.findall(marked)


def test_kept_from_batch_to_batch(coder):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    c = pickle.loads(pickle.dumps(coder))
    c.unit.most, draw = 100, random.Random(5)
    for _ in range(20):
        texts = ["", *(" ".join("".join(draw.choices("abcdeфж", k=draw.randint(1, 9))) for _ in range(40)) for _ in range(5))]
        got = c.ids([sp.MARK + t.replace(" ", sp.MARK) if t else "" for t in texts])
        assert [list(g) for g in got] == [library.encode(t) for t in texts]
        assert all(np.dtype("<i4") == g.dtype for g in got)


def test_lookup_forgets_only_to_find_again():
    asked = []
    kept = Lookup(lambda w: asked.append(w) or w * 2, 10)
    kept.keep({"a": "aa", "b": "bb"})
    assert kept.holds("a") and not kept.holds("c") and kept["a"] == "aa" and not asked
    kept.keep({c: c * 2 for c in "cdef"})
    assert kept.holds("a") and kept["a"] == "aa" and kept["z"] == "zz" and asked == ["z"]
