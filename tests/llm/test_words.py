import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import words as w

TEXT = st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x0c\r\x1fÉ漢🎉A", max_size=40))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_match_the_pattern(texts):
    found = []
    for _, _, part in w.words(pa.array(texts, pa.string())):
        for low, high in zip(part.first[:-1], part.first[1:], strict=True):
            found.append([bytes(part.data[a:b]).decode() for a, b in zip(part.start[low:high], part.end[low:high], strict=True)])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (_, _, part), = w.words(pa.array(["Cat dog", "x" * 50 + " dog cat"]), fold=True)
    assert part.hash[0] == part.hash[4] and part.hash[1] == part.hash[3] and len(set(part.hash.tolist())) == 3


def test_a_word_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(w, "BLOCK", 64)
    w._tables.clear()
    texts = ["y" * 200 + " z", "z " + "y" * 200]
    hashes = np.concatenate([part.hash for _, _, part in w.words(pa.array(texts))])
    w._tables.clear()
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2]


def test_short_texts_are_one_shingle():
    (_, _, part), = w.words(pa.array(["a b", "", "a b c d e f", "a b"]))
    sets = list(w.shingle_sets(part))
    assert [len(s) for s in sets] == [1, 0, 2, 1] and sets[0][0] == sets[3][0]


def test_routes_name_one_leader_per_key():
    key = np.array([5, 7, 5, 5, 9], np.uint64)
    got = w.routes(key, np.arange(5))
    assert got[0] == 1 and got[1] == 0 and got[4] == 0 and (got[[2, 3]] >= 2).all()
