"""Word hashes: equal for equal stretches, different for strings that collide under simpler hashes."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rallyline.llm import exact, near, rules
from rallyline.llm.text import Block

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


FIRST = thue_morse(1024)
SECOND = FIRST.translate(str.maketrans("ab", "ba"))


def test_words_share_a_hash_only_if_equal():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("ab\0é\U0001f600", k=rng.randint(1, 40))) for _ in range(200)) for _ in range(20)]
    texts += [None, "", FIRST, SECOND, "a a\0 a\0\0", "x" * 15 + " " + "x" * 16 + " " + "x" * 17 + " " + "x" * 32 + " " + "x" * 33]
    block = Block(pa.array(texts))
    words = [w for t in texts for w in WORD.findall(t or "")]
    hashes = block.word_hashes()
    assert len(words) == len(hashes)
    by_word = dict(zip(words, map(tuple, hashes.tolist()), strict=True))
    assert all(by_word[w] == tuple(h) for w, h in zip(words, hashes.tolist(), strict=True))
    for column in (0, 1):
        assert len({h[column] for h in by_word.values()}) == len(by_word)


def test_lower_case_and_offsets_do_not_matter():
    array = pa.array(["skip me", None, "One two", "one TWO"])
    block = Block(array[1:], lower=True)
    found = block.word_hashes()
    assert np.array_equal(found[:2], found[2:]) and len(found) == 4


@pytest.mark.parametrize("length", [0, 5])
def test_texts_of_colliding_strings_are_different(table_of, length):
    """Whole documents that differ in the colliding word only."""
    around = " ".join(f"w{i}" for i in range(length))
    docs = table_of([(1, f"{around} {FIRST}"), (2, f"{around} {SECOND}"), (3, f"{around} {FIRST}")])
    found = {r["doc_id"]: (r["class_id"], r["copies"]) for r in near.join(docs).collect()}
    assert found == {1: (1, 2), 2: (2, 1), 3: (1, 2)}
    assert {r["doc_id"] for r in near.keep_one(docs).collect()} == {1, 2}
    assert {r["doc_id"]: r["keep_id"] for r in exact.groups(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_lines_of_colliding_strings_are_different(table_of):
    found = rules.judge(table_of([(1, f"{FIRST}\n{SECOND}"), (2, f"{FIRST}\n{FIRST}")])).collect()
    assert {r["doc_id"]: r["n_dup_lines"] for r in found} == {1: 0, 2: 1}
