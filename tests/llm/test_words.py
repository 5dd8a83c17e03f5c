"""Words, their hashes and classes against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cvebeacon.llm import quality, words

TEXTS = ["", None, "  a B\tc ", "ÀÉ\x0bx\x1cy z q", "\n\n", "x" * 70_000 + " É é", " ", "b B b"]


@pytest.mark.parametrize("texts", [TEXTS, [], [None], [""]])
def test_word_hashes_follow_the_plain_split(texts):
    split = [t.encode().lower().split() if t else [] for t in texts]
    flat, counts = words.word_hashes(texts)
    assert flat.tolist() == [xxhash.xxh3_64_intdigest(w) for own in split for w in own]
    assert counts.tolist() == [len(own) for own in split]


@pytest.mark.parametrize("skipped", [0, 2, 5])
def test_codes_tell_words_apart(skipped):
    texts = [*TEXTS, "c" * 300 + " " + "C" * 300, "a\nB\n", "aa a b ab ba " * 9_000, "d" * 256, "d" * 257][skipped:]
    data, offsets = words.utf8(pa.array([None] * 3 + texts, pa.string()).slice(3))
    starts, ends = words.spans(data, offsets)
    split = [w for t in texts if t for w in t.encode().lower().split()]
    assert [data[a:b].tobytes().lower() for a, b in zip(starts, ends, strict=True)] == split
    found = words.codes(data, starts, ends).tolist()
    assert len(set(found)) == len(set(split)) == len(set(zip(found, split, strict=True)))


def test_classes_do_not_depend_on_the_texts_before():
    together, counts = quality.classes(TEXTS)
    alone = [quality.classes([t])[0] for t in TEXTS]
    assert counts.tolist() == [len(a) for a in alone]
    assert np.array_equal(together, np.concatenate(alone))
    assert together.max() < quality.CLASSES


def test_a_repeated_word_is_marked():
    found, _ = quality.classes(["go go! go! stop", "stop"])
    assert (found >> 13).tolist() == [0, 0, 1, 0, 0]
