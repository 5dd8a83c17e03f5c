"""The trie of conversations against plain Python, and the parentheses against a stack."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cvebeacon.llm.conversation_trie import Trie, prefix_trie
from cvebeacon.llm.parentheses import Parentheses

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, part string, o string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(parts)


def plain(rows):
    """All nodes, sequence by sequence."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found.setdefault(conv, []).append((turn is not None, turn or 0, tie, role, text))
    original = {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}
    rebuilt = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(original.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    own = {k: (len(v) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1] if k else "")) for k, v in members.items()}
    children = {}
    for k in members:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, saved = {}, {}
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
            saved[k[:d]] = saved.get(k[:d], 0) + own[k]
    result = []
    for k, v in members.items():
        ends = ",".join(str(c) for c in sorted(v) if len(rebuilt[c]) == len(k))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        parent = min(members[k[:-1]]) if k else None
        result.append((min(v), len(k), parent, len(v), children.get(k, 0), leaves[k], saved[k], digest))
    return sorted(result)


def check(spark, rows, how=Trie()):
    got = prefix_trie(frame(spark, rows), how).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def conversations(seed, convs, longest, words):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(draw.randrange(1, longest + 1)):
            text = draw.choice(words) if draw.random() < 0.9 else f"own {c} {turn}"
            rows.append((c * draw.choice([1, 1, 1, 3]), turn, "user" if turn % 2 else "bot", text))
    return rows


SMALL = Trie(rows=9, chains=4)


@pytest.mark.parametrize("how", [Trie(), SMALL])
def test_shared_beginnings(spark, how):
    """Few texts, so that beginnings and whole conversations are shared and paths branch."""
    check(spark, conversations(1, 90, 7, ["a", "b c"]), how)


def test_one_beginning_and_copies(spark):
    """A third of all conversations alike, another third with one first turn."""
    rows = []
    for c in range(150):
        kind = c % 3
        turns = [("u", "hello there"), ("a", "same"), ("u", "x y z")] if kind == 0 else [("u", "hello there"), ("a", f"r {c}")]
        if kind == 2:
            turns = [("u", f"alone {c}")]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    check(spark, rows, SMALL)


def test_long_conversation(spark):
    """Two copies of one long conversation spread over pieces, and branches along it."""
    long = [("u", f"turn number {i}") for i in range(400)]
    rows = [(c, i, *t) for c in (40, 60) for i, t in enumerate(long)]
    rows += [(100 + c, i, *t) for c in range(0, 60, 20) for i, t in enumerate(long[: 100 + c])]
    rows += [(200 + c, i, "u", "w " * c) for c in range(12) for i in range(c % 3 + 1)]
    check(spark, rows, Trie(rows=37, chains=3))


def test_odd_conversations(spark):
    rows = [
        (None, 0, "u", "lost"), (20, None, "u", "first"), (20, None, "u", "first"), (20, 1, None, None), (20, 1, "", ""),
        (21, 5, "u", "tie"), (21, 5, "u", "other"), (21, 5, "u", "other"), (22, 0, "u", ""), (23, 0, "ab", "c"),
        (24, 0, "a", "bc"), (25, 0, "a", "bc"), (-3, 0, "u", "minus"), (-40, 0, "u", "minus"), (-41, 0, "u", "minus"),
        (26, -9, "u", "é \t\x0b à"), (27, 0, "u", "v " * 50_000), (28, 0, "u", "v " * 50_000), (2**62, 1, "u", "big"),
    ]
    check(spark, rows)
    check(spark, rows, SMALL)


def test_only_the_root(spark):
    """Conversations whose only turns are replaced by those of an absent one are turnless."""
    turnless = [c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    check(spark, [(c, 0, "u", "gone") for c in turnless if c > 20], SMALL)
    assert prefix_trie(frame(spark, [(None, 1, "u", "x")])).collect() == []
    assert prefix_trie(frame(spark, [(1, 1, "u", "x")]).limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.randoms(use_true_random=False))
def test_find_close(shape, draw):
    """Random trees: open several, close some, close the rest at the end."""
    bits, depth = [], 0
    for k in shape:
        bits += [1] * k
        depth += k
        close = draw.randrange(depth + 1)
        bits += [0] * close
        depth -= close
    bits += [0] * depth
    tree = Parentheses(np.array(bits, np.int8))
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    at = np.array(sorted(want), np.int64)
    assert tree.find_close(at).tolist() == [want[i] for i in at.tolist()]
    assert tree.rank_open(at).tolist() == [sum(bits[:i]) for i in at.tolist()]


def test_find_close_far():
    deep = np.array([1] * 5000 + [1, 0] * 3000 + [0] * 5000, np.int8)
    tree = Parentheses(deep)
    assert tree.find_close(np.arange(5000)).tolist() == list(range(15_999, 10_999, -1))
