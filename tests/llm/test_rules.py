"""Quality rules: statistics and the list against plain Python."""

import random
import re
import zlib

import pytest

from cvebeacon.llm import rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    """The statistics of the base rules, word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


def texts(seed=4):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    junk = [lambda w: w + draw.choice(["###", "$$$"]), lambda w: w.upper() + "!!", lambda w: w + " |"]
    found = []
    for i in range(700):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(0, 120))]
        bad = i % 4 == 0
        if bad:
            words = [junk[i % 3](w) for w in words]
        if i % 9 == 0 and words:
            words += words[: draw.randrange(1, 30)]
        gaps = [draw.choice([" ", "  ", "\n", "\t", "\x0b", " \n"]) for _ in words]
        found.append((i, "".join(w + g for w, g in zip(words, gaps, strict=True)), int(not bad)))
    return found


ODD = [
    None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b c d e a b c d e f", "x\n\nx\n \nx\r\nx",
    "no break is one word   and \x1c this", "\U0001f525 <b>#1</b> 100% & $5|6 *",
    "one two three four five six seven eight nine ten eleven", "w " * 3000, "é" * 500,
]


def test_statistics_against_plain_python(spark):
    rows = [(i, t) for i, t, _ in texts()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in R.quality_rules(df, marks).collect()}
    for i, t in rows:
        want = plain(t)
        assert {k: got[i][k] for k in want} == want, t
        assert got[i]["kept"] == (not want["base_failed"]) and got[i]["rule"] == 0


def test_learned_list(spark):
    rows = texts()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = R.quality_rules(docs, marks).toPandas().set_index("doc_id")
    truth = {i: q for i, _, q in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(got.index[got.held_out]) == held
    judged = [i for i in held if not got.base_failed[i]]
    right = sum(got.kept[i] == truth[i] for i in judged) / len(judged)
    assert right > 0.95 and got.rule.max() >= 1
    # The numbered rule is the first of the list that the statistics satisfy.
    stats = R.statistics(docs).toPandas().set_index("doc_id")
    listed = got[got.rule > 0].groupby("rule").rule_text.first().to_dict()

    def holds(i, rule):
        parts = (c.split() for c in rule.split(" and "))
        return all((stats[n][i] >= float(x)) if op == ">=" else (stats[n][i] < float(x)) for n, op, x in parts)

    for i in got.index:
        first = next((k for k in sorted(listed) if holds(i, listed[k])), 0)
        near = any(
            abs(stats[n][i] - float(x)) < 1e-4 for r in listed.values() for n, _, x in (c.split() for c in r.split(" and "))
        )
        assert near or got.rule[i] == first
        assert got.kept[i] == (not got.base_failed[i] and got.rule[i] == 0)


def test_best_condition_by_enumeration():
    """The gain of every limit, tried one by one."""
    import math

    limits = {"n_words": [1.0, 2.0, 3.0]}
    counts = {("n_words", 0): (1, 9), ("n_words", 1): (2, 3), ("n_words", 2): (6, 1), ("n_words", 3): (4, 0)}
    gain, wrong, (name, above, k) = R._best(counts, limits)
    tried = {}
    p, q = [1, 2, 6, 4], [9, 3, 1, 0]
    for cut in (1, 2, 3):
        for up in (True, False):
            a, b = (sum(p[cut:]), sum(q[cut:])) if up else (sum(p[:cut]), sum(q[:cut]))
            tried[up, cut] = a * (math.log2(a / (a + b)) - math.log2(13 / 26))
    assert max(tried, key=tried.get) == (above, k) and abs(gain - tried[above, k]) < 1e-12
    assert wrong == 1 and name == "n_words"


def test_odd_tables(odd, none, marks):
    got = R.quality_rules(odd, marks).collect()
    want = sorted(((r["doc_id"] or 0, plain(r["text"])["n_words"]) for r in odd.collect()))
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in got) == want
    for r in got:
        assert r["kept"] in (True, False) and r["base_failed"] in (True, False)
        if r["n_words"] < 10:
            assert r["base_failed"] and not r["kept"]
    assert R.quality_rules(none, marks).collect() == []
    assert len(R.quality_rules(odd, marks.limit(0)).collect()) == len(got)


@pytest.mark.parametrize("kind", [0, 1])
def test_one_kind_of_label(spark, kind):
    """Labels of one kind, or that contradict one another, teach nothing."""
    docs = spark.createDataFrame([(i, "plain words " * i) for i in range(40)], "doc_id long, text string")
    rows = [(i, kind) for i in range(40)] + ([(i, 0) for i in range(40)] if kind else [])
    marks = spark.createDataFrame(rows, "doc_id long, quality int")
    got = R.quality_rules(docs, marks).collect()
    assert len(got) == 40
    if kind:
        assert all(r["rule"] == 0 for r in got)
