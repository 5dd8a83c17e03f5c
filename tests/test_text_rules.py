"""Cleaning rules against an independent restatement with Python's own ``re``."""

import html
import random
import re

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cvebeacon.functions import text as X

URL = r"(?:https?://\S+|www\.\S+)"
CVE = r"\b(cve-\d{4}-\d{4,})\b"


def upper(pattern):
    return lambda t: re.sub(pattern, lambda m: m.group(1).upper(), t, flags=re.I)


def sub(pattern, new, flags=0):
    compiled = re.compile(pattern, flags)
    return lambda t: compiled.sub(new, t)


RULES = {
    "breaks_to_space": (X.breaks_to_space, sub(r"(<br\s*/?>|&nbsp;)", " ", re.I)),
    "zero_width": (X.zero_width_to("<URL>"), sub("[​-‍⁠]", "<URL>")),
    "fence": (X.fence_to_token, sub(r"```[\s\S]*?```", " <CODE> ")),
    "unwrap": (X.unwrap_markdown, sub(r"(\*\*|\*|__|_|~~|`)(.*?)\1", r"\2")),
    "emphasis": (X.strip_emphasis, sub(r"[\*_]{1,3}", "")),
    "headings": (X.strip_headings, sub(r"^#{1,6}\s+", "", re.M)),
    "squeeze": (X.squeeze_punctuation, sub(r"([^\w\s])\1{2,}", r"\1")),
    "double_quotes": (X.unwrap_double_quotes, sub(r'("{2,})([^"]+?)\1', r"\2")),
    "link_label": (
        X.link_to_label,
        sub(r"\[([^\]]+?)\]\(((?:https?://|mailto:)[^\s)]+)\)", r"\1"),
    ),
    "link_drop": (X.drop_links, sub(r"\[([^\]]+?)\]\((?:https?://|mailto:)[^\s)]+\)", "")),
    "urls": (X.mask_urls(" <URL> "), sub(URL, " <URL> ")),
    "spaced_urls": (X.mask_spaced_urls("<URL>"), sub(r"https?://\s*\S*", "<URL>")),
    "spaced_www": (
        X.mask_spaced_urls_or_www(" <URL> "),
        sub(r"(?:https?://|http://|www\.)\s*\S*", " <URL> "),
    ),
    "hashtags": (X.hashtags_to(","), sub(r"#\s*(?=\w)", ",")),
    "mentions": (X.drop_mentions, sub(r"@\w+", "")),
    "brackets": (X.drop_bracketed, sub(r"\[.*?\]|\(.*?\)", "")),
    "cve": (X.uppercase_cves(), upper(CVE)),
    "cve7": (X.uppercase_cves(7), upper(r"\b(cve-\d{4}-\d{4,7})\b")),
    "collapse": (X.collapse_whitespace, lambda t: " ".join(t.split())),
    "trim": (X.trim_space, str.strip),
    "quotes": (X.strip_quote_marks, lambda t: t.lstrip("> ").strip(" ")),
    "unescape": (X.unescape_html, html.unescape),
}

ATOMS = """a B é ñ ß _ - . , ! !!! ... --- " "" ' * ** *** __ ~~ ` ``` # ## ### > >> ( ) [ ] ]( @ @user @josé
cve-2024-1234 CVE-2021-123 Cve-2020-1234567 cve-2019-12345678 xcve-2024-1111 cve-2024-1111x http:// https://
https://x.y/z?a=1 www. www.a.b mailto:a@b.c [l](https://x) [m](mailto:q@r) &amp; &lt; &#39; &nbsp; &notit &
<br> <BR/> <br /> 1 ² ½ Ⅷ ٣ ́ 中文""".split() + [
    " ", "  ", "\n", "\r", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "​",
    "‍", "⁠", "　", " ", "﻿",
]


def samples(n, seed=7):
    rng = random.Random(seed)
    fixed = ["", " ", "...", "\n# a\n## b", "a\u0085# x", "**_x_**", "a_b_c", "[a](https://x)", "> q\n> r"]
    return fixed + ["".join(rng.choices(ATOMS, k=rng.randint(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(samples(4000))]
    return spark.createDataFrame(rows, "i INT, t STRING").cache(), [t for _, t in rows]


@pytest.mark.parametrize("name", RULES)
def test_rule_matches_python(texts, name):
    frame, plain = texts
    rule, expected = RULES[name]
    got = {r.i: r.c for r in frame.select("i", rule(F.col("t")).alias("c")).collect()}
    wrong = [(t, expected(t), got[i]) for i, t in enumerate(plain) if expected(t) != got[i]]
    assert not wrong, wrong[:3]


# ---- whole profiles -------------------------------------------------------

MD_LINK = r"\[([^\]]+?)\]\(((?:https?://|mailto:)[^\s)]+)\)"
PICTURE = regex.compile(
    r"[0-9#*]️?⃣|[\U0001F1E6-\U0001F1FF]{2}|\U0001F3F4[\U000E0020-\U000E007E]+\U000E007F"
    r"|(?![0-9#*\U0001F1E6-\U0001F1FF])\p{Emoji}[︎️\U0001F3FB-\U0001F3FF]*‍?|[︎️]"
)


def no_emoji(t):
    return PICTURE.sub("", t)


def chain(*steps):
    def run(t):
        for step in steps:
            t = step(t)
        return t

    return run


FENCE, UNWRAP, HEAD, SQUEEZE = (RULES[k][1] for k in ("fence", "unwrap", "headings", "squeeze"))
MENTION, EMPH, BRACKET = (RULES[k][1] for k in ("mentions", "emphasis", "brackets"))


def squash(t):
    return re.sub(r"\s+", " ", t).strip()


PROFILES = {
    "reddit": chain(
        sub(MD_LINK, r"\1"), sub(URL, " <URL> "), upper(CVE), html.unescape, FENCE, UNWRAP, HEAD,
        SQUEEZE, no_emoji, squash, lambda t: t.lstrip("> ").strip(),
    ),
    "mastodon": chain(
        upper(CVE), html.unescape, FENCE, UNWRAP, HEAD, SQUEEZE, no_emoji,
        sub(r"https?://\s*\S*", "<URL>"), sub("[​‌‍⁠]", "<URL>"),
        sub(r"(?:https?://|www\.)\S+", "<URL>"), sub(r"#\s*(?=\w)", ","), MENTION, sub(MD_LINK, ""), squash,
    ),
    "exploitdb": chain(
        upper(CVE), html.unescape, sub(r"(<br\s*/?>|&nbsp;)", " ", re.I), sub("[​-‍⁠]", ""),
        FENCE, UNWRAP, HEAD, SQUEEZE, sub(r'("{2,})([^"]+?)\1', r"\2"), no_emoji, str.strip,
        sub(r"(?:https?://|http://|www\.)\s*\S*", " <URL> "), sub(r"#\s*(?=\w)", ""), MENTION,
        sub(MD_LINK, ""), squash,
    ),
    "telegram": chain(sub(URL, ""), no_emoji, MENTION, BRACKET, EMPH, squash),
    "second_pass": chain(sub(URL, " <URL>"), no_emoji, MENTION, BRACKET, EMPH, squash),
    "unified": chain(
        upper(r"\b(cve-\d{4}-\d{4,7})\b"), html.unescape, FENCE, HEAD, SQUEEZE,
        sub(r"https?://\s*\S*", "<URL>"), sub(URL, "<URL>"), sub("[​‌‍⁠]", ""),
        no_emoji, sub(r"#\s*(?=\w)", ","), MENTION, sub(MD_LINK, ""), EMPH, lambda t: " ".join(t.split()),
    ),
}
PICTURES = ["\U0001F525", "\U0001F44D\U0001F3FD", "❤️‍\U0001F525", "1️⃣", "#⃣",
            "\U0001F1E7\U0001F1F7", "\U0001F575️", "©", "™", "\U0001F468‍\U0001F469", "️"]


@pytest.mark.parametrize("profile", PROFILES)
def test_profile_matches_python(spark, profile):
    rng = random.Random(11)
    plain = ["".join(rng.choices(ATOMS + PICTURES, k=rng.randint(1, 18))) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(plain)), "i INT, t STRING")
    staged = X.clean_column(frame, "t", profile, "staged")
    both = staged.withColumn("single", X.clean_text(F.col("t"), profile)).collect()
    for row in both:
        if profile == "reddit" and plain[row.i] in ("", "..."):
            assert row.staged is None
            continue
        want = PROFILES[profile](plain[row.i])
        assert row.staged == want, (plain[row.i], want, row.staged)
        assert row.single == want


def test_golden_cases(spark):
    def clean(t, profile):
        frame = spark.createDataFrame([(t,)], "t STRING")
        return X.clean_column(frame, "t", profile).first()[0]

    assert clean("[a](https://x) b", "reddit") == "a b"
    assert clean("[a](https://x) b", "mastodon") == "[a](<URL> b"
    assert clean("[a](mailto:x@y.z) b", "unified") == "b"
    assert clean("a​b", "mastodon") == "a<URL>b"
    assert clean("a​b", "unified") == "ab"
    assert clean("snake_case_id", "unified") == "snakecaseid"
    assert clean(None, "exploitdb") == ""
    assert clean("...", "reddit") is None
    for profile in ("reddit", "mastodon", "telegram", "second_pass", "unified"):
        assert clean(None, profile) is None
    with pytest.raises(ValueError):
        X.clean_text(F.col("t"), "fax")


def test_items_are_cleaned_in_place(spark):
    frame = spark.createDataFrame([(["**a** &amp; b", None, ""],), (None,)], "t ARRAY<STRING>")
    assert X.clean_items(frame, "t", "reddit", "o").collect()[0].o == ["a & b", None, None]
    assert X.clean_items(frame, "t", "telegram", "o").collect()[0].o == ["a &amp; b", None, ""]
    assert X.clean_items(frame, "t", "reddit", "o").collect()[1].o is None


def test_emoji_points_follow_the_unicode_property():
    mine = set()
    for point in X.EMOJI_POINTS.split():
        first, _, last = point.partition("-")
        mine |= set(range(int(first, 16), int(last or first, 16) + 1))
    emoji = regex.compile(r"\p{Emoji}")
    assert all(emoji.match(chr(p)) for p in mine)
    missing = {
        p for p in range(0x20000)
        if not 0xD800 <= p < 0xE000 and emoji.match(chr(p)) and p not in mine
    }
    digits_and_flags = set(map(ord, "#*0123456789")) | set(range(0x1F1E6, 0x1F200))
    # Later Unicode versions may add a few code points to the newest blocks.
    assert {p for p in missing - digits_and_flags if p < 0x1F6D8} == set()


def test_unescaping_holds_a_slice_of_a_batch_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE_BYTES", 1000)
    texts = [None if i % 7 == 0 else "&lt;p&gt; &amp " * (i % 90) for i in range(300)]
    texts[5] = "&eacute" * 700
    wanted = [t if t is None else html.unescape(t) for t in texts]
    parts = list(X.unescape_html.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [t for p in parts for t in p.to_pylist()] == wanted
    assert max(sum(len(t or "") for t in p.to_pylist()) for p in parts if len(p) > 1) < 3000
    lists = [None if i % 11 == 0 else texts[i : i + i % 4] for i in range(300)]
    parts = list(X._unescape_html_items.func(iter([pa.array(lists)])))
    assert len(parts) > 20
    assert [x for p in parts for x in p.to_pylist()] == [x if x is None else wanted[i : i + i % 4] for i, x in enumerate(lists)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["u"] for r in df.select("i", X.unescape_html(F.col("t")).alias("u")).collect()}
    assert got == dict(enumerate(wanted))
