"""Text-cleaning rules and the six source profiles.

A rule is a pattern, a replacement and the needles without one of which the
pattern cannot match: a byte search for them guards the pattern, so most texts
skip most patterns. Everything runs in the JVM except HTML unescaping, an Arrow
UDF that, in ``clean_column``, only sees texts with an ampersand.

All patterns run with ``(?U)``. Java's own ``\\w``, ``\\s`` and ``.`` still differ
from the wanted meaning for combining marks, joiners, control separators and
Unicode line ends, so the patterns use the classes below and ``(?d)``.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class Replace:
    """Replace a pattern; ``needles`` are texts or UTF-8 prefixes any match contains."""

    pattern: str
    replacement: str = ""
    needles: tuple[str | bytes, ...] = ()

    def __call__(self, c: Column) -> Column:
        if not self.needles:
            return self._replaced(c)
        # The lambda binds the text, so it is computed once however often it is named.
        return F.get(F.transform(F.array(c), self._guarded), F.lit(0))

    def _replaced(self, c: Column) -> Column:
        return F.regexp_replace(c, f"(?U){self.pattern}", self.replacement)

    def _guarded(self, c: Column) -> Column:
        found = [
            F.contains(c.cast("binary") if isinstance(n, bytes) else c, F.lit(n))
            for n in self.needles
        ]
        return F.when(reduce(lambda a, b: a | b, found), self._replaced(c)).otherwise(c)


# Character classes, to be read with (?U).
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARS = r"\s\x1c-\x1f"
SPACE = f"[{SPACE_CHARS}]"
NONSPACE = f"[^{SPACE_CHARS}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Code points with the Unicode Emoji property, without the
# digits, '#' and '*' (only their keycap sequences are emoji) and without the
# regional indicators (only pairs of them are emoji).
EMOJI_POINTS = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3
23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618
261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660
2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7
26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA
26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728
2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF
2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF
1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A
1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570
1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2
1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC
1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF
1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""


def _emoji_class() -> str:
    spans = (point.split("-") for point in EMOJI_POINTS.split())
    return "[" + "".join("-".join(f"\\x{{{p}}}" for p in span) for span in spans) + "]"


EMOJI = (
    r"(?=[#*0123456789\xa9\xae\x{203C}-\x{1FAFF}])(?:"
    r"[0-9#*]\x{FE0F}?\x{20E3}"
    r"|[\x{1F1E6}-\x{1F1FF}]{2}"
    r"|\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
    rf"|{_emoji_class()}[\x{{FE0E}}\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*\x{{200D}}?"
    r"|[\x{FE0E}\x{FE0F}])"
)


# ---- single rules ---------------------------------------------------------

# The emoji needles are UTF-8 prefixes. The class also covers the four
# pictographs and the variation selector one profile names on top of the emoji.
remove_emoji = Replace(
    EMOJI, "", (b"\xf0\x9f", b"\xe2", b"\xef\xb8", b"\xc2\xa9", b"\xc2\xae", b"\xe3\x80", b"\xe3\x8a")
)
breaks_to_space = Replace(rf"(?i)<br{SPACE}*/?>|&nbsp;", " ", ("<", "&"))
fence_to_token = Replace(r"(?s)```.*?```", " <CODE> ", ("```",))
unwrap_markdown = Replace(
    r"(?d)(?=[*_~`])(\*\*|\*|__|_|~~|`)(.*?)\1", "$2", ("*", "_", "~~", "`")
)
strip_emphasis = Replace(r"[*_]{1,3}", "", ("*", "_"))
strip_headings = Replace(rf"(?md)^#{{1,6}}{SPACE}+", "", ("#",))
squeeze_punctuation = Replace(rf"([^\p{{L}}\p{{N}}_{SPACE_CHARS}])\1{{2,}}", "$1")
unwrap_double_quotes = Replace(r'("{2,})([^"]+?)\1', "$2", ('""',))
_MD_LINK = rf"\[([^\]]+?)\]\((?:https?://|mailto:)[^{SPACE_CHARS})]+\)"
link_to_label = Replace(_MD_LINK, "$1", ("](",))
drop_links = Replace(_MD_LINK, "", ("](",))
drop_mentions = Replace(f"@{WORD}+", "", ("@",))
drop_bracketed = Replace(r"(?d)(?=[\[(])(?:\[.*?\]|\(.*?\))", "", ("[", "("))

_URL = rf"https?://{NONSPACE}+|www\.{NONSPACE}+"
_SPACED_URL = rf"https?://{SPACE}*{NONSPACE}*"
_SPACED_URL_OR_WWW = rf"(?:https?://|www\.){SPACE}*{NONSPACE}*"


def mask_urls(token: str) -> Replace:
    return Replace(_URL, token, ("://", "www."))


def mask_spaced_urls(token: str) -> Replace:
    """Also takes an address that is split from its scheme by white space."""
    return Replace(_SPACED_URL, token, ("://",))


def mask_spaced_urls_or_www(token: str) -> Replace:
    return Replace(_SPACED_URL_OR_WWW, token, ("://", "www."))


def zero_width_to(token: str) -> Replace:
    return Replace(r"[\x{200B}-\x{200D}\x{2060}]", token, ("\u200b", "\u200c", "\u200d", "\u2060"))


def hashtags_to(token: str) -> Replace:
    return Replace(f"#{SPACE}*(?={WORD})", token, ("#",))


def uppercase_cves(max_digits: int | None = None) -> Replace:
    """Upper-case vulnerability ids that stand alone as a word."""
    tail = r"\p{Nd}{4,}" if max_digits is None else rf"\p{{Nd}}{{4,{max_digits}}}"
    # The word boundary is checked behind the first letter, which most positions fail.
    pattern = rf"[cC](?<!{WORD}[cC])[vV][eE]-(\p{{Nd}}{{4}}-{tail})(?!{WORD})"
    return Replace(pattern, "CVE-$1")


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


# A run of white space other than one blank; single blanks are not touched.
_squeeze_space = Replace(rf" {SPACE}+|[{SPACE_CHARS}&&[^ ]]{SPACE}*", " ")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(_squeeze_space(c))


def strip_quote_marks(c: Column) -> Column:
    """Drop a leading run of ``>`` and blanks; the text is one line here."""
    return F.btrim(F.ltrim(c, F.lit("> ")))


def placeholder_to_null(c: Column) -> Column:
    return F.when(~c.isin("", "..."), c)


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Bytes of text that a task unescapes at a time, whatever the rows of a batch hold.
SLICE_BYTES = 2_000_000


def _slices(cells: pa.Array, texts: pa.Array, ends: np.ndarray) -> Iterator[pa.Array]:
    """``cells`` in slices of about ``SLICE_BYTES``, one cell at least; cell i has the texts before ``ends[i]``."""
    if len(cells) == 0:
        return
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))])
    before = sizes[np.concatenate([[0], ends[:-1]])]
    starts = np.flatnonzero(np.diff(before // SLICE_BYTES, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(cells)], strict=True):
        yield cells.slice(a, b - a)


@F.arrow_udf(T.StringType())
def unescape_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for part in _slices(texts, texts, np.arange(1, len(texts) + 1)):
            yield pa.array([t if t is None else html.unescape(t) for t in part.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape_html_items(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))
        for part in _slices(lists, lists.flatten(), ends):
            yield pa.array(
                [
                    items if items is None else [t if t is None else html.unescape(t) for t in items]
                    for items in part.to_pylist()
                ],
                pa.list_(pa.string()),
            )


# ---- profiles -------------------------------------------------------------

# name: (rules before HTML unescaping, unescapes HTML, rules after it)
PROFILES: dict[str, tuple[list[Rule], bool, list[Rule]]] = {
    "reddit": (
        [placeholder_to_null, link_to_label, mask_urls(" <URL> "), uppercase_cves()],
        True,
        [
            fence_to_token,
            unwrap_markdown,
            strip_headings,
            squeeze_punctuation,
            remove_emoji,
            collapse_whitespace,
            strip_quote_marks,
        ],
    ),
    "mastodon": (
        [uppercase_cves()],
        True,
        [
            fence_to_token,
            unwrap_markdown,
            strip_headings,
            squeeze_punctuation,
            remove_emoji,
            mask_spaced_urls("<URL>"),
            zero_width_to("<URL>"),
            mask_urls("<URL>"),
            hashtags_to(","),
            drop_mentions,
            drop_links,
            collapse_whitespace,
        ],
    ),
    "exploitdb": (
        [null_to_empty, uppercase_cves()],
        True,
        [
            breaks_to_space,
            zero_width_to(""),
            fence_to_token,
            unwrap_markdown,
            strip_headings,
            squeeze_punctuation,
            unwrap_double_quotes,
            remove_emoji,
            trim_space,
            mask_spaced_urls_or_www(" <URL> "),
            hashtags_to(""),
            drop_mentions,
            drop_links,
            collapse_whitespace,
        ],
    ),
    "telegram": (
        [
            mask_urls(""),
            remove_emoji,
            drop_mentions,
            drop_bracketed,
            strip_emphasis,
            collapse_whitespace,
        ],
        False,
        [],
    ),
    "second_pass": (
        [
            mask_urls(" <URL>"),
            remove_emoji,
            drop_mentions,
            drop_bracketed,
            strip_emphasis,
            collapse_whitespace,
        ],
        False,
        [],
    ),
    "unified": (
        [uppercase_cves(max_digits=7)],
        True,
        [
            fence_to_token,
            strip_headings,
            squeeze_punctuation,
            mask_spaced_urls("<URL>"),
            mask_urls("<URL>"),
            zero_width_to(""),
            remove_emoji,
            hashtags_to(","),
            drop_mentions,
            drop_links,
            strip_emphasis,
            collapse_whitespace,
        ],
    ),
}


def _profile(name: str) -> tuple[list[Rule], bool, list[Rule]]:
    if name not in PROFILES:
        raise ValueError(f"unknown cleaning profile {name!r}; known: {sorted(PROFILES)}")
    return PROFILES[name]


def _apply(rules: list[Rule], c: Column) -> Column:
    return reduce(lambda value, rule: rule(value), rules, c)


def clean_text(c: Column, profile: str) -> Column:
    """A whole profile as one expression; ``clean_column`` is the faster form."""
    before, unescapes, after = _profile(profile)
    c = _apply(before, c)
    return _apply(after, unescape_html(c)) if unescapes else _apply(after, c)


def clean_column(df: DataFrame, column: str, profile: str, out: str | None = None) -> DataFrame:
    """Clean ``column`` by a profile; only texts with ``&`` pass through Python."""
    out = out or column
    before, unescapes, after = _profile(profile)
    first = _apply(before, F.col(column))
    if not unescapes:
        return df.withColumn(out, _apply(after, first))
    staged = df.withColumn("__staged", first)
    escaped = F.when(F.contains("__staged", F.lit("&")), F.col("__staged"))
    staged = staged.withColumn("__plain", unescape_html(escaped))
    text = _apply(after, F.coalesce("__plain", "__staged"))
    return staged.withColumn(out, text).drop("__staged", "__plain")


def clean_items(df: DataFrame, items: str, profile: str, out: str) -> DataFrame:
    """Clean every string of an array column, in place and without a shuffle."""
    before, unescapes, after = _profile(profile)
    staged = df.withColumn("__staged", F.transform(items, lambda t: _apply(before, t)))
    if unescapes:
        has_entity = F.exists("__staged", lambda t: F.contains(t, F.lit("&")))
        staged = staged.withColumn(
            "__plain", _unescape_html_items(F.when(has_entity, F.col("__staged")))
        )
        source = F.coalesce("__plain", "__staged")
    else:
        staged = staged.withColumn("__plain", F.lit(None))
        source = F.col("__staged")
    return staged.withColumn(out, F.transform(source, lambda t: _apply(after, t))).drop(
        "__staged", "__plain"
    )
