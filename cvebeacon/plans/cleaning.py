"""Queries: the cleaning rules and profiles over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cvebeacon.functions import text as X
from cvebeacon.operators.unify import clean_comments, clean_posts, drop_blank_comments
from cvebeacon.plans import views as V
from cvebeacon.plans.registry import query

# ---- the rules restated for an engine without back-references ---------------

_S = r"[\s\p{Z}]"
_NS = r"[^\s\p{Z}]"
_W = r"[\p{L}\p{N}_]"
_MARKS = r"""!"#$%&'()*+,-./:;<=>?@[\]^`{|}~"""
_LINK = r"\[([^\]]+?)\]\(((?:https?://|mailto:)[^\s\p{Z})]+)\)"
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{FE0F}]"


def _sub(pattern: str, new: str):
    quoted = pattern.replace("'", "''")
    return lambda t: f"regexp_replace({t}, '{quoted}', '{new}', 'g')"


def _unescape(t: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"),
                          ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{plain}')"
    return t


def _unwrap(t: str) -> str:
    pattern = r"\*\*(.*?)\*\*|\*(.*?)\*|__(.*?)__|_(.*?)_|~~(.*?)~~|`(.*?)`"
    return _sub(pattern, r"\1\2\3\4\5\6")(t)


def _squeeze(t: str) -> str:
    for mark in _MARKS:
        plain = {"\\": r"\\", "'": "''"}.get(mark, mark)
        t = _sub(rf"\x{ord(mark):02x}{{3,}}", plain)(t)
    return t


def _trim(t: str) -> str:
    return f"trim({_sub(_S + '+', ' ')(t)}, ' ')"


def _quote_marks(t: str) -> str:
    return f"trim(regexp_replace({t}, '^[> ]+', ''), ' ')"


_UPPER = _sub(r"(?i)\bcve-(\d{4}-\d{4,})\b", r"CVE-\1")
_UPPER7 = _sub(r"(?i)\bcve-(\d{4}-\d{4,7})\b", r"CVE-\1")
_FENCE = _sub(r"(?s)```.*?```", " <CODE> ")
_HEADING = _sub(rf"(?m)^#{{1,6}}{_S}+", "")
_NO_EMOJI = _sub(_EMOJI, "")
_NO_MENTION = _sub(f"@{_W}+", "")
_NO_LINK = _sub(_LINK, "")
_NO_BRACKET = _sub(r"\[.*?\]|\(.*?\)", "")
_NO_STARS = _sub(r"[*_]{1,3}", "")
_URLS = rf"https?://{_NS}+|www\.{_NS}+"
_SPACED = rf"https?://{_S}*{_NS}*"
_ZERO = r"[\x{200B}-\x{200D}\x{2060}]"
_TAG = rf"#{_S}*({_W})"

_STEPS = {
    "reddit": [
        _sub(_LINK, r"\1"), _sub(_URLS, " <URL> "), _UPPER, _unescape, _FENCE, _unwrap, _HEADING,
        _squeeze, _NO_EMOJI, _trim, _quote_marks,
    ],
    "mastodon": [
        _UPPER, _unescape, _FENCE, _unwrap, _HEADING, _squeeze, _NO_EMOJI, _sub(_SPACED, "<URL>"),
        _sub(_ZERO, "<URL>"), _sub(_URLS, "<URL>"), _sub(_TAG, r",\1"), _NO_MENTION, _NO_LINK, _trim,
    ],
    "exploitdb": [
        _UPPER, _unescape, _sub(r"(?i)<br\s*/?>|&nbsp;", " "), _sub(_ZERO, ""), _FENCE, _unwrap,
        _HEADING, _squeeze, _sub(r'""+([^"]+?)""+', r"\1"), _NO_EMOJI, _trim,
        _sub(rf"(?:https?://|www\.){_S}*{_NS}*", " <URL> "), _sub(_TAG, r"\1"), _NO_MENTION, _NO_LINK,
        _trim,
    ],
    "telegram": [_sub(_URLS, ""), _NO_EMOJI, _NO_MENTION, _NO_BRACKET, _NO_STARS, _trim],
    "second_pass": [_sub(_URLS, " <URL>"), _NO_EMOJI, _NO_MENTION, _NO_BRACKET, _NO_STARS, _trim],
    "unified": [
        _UPPER7, _unescape, _FENCE, _HEADING, _squeeze, _sub(_SPACED, "<URL>"), _sub(_URLS, "<URL>"),
        _sub(_ZERO, ""), _NO_EMOJI, _sub(_TAG, r",\1"), _NO_MENTION, _NO_LINK, _NO_STARS, _trim,
    ],
}


def restated(column: str, profile: str) -> str:
    for step in _STEPS[profile]:
        column = step(column)
    return column


def _profile_query(profile: str) -> None:
    @query(
        f"clean_{profile}",
        V.with_views("posts", f"select doc_id, {restated('text', profile)} as clean_text from posts"),
    )
    def run(spark, sf_dir):
        cleaned = X.clean_column(V.post_texts(spark, sf_dir), "text", profile, "clean_text")
        return cleaned.select("doc_id", "clean_text")


for _name in X.PROFILES:
    _profile_query(_name)


@query(
    "html_unescape",
    "select page_id, "
    + _unescape("regexp_replace(regexp_replace(html, '&amp;?', '&amp;', 'g'), '&quot;?', '&quot;', 'g')")
    + " as text from pages",
)
def html_unescape(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return pages.select("page_id", X.unescape_html(F.col("html")).alias("text"))


_COMMENT = "text || ' *noted* &amp; https://ex.test/c'"
_BLANKED = f"case when turn % 5 = 4 then ' ' when turn % 7 = 6 then '...' else {_COMMENT} end"


@query(
    "comment_levels",
    f"""select conv_id, turn, case when turn % 3 = 2 then c else 'Level ' || turn || ': ' || c end as comment
from (select conv_id, turn, {restated('t', 'reddit')} as c
      from (select conv_id, turn, {_BLANKED} as t from conversations)
      where t <> '...') where c <> ''""",
)
def comment_levels(spark, sf_dir):
    comment = F.struct(
        F.lit(1).alias("score"),
        F.expr(_BLANKED).alias("text"),
        F.expr("case when turn % 3 <> 2 then cast(turn as int) end").alias("level"),
    )
    rows = V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array(comment).alias("comments")
    )
    rows = rows.withColumn("comments", drop_blank_comments(F.col("comments")))
    cleaned = clean_comments(rows)
    return cleaned.select("conv_id", "turn", F.explode("clean_comments").alias("comment"))


@query(
    "clean_posts",
    V.with_views(
        "posts",
        f"""select doc_id, permalink,
  trim(concat_ws(' ', nullif(trim(title), ''), nullif({restated('text', 'reddit')}, ''),
  nullif({restated('article_text', 'reddit')}, '')), ' ') as clean_text,
  'Level 0: first note on ' || split_part(permalink, '/', 3) as clean_comments from posts""",
    ),
)
def clean_posts_query(spark, sf_dir):
    cleaned = clean_posts(V.posts(spark, sf_dir))
    return cleaned.select(
        "doc_id", "permalink", "clean_text", F.array_join("clean_comments", "|").alias("clean_comments")
    )
