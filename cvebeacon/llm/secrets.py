"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard.

Method: besides the spans of three fixed patterns, runs of key characters with a
sensitive word on either side are candidates; of NAME=value the value is measured
and the name is context. Identifiers are counted over all documents; known are those
met more often outside candidates than in them, and more than once. The most
frequent prime a zstandard dictionary of fixed size, and each candidate has the
known ones that it holds itself in front of its text, however rare. What a
candidate adds to the compressed size of its surrounding text is its novelty: names
and paths that the corpus knows add little, a random string adds nearly its length.
Candidates above a rate are reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm import words
from cvebeacon.llm.common import scratch, small

#: The base patterns, the fewest characters, and the order of kinds.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

#: Shorter values say too little about their rate.
SHORTEST = 8
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)
_SENSITIVE = re.compile(
    r"(?i:key|secret|token|passw|pwd|auth|credential|bearer|private|signature)", re.ASCII
)
_WORDS = ("key", "secret", "token", "passw", "pwd", "auth", "credential", "bearer", "private", "signature")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,39}")


@dataclass(frozen=True)
class Secrets:
    """``rate``: least added bytes for each character; the dictionary has a fixed size."""

    rate: float = 0.7
    near: int = 48
    around: int = 200
    dictionary_bytes: int = 32_768
    level: int = 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _values(run: str) -> Iterator[tuple[int, str]]:
    """(offset, value) of what a run may hold: behind NAME=, pieces of a path without digits."""
    body = run.rstrip("=")
    at = body.find("=")
    while 0 <= at < len(body) and body[at] == "=":
        at += 1
    at = max(at, 0)
    value = run[at:]
    if _MIXED.match(value):
        yield at, value
        return
    for piece in value.split("/"):
        yield at, piece
        at += len(piece) + 1


def candidates(text: str, spans: list[tuple[int, int, str]], how: Secrets) -> list[tuple]:
    """(start, value, text before, text after) of values in a sensitive context, outside spans."""
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    words_at = [m.span() for m in _SENSITIVE.finditer(text)]
    starts = [a for a, _ in words_at]
    found = []
    for m in _RUN.finditer(text):
        # The first word that may be near; most runs have none.
        k = bisect_left(starts, m.start() - how.near)
        if k == len(starts) or starts[k] >= m.end() + how.near:
            continue
        for offset, value in _values(m[0]):
            start = m.start() + offset
            end = start + len(value)
            if len(value) < SHORTEST or any(a < end and start < b for a, b, _ in spans):
                continue
            # A name in the same run is context even if it is longer than ``near``.
            first = min(m.start(), start - how.near)
            for a, b in words_at[bisect_left(starts, first) : bisect_left(starts, end + how.near)]:
                if b <= start or (a >= end and b <= end + how.near):
                    before, after = text[max(0, start - how.around) : start], text[end : end + how.around]
                    found.append((start, value, before, after))
                    break
    return found


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


_FOUND = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.string())),
        ("starts", pa.list_(pa.int64())),
        ("values", pa.list_(pa.string())),
        ("before", pa.list_(pa.string())),
        ("after", pa.list_(pa.string())),
        ("names", pa.list_(pa.string())),
        ("outside", pa.list_(pa.int64())),
        ("inside", pa.list_(pa.int64())),
    ]
)


def _count_names(text: str, found: list[tuple], outside: Counter, inside: Counter) -> None:
    at = 0
    for start, value, *_ in found:
        outside.update(_NAME.findall(text[at:start]))
        inside.update(_NAME.findall(value))
        at = start + len(value)
    outside.update(_NAME.findall(text[at:] if at else text))


def _counts(outside: Counter, inside: Counter) -> pa.RecordBatch:
    """A row of name counts; it is no document and has no row number."""
    names = list(outside | inside)
    values = [None, None, [], [], [], [], [], names, [outside[n] for n in names], [inside[n] for n in names]]
    outside.clear(), inside.clear()
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FOUND, strict=True)], schema=_FOUND)


def _scan(batches: Iterator[pa.RecordBatch], how: Secrets) -> Iterator[pa.RecordBatch]:
    """Spans and candidates of each document, and rows of name counts between them."""
    row = TaskContext.get().partitionId() << 40
    outside, inside = Counter(), Counter()
    for batch in batches:
        for part in words.slices(batch):
            columns: list[list] = [[] for _ in range(5)]
            for text in part["text"].to_pylist():
                text = text or ""
                spans = base_spans(text)
                more = candidates(text, spans, how)
                _count_names(text, more, outside, inside)
                columns[0].append([f"{k}:{a}:{b}" for a, b, k in spans])
                columns[1].append([c[0] for c in more])
                for at in (1, 2, 3):
                    columns[at + 1].append([_clean(c[at]) for c in more])
            arrays = [pa.array(row + np.arange(part.num_rows)), part["doc_id"]]
            row += part.num_rows
            columns += [[[]] * part.num_rows] * 3
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(_FOUND)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND)
            if len(outside) + len(inside) > words.MEMORY:
                yield _counts(outside, inside)
    yield _counts(outside, inside)


def _value_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(v, n) for v in batch["value"].to_pylist() for n in set(_NAME.findall(v))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["value", "name"]
        )


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    """Names last in the dictionary are nearest to the text."""
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=level)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=primed, level=level)


def added_bytes(how: zstandard.ZstdCompressor, value: str, before: str, after: str) -> int:
    """Compressed bytes that the value adds to the text around it."""
    whole, rest = (before + value + after).encode(), (before + after).encode()
    return len(how.compress(whole)) - len(how.compress(rest))


def _novel(batches: Iterator[pa.RecordBatch], how: Secrets, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Candidates that add enough, as row and span."""
    own = compressor(dictionary, how.level)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            value = r["value"]
            before = " ".join([*sorted(r["known"] or []), r["before"]])
            if added_bytes(own, value, before, r["after"]) >= how.rate * len(value):
                rows.append((r["row"], f"novel:{r['start']}:{r['start'] + len(value)}"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
            names=["row", "span"],
        )


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            base = row["spans"]
            kinds = [s.split(":")[0] for s in base]
            spans = [(int(a), KINDS.index(k), s) for s in [*base, *(row["novel"] or [])] for k, a, _ in [s.split(":")]]
            sha = hashlib.sha256(",".join(base).encode()).hexdigest()
            rows.append((row["doc_id"], *map(kinds.count, KINDS[:3]), sha, ",".join(s for *_, s in sorted(spans))))
        types = [pa.int64()] * 4 + [pa.string()] * 2
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(
    docs: DataFrame, how: Secrets = Secrets(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind. Null and empty texts have none; repeated rows and rows without id are
    scanned one by one. Extra columns are not read. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark, "secrets") as work:
        found = work.table(
            texts.mapInArrow(
                lambda x: _scan(x, how),
                "row long, doc_id long, spans array<string>, starts array<long>, values array<string>, "
                "before array<string>, after array<string>, names array<string>, outside array<long>, "
                "inside array<long>",
            ),
            "found",
        )
        counts = found.where("row is null").selectExpr("inline(arrays_zip(names, outside, inside))")
        counts = counts.groupBy(F.col("names").alias("name")).agg(
            F.sum("outside").alias("n"), F.sum("inside").alias("inside")
        )
        known = work.table(counts.where("n > greatest(1, inside)").select("name", "n"), "known")
        # At least five bytes each: the rows fit the dictionary's fixed size.
        top = known.orderBy(F.desc("n"), "name").limit(how.dictionary_bytes // 5).collect()
        dictionary = "\n".join(r["name"] for r in top).encode()[: how.dictionary_bytes]
        dictionary = b"\n".join(reversed(dictionary.split(b"\n")))
        docs_found = found.where("row is not null")
        zipped = "inline(arrays_zip(starts, values, before, after))"
        each = docs_found.where(F.size("values") > 0).selectExpr("row", zipped)
        each = work.table(each.toDF("row", "start", "value", "before", "after"), "candidates")
        held = each.select("value").distinct().mapInArrow(_value_names, "value string, name string")
        held = held.join(known.select("name"), "name").groupBy("value").agg(F.collect_list("name").alias("known"))
        each = each.join(small(work.table(held, "held"), 100_000), "value", "left")
        novel = each.select("row", "start", "value", "before", "after", "known").mapInArrow(
            lambda x: _novel(x, how, dictionary), "row long, span string"
        )
        novel = work.table(novel.groupBy("row").agg(F.collect_list("span").alias("novel")), "novel")
        result = docs_found.select("row", "doc_id", "spans").join(small(novel, 100_000), "row", "left").mapInArrow(
            _report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
        )
        return work.table(result, "result", keep=True)
