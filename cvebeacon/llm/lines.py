"""Exact set-similarity join of lines, and the removal of later matches.

Method: a line is the set of its words. Words are ordered by rarity; two lines
that are similar enough share a word in their prefixes, the first
``n - ceil(similarity * n) + 1`` words in that order. Pairs that share a prefix
word and pass the length and positional filters, and a filter on parities of their
words that bounds in how many they differ, are verified on their full sets.
A line goes if an earlier one, by document id and line number, is that similar.

Rarity comes from word counts over all texts in a table of fixed size, shared by
words that collide; any common order gives exact results, a good one is fast.

Hot groups: equal lines are one class, represented by the first of them, so a
common line costs one row. The classes that share a prefix word lie side by side
once they are sorted by it, so those of a group of up to ``CLOSE`` meet there and then.
In a larger group every class is first compared with the earliest class only; just
those not removed by it meet the other earlier ones, in a join by word.
Kept lines are found by position, never by joining on a common line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm import words
from cvebeacon.llm.common import Scratch, scratch, small

#: Counters of the rarity table, and how many of them are added up as one row.
COUNTERS = 1 << 20
BLOCK = 1 << 13
COUNTED = "block long, counts binary"
#: Most lines with a prefix word that all meet where they lie; most of them that a line may
#: resemble there, on average, and how many pairs are looked at in one step.
CLOSE = 512
ALIKE = 4
STEP = 1 << 18
#: Turns in which the lines of larger groups meet, each with its own words.
SLICES = 4
#: Rows of ``_MET``: a line with the earliest, with a later one that it may resemble; from here on
#: a line that meets others in the turn of that number.
EARLIEST, LATER, TURNS = 0, 1, 2
#: Lines of so many words have a second word map.
MANY = 48


@dataclass(frozen=True)
class LineDedup:
    """Lines with fewer than ``words`` different words are kept; similarity as a fraction."""

    words: int = 1
    numerator: int = 80
    denominator: int = 100


def _line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines in turn, words per line, lines per text."""
    data, offsets = words.utf8(texts)
    starts, ends = words.spans(data, offsets)
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return words.codes(data, starts, ends), counts, per_text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for part in words.slices(batch):
            flat, _, _ = _line_words(part["text"])
            seen += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    yield counted(seen)


def counted(seen: np.ndarray) -> pa.RecordBatch:
    """The counters of a task, a block a row; schema ``COUNTED``."""
    blocks = seen.reshape(-1, BLOCK)
    at = np.flatnonzero(blocks.any(axis=1))
    counts = pa.array([x.tobytes() for x in blocks[at]], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(at), counts], names=["block", "counts"])


def _add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for batch in tables:
        for counts in batch["counts"]:
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"]
    )


def ranks(counts: DataFrame) -> np.ndarray:
    """Rank of every counter, rarest first, from the counters of all tasks."""
    table = np.zeros((COUNTERS // BLOCK, BLOCK), np.int64)
    for row in counts.groupBy("block").applyInArrow(_add, COUNTED).collect():
        table[row.block] = np.frombuffer(row.counts, np.int64)
    rank = np.empty(COUNTERS, np.int32)
    rank[np.argsort(table.ravel(), kind="stable")] = np.arange(COUNTERS, dtype=np.int32)
    return rank


def rarity(texts: DataFrame) -> np.ndarray:
    """Rank of every counter, rarest first, from the words of all texts."""
    return ranks(texts.mapInArrow(_count, COUNTED))


def rarest_first(flat: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different words of each line, rarest first, line after line, and their number."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = rank[(flat % np.uint64(COUNTERS)).astype(np.int64)]
    # Line, rank and the first bits of the hash in one number sort fastest.
    used = len(counts).bit_length() + COUNTERS.bit_length() - 1
    key = (owner.astype(np.uint64) * np.uint64(COUNTERS) + place.astype(np.uint64)) << np.uint64(64 - used)
    key |= flat >> np.uint64(used)
    order = np.argsort(key)
    tied = key[order]
    tied = tied[1:] == tied[:-1]
    if (tied & (flat[order][1:] != flat[order][:-1])).any():
        order = np.lexsort((flat, place, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.bincount(owner[new], minlength=len(counts))


def prefix_size(n: np.ndarray, how: LineDedup) -> np.ndarray:
    return n - -(-n * how.numerator // how.denominator) + 1


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_LINE = "doc_id long, line int, h1 long, h2 long, n int, bits long, half long, prefix array<int>"


def _prefixes(batches: Iterator[pa.RecordBatch], how: LineDedup, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every line with a word: its set as two hashes, its size, its prefix."""
    for batch in batches:
        for part in words.slices(batch):
            flat, counts, per_text = _line_words(part["text"])
            tokens, n = rarest_first(flat, counts, rank)
            starts = np.cumsum(n) - n
            keep = np.flatnonzero(n >= max(how.words, 1))
            if not len(keep):
                continue
            text = np.repeat(np.arange(len(per_text)), per_text)
            line = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            inside = tokens[ranges(starts[keep], n[keep])]
            first = np.cumsum(n[keep]) - n[keep]
            h1 = np.add.reduceat(words.mix(inside), first)
            h2 = np.add.reduceat(words.mix(inside ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
            size = prefix_size(n[keep], how)
            prefix = tokens[ranges(starts[keep], size)]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            one = np.uint64(1) << (inside >> np.uint64(58))
            bits = np.bitwise_xor.reduceat(one, first)
            half = np.bitwise_xor.reduceat(one * ((inside >> np.uint64(57)) & np.uint64(1)), first)
            half[n[keep] < MANY] = 0
            short = (prefix >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].take(pa.array(text[keep])),
                    pa.array(line[keep].astype(np.int32)),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.array(n[keep].astype(np.int32)),
                    pa.array(bits.view(np.int64)),
                    pa.array(half.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(short)),
                ],
                names=["doc_id", "line", "h1", "h2", "n", "bits", "half", "prefix"],
            )


_MET = (
    "a_doc long, a_line int, word int, b_doc long, b_line int, b_n long, b_bits long, b_half long, b_i long, kind int"
)


def _may_match(
    rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, how: LineDedup
) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows ``a`` and ``b`` that pass the filters; as in ``later_matches``."""
    num, den = how.numerator, how.denominator
    n, i = rows["n"], rows["i"]
    left = n - i
    near = (num + den) * np.minimum(left[a], left[b]) >= num * (n[a] + n[b])
    a, b = a[near], b[near]
    near = num * np.maximum(n[a], n[b]) <= den * np.minimum(n[a], n[b])
    near &= (rows["doc"][a] != rows["doc"][b]) | (rows["line"][a] != rows["line"][b])
    bits = rows["bits"][a] ^ rows["bits"][b]
    half = np.where(np.minimum(n[a], n[b]) < MANY, 0, rows["half"][a] ^ rows["half"][b])
    differ = np.bitwise_count((bits ^ half).view(np.uint64)).astype(np.int64)
    differ += np.bitwise_count(half.view(np.uint64))
    near &= (num + den) * (n[a] + n[b] - differ) >= 2 * num * (n[a] + n[b])
    return a[near], b[near]


def _pairs(
    rows: dict[str, np.ndarray], group: np.ndarray, big: np.ndarray, starts: np.ndarray, how: LineDedup
) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may match, the earlier first: all of a small group, of a big one those with its earliest."""
    n = rows["n"][: len(group)]
    # By size, so that a line meets those only that are long enough for it.
    key = (group << 32) + n
    order = np.flatnonzero(~big)
    order = order[np.argsort(key[order], kind="stable")]
    least = -(-how.numerator * n[order] // how.denominator)
    low = np.searchsorted(key[order], (group[order] << 32) + least)
    meets = np.arange(len(order)) - low
    step = np.cumsum(meets) // STEP
    cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
    others = np.flatnonzero(big)
    found = [_may_match(rows, starts[group[others]], others, how)]
    for k, upto in zip(cuts[:-1], cuts[1:], strict=True):
        longer = np.repeat(order[k:upto], meets[k:upto])
        found.append(_may_match(rows, order[ranges(low[k:upto], meets[k:upto])], longer, how))
    x, y = (np.concatenate(side) for side in zip(*found, strict=True))
    a, b = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((a, b))
    return a[order], b[order]


def _meet(batches: Iterator[pa.RecordBatch], how: LineDedup) -> Iterator[pa.RecordBatch]:
    """Pairs of lines that share a prefix word, from rows sorted by word, document and line.

    Lines of a group of up to ``CLOSE`` all meet, those of a larger one its earliest only;
    the others of it are given on, for the join by word. So are those of a group in which
    too many may match: most of them go with the earliest, and need not be compared.
    """
    # Of the last group, which may go on: its rows or, if it is large already, its earliest.
    held, large = None, False
    for batch in chain(batches, [None]):
        rows = held
        if batch is not None:
            rows = {c: batch[c].to_numpy() for c in batch.schema.names}
            rows["n"], rows["i"] = rows["size"] >> 32, rows.pop("size") & 0xFFFFFFFF
            if held is not None:
                rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
        if rows is None or not len(rows["word"]):
            continue
        word = rows["word"]
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(word)))
        big = sizes > CLOSE
        big[0] |= large
        if batch is not None:
            large = bool(big[-1])
            held = {c: x[starts[-1] :][: 1 if large else None].copy() for c, x in rows.items()}
            if not large:
                sizes, big = sizes[:-1], big[:-1]
        group = np.repeat(np.arange(len(sizes)), sizes)
        a, b = _pairs(rows, group, big[group], starts, how)
        later = np.zeros(len(b), bool)
        later[1:] = b[1:] == b[:-1]
        given = big | (np.bincount(group[b[later]], minlength=len(sizes)) > ALIKE * sizes)
        keep = ~(later & given[group[b]])
        a, b, later = a[keep], b[keep], later[keep]
        others = np.flatnonzero(given[group] & (np.arange(len(group)) != starts[group]))
        out = np.concatenate([b, others])
        if not len(out):
            continue
        kind = np.concatenate([np.where(later, LATER, EARLIEST), TURNS + word[others] % SLICES])
        none = pa.nulls(len(others), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(rows["doc"][a]), none]),
                pa.concat_arrays([pa.array(rows["line"][a]), none.cast(pa.int32())]),
                pa.array(word[out]),
                *(pa.array(rows[c][out]) for c in ("doc", "line", "n", "bits", "half", "i")),
                pa.array(kind.astype(np.int32)),
            ],
            names=[c.split()[0] for c in _MET.split(", ")],
        )


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            flat, counts, per_text = _line_words(part["text"])
            wanted = part["lines"].flatten().to_numpy()
            of = np.repeat(np.arange(len(per_text)), np.asarray(part["lines"].value_lengths()))
            # Rows that share an id are copies or, at worst, have fewer lines.
            there = wanted < per_text[of]
            wanted, of = wanted[there], of[there]
            at = (np.cumsum(per_text) - per_text)[of] + wanted
            ends = np.cumsum(counts)[at]
            sets = [np.unique(flat[e - c : e]).tobytes() for e, c in zip(ends, counts[at], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].take(pa.array(of)), pa.array(wanted.astype(np.int32)), pa.array(sets, pa.binary())],
                names=["doc_id", "line", "elements"],
            )


def _similar(batches: Iterator[pa.RecordBatch], how: LineDedup) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        pairs = zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True)
        for x, y in pairs:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(how.denominator * both >= how.numerator * (len(x) + len(y) - both))
        yield batch.select(["b_doc", "b_line"]).filter(pa.array(keep, pa.bool_()))


def _verified(work: Scratch, pairs: DataFrame, texts: DataFrame, how: LineDedup) -> DataFrame:
    """Lines (b_doc, b_line) of the pairs whose full sets are similar enough."""
    side = "inline(array(struct(a_doc as doc_id, a_line as line), struct(b_doc as doc_id, b_line as line)))"
    wanted = work.table(
        pairs.selectExpr(side).distinct().groupBy("doc_id").agg(F.collect_list("line").alias("lines")),
        "wanted",
    )
    sets = work.table(
        texts.join(small(wanted, 100_000), "doc_id")
        .select("doc_id", "text", "lines")
        .mapInArrow(_wanted_sets, "doc_id long, line int, elements binary")
        .dropDuplicates(["doc_id", "line"]),
        "sets",
    )
    for x in ("a", "b"):
        own = sets.select(
            F.col("doc_id").alias(f"{x}_doc"), F.col("line").alias(f"{x}_line"), F.col("elements").alias(f"set_{x}")
        )
        pairs = pairs.join(own, [f"{x}_doc", f"{x}_line"])
    found = pairs.mapInArrow(lambda x: _similar(x, how), "b_doc long, b_line int").distinct()
    found = work.table(found, "found")
    work.drop(sets)
    return found


def later_matches(work: Scratch, texts: DataFrame, how: LineDedup) -> DataFrame:
    """``doc_id`` and ``line`` (from 0) of all lines to remove, as a table."""
    spark = texts.sparkSession
    rank = spark.sparkContext.broadcast(rarity(texts.select("text")))
    lines = work.table(texts.mapInArrow(lambda x: _prefixes(x, how, rank.value), _LINE), "lines")
    classes = work.table(
        lines.groupBy("h1", "h2").agg(
            F.min(F.struct("doc_id", "line")).alias("at"),
            F.max("n").alias("n"),
            F.max("bits").alias("bits"),
            F.max("half").alias("half"),
            F.any_value("prefix").alias("prefix"),
        ).select("at.doc_id", "at.line", "n", "bits", "half", "prefix"),
        "classes",
    )
    places = ["doc_id", "line"]
    copies = lines.select(places).distinct().join(classes.select(places), places, "left_anti")
    copies = work.table(copies, "copies")
    work.drop(lines)
    # A smaller set is similar to none but its equals, which are its class already.
    joinable = classes.where(how.denominator * F.col("n") >= how.numerator * (F.col("n") + 1))
    postings = joinable.select(
        "doc_id", "line", F.shiftleft(F.col("n").cast("long"), 32).alias("n"), "bits", "half",
        F.posexplode("prefix").alias("i", "word"),
    ).selectExpr("word", "doc_id as doc", "line", "n | i as size", "bits", "half")
    # By word, document and line; Spark compares the first number without looking at the row.
    word_first = F.expr("shiftleft(cast(word as long), 32) + least(greatest(doc, 0L), 4294967295L)")
    lying = postings.repartition("word").sortWithinPartitions(word_first, "doc", "line")
    met = work.folders(lying.mapInArrow(lambda x: _meet(x, how), _MET), "kind", "met")
    work.drop(classes)
    ids = ["a_doc", "a_line", "b_doc", "b_line"]
    first = work.table(met.where(F.col("kind") == EARLIEST).select(ids).distinct(), "first-pairs")
    gone = _verified(work, first, texts, how)
    gone_at = small(gone)
    num, den = how.numerator, how.denominator
    differ = (
        f"if(least(a_n, b_n) < {MANY}, bit_count(a_bits ^ b_bits),"
        " bit_count(a_bits ^ a_half ^ b_bits ^ b_half) + bit_count(a_half ^ b_half))"
    )
    alike = F.expr(
        f"(a_doc < b_doc or (a_doc = b_doc and a_line < b_line))"
        f" and {num} * greatest(a_n, b_n) <= {den} * least(a_n, b_n)"
        # The first shared word: nothing before it is shared.
        f" and {num + den} * least(a_n - a_i, b_n - b_i) >= {num} * (a_n + b_n)"
        # A bit is the parity of the words that it stands for: where two lines differ in it, one
        # has a word that the other has not. Parities do not fill up as lines get longer.
        f" and {num + den} * (a_n + b_n - {differ}) >= {2 * num} * (a_n + b_n)"
    )
    ahead = [F.col(f"b_{c}").alias(f"a_{c}") for c in ("doc", "line", "n", "bits", "half", "i")]
    # The first shared word of two similar lines either has a small group or the earlier one as
    # the earliest of its group, so they have met, or both are behind the earliest.
    parts = [met.where(F.col("kind") == LATER).select(ids).join(gone_at, ["b_doc", "b_line"], "left_anti").select(ids)]
    for k in range(SLICES):
        # Some of the words at a time: the shuffled postings of the others take no disk meanwhile.
        own = met.where(F.col("kind") == TURNS + k).drop(*ids[:2], "kind")
        pairs = own.join(gone_at, ["b_doc", "b_line"], "left_anti").join(own.select("word", *ahead), "word")
        parts.append(work.table(pairs.where(alike).select(ids).distinct(), "met"))
    rest = reduce(DataFrame.unionByName, parts).distinct()
    rest = work.table(rest.join(first, ids, "left_anti"), "pairs")
    work.drop(met)
    gone = gone.unionByName(_verified(work, rest, texts, how)).select(
        F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line")
    )
    return work.table(copies.unionByName(gone).distinct(), "removed", keep=True)


def _remaining(docs: DataFrame, how: LineDedup, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the text left, and the array ``__removed`` of line numbers (or null)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession, "lines") as work:
        removed = later_matches(work, texts.where("doc_id is not null"), how)
    grouped = removed.groupBy(F.col("doc_id").alias("__id")).agg(
        F.sort_array(F.collect_list("line")).alias("__removed")
    )
    joined = docs.join(grouped, docs[id_col].cast("long") == F.col("__id"), "left")
    left = F.array_join(
        F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.array_contains(F.col("__removed"), i)),
        "\n",
    )
    own = F.when(F.col("__removed").isNull(), docs[text_col]).otherwise(left).alias(text_col)
    return joined.select(*(own if c == text_col else docs[c] for c in docs.columns), "__removed")


def dedup_lines(
    docs: DataFrame, how: LineDedup = LineDedup(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the text left after removal, and the array ``removed_lines``.

    Lines end at a newline; blank lines stay. Lines are ordered by (document id, line number), so equal lines of different documents
    are no tie. Rows that share an id must be copies: they share their line
    numbers, and a line never removes one of its own number. Rows without id
    stay as they are and remove nothing of others'; null texts stay null. Extra
    columns stay; one named ``removed_lines`` is replaced. An empty table gives
    an empty result.
    """
    found = _remaining(docs, how, id_col, text_col)
    none = F.array().cast("array<int>")
    return found.withColumn("removed_lines", F.coalesce("__removed", none)).drop("__removed")


def without_later_lines(
    docs: DataFrame, how: LineDedup = LineDedup(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with later matching lines removed; documents emptied by that go.

    Otherwise as ``dedup_lines``: null and blank texts, from which nothing was
    removed, stay; rows without id and copies under one id likewise.
    """
    found = _remaining(docs, how, id_col, text_col)
    emptied = F.col("__removed").isNotNull() & ~F.col(text_col).rlike(r"\S")
    return found.where(~emptied).drop("__removed")
