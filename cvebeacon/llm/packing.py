"""Mixture-controlled packing: deficit round-robin over source queues.

Method: every source is a queue of tokens. A window of ``window`` sequences takes
from each queue its target share; what rounding leaves is a deficit that the
queue carries into the next window. Served in turn, after n windows the first s
queues have given floor(share of these queues x tokens of n windows) tokens. That
sum has a closed form, so a document's place follows from its offset in its
queue, in any partition, with the deficits carried exactly and no sequential pass.
Target shares are the sources' shares of all tokens, so all queues end together,
nothing is dropped, and only the last sequence is padded.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.llm import words
from cvebeacon.llm.common import scratch, small


@dataclass(frozen=True)
class Packing:
    """``window`` is in sequences; ``block_rows`` bounds the rows ordered by one task."""

    tokenizer: str
    length: int = 4096
    window: int = 64
    end_id: int = 2
    block_rows: int = 5_000


def _tokenizer(path: str):
    """The tokenizer of a file, or of the installed package's file of that name."""
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = str(public_tokenizers.path(os.path.basename(path)))
    return Tokenizer.from_file(path)


#: Letters that stay one character each when a tokenizer composes and lower-cases them, a
#: word's such letters and what follows from an ASCII character that is none, and the rules
#: of tokenizers that tell the two apart.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_PARTS = rf"(?s)^(?P<letters>{_LETTER}+)(?P<rest>(?:[!-@\[-`{{-~].*)?)$"
_NORMAL = ["NFC", "Replace", "Lowercase"]
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Parts of words, and bytes of their ids, that a task remembers before it starts anew.
_MEMORY, _MEMORY_BYTES = 500_000, 32_000_000


def _tells_apart(tokenizer) -> bool:
    """Whether letters in any case and what follows them are tokenized apart."""
    made = json.loads(tokenizer.to_str())
    normal = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    return (
        normal == _NORMAL
        and cuts[0].get("pattern") == {"Regex": _APART}
        and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in cuts[1:]] == [("ByteLevel", False, False)]
        and made["model"]["type"] == "BPE"
        and not made["model"].get("dropout")
        and all(x["content"].startswith("<") and not x["single_word"] for x in made["added_tokens"])
    )


def _binary(offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """The bytes of ``like`` cut at ``offsets``."""
    data = like.buffers()[2] or pa.py_buffer(b"")
    cuts = pa.py_buffer(np.ascontiguousarray(offsets, np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, cuts, data])


def _offsets(array: pa.Array) -> np.ndarray:
    """Where each of the bytes begins and the last ends."""
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


class _WordIds:
    """Ids of words that were met before.

    The tokenizer splits at white space and drops it, so a text's ids are those
    of its words one after the other. Where it also lower-cases and splits letters
    from others, a word's ids are those of its first letters in lower case and of
    its rest. Each such part is encoded once for each task. Letters alone need
    none of the tokenizer's rules, only its model; others are encoded many at a
    time, joined by spaces, and the offset of an id tells its part. After
    ``_MEMORY`` parts or ``_MEMORY_BYTES`` of ids the memory starts anew.

    Ids are kept as bytes, two for each id or four if the vocabulary needs them,
    so that Arrow puts a text together. With ``end_id`` that id ends every text.
    """

    def __init__(self, path: str, end_id: int | None = None):
        self._tokenizer = _tokenizer(path)
        self._apart = _tells_apart(self._tokenizer)
        if self._apart:
            self._model, cuts = self._tokenizer.model, self._tokenizer.pre_tokenizer
            # The characters that stand for the bytes of letters in the model's vocabulary.
            spelled = {ord(" "): " "}
            for x in filter(re.compile(_LETTER).match, map(chr, range(256))):
                spelled |= zip(x.encode(), cuts.pre_tokenize_str(x)[0][0], strict=True)
            self._spelled = "".join(spelled.get(x, "\ufffe") for x in range(256))
        known = self._tokenizer.get_vocab().values()
        self.type = np.dtype("<u2" if max(*known, end_id or 0) < 65536 else "<u4")
        end = [] if end_id is None else [end_id]
        self._end = pa.array([np.array(end, self.type).tobytes()], pa.large_binary())
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {"": 0}
        self._ids = pa.array([b""], pa.large_binary())

    def _tokens(self, part: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of ``part`` in turn, and the number of each."""
        text = " ".join(part)
        if letters:
            ids, sizes = [], []
            for word in codecs.charmap_decode(text.encode(), "strict", self._spelled)[0].split(" "):
                found = [x.id for x in self._model.tokenize(word)]
                ids += found
                sizes.append(len(found))
            return np.array(ids, self.type), np.array(sizes)
        encoded = self._tokenizer.encode(text, add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
        at = np.fromiter((x for x, _ in encoded.offsets), np.int64, len(encoded.ids))
        sizes = np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(part))
        return np.array(encoded.ids, self.type), sizes

    def _numbers(self, parts: pa.Array, letters: bool) -> np.ndarray:
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self._number.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = [distinct[k] for k in missing]
            numbers[missing] = np.arange(len(new)) + len(self._number)
            self._number.update(zip(new, numbers[missing].tolist(), strict=True))
            found = [self._tokens(new[a : a + 5_000], letters) for a in range(0, len(new), 5_000)]
            ids, sizes = map(np.concatenate, zip(*found, strict=True))
            data = pa.array([ids.tobytes()], pa.large_binary())
            added = _binary(np.cumsum([0, *sizes]) * self.type.itemsize, data)
            self._ids = pa.concat_arrays([self._ids, added])
        return numbers[np.asarray(coded.indices)]

    def _word_ids(self, distinct: pa.Array) -> pa.Array:
        """The ids of each word."""
        if len(self._number) > _MEMORY or self._ids.nbytes > _MEMORY_BYTES:
            self._clear()
        if not self._apart:
            numbers = self._numbers(distinct, False)
            return self._ids.take(pa.array(numbers))
        cut = pc.extract_regex(distinct, _PARTS)
        first, rest = (pc.struct_field(cut, x) for x in ("letters", "rest"))
        first, rest = pc.fill_null(first, ""), pc.if_else(pc.is_valid(cut), rest, distinct)
        parts = [self._numbers(pc.utf8_lower(first), True), self._numbers(rest, False)]
        found = self._ids.take(pa.array(np.stack(parts, axis=1).ravel()))
        return _binary(_offsets(found)[::2], found)

    def runs(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as bytes; null is empty."""
        cells = pc.ascii_split_whitespace(words.texts_array(texts))
        at, distinct, counts = words.numbered(cells)
        known = pa.concat_arrays([self._word_ids(distinct), self._end])
        ends = np.cumsum(counts)
        # The last of ``known`` ends every text.
        flat = known.take(pa.array(np.insert(at, ends, len(distinct))))
        return _binary(_offsets(flat)[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])], flat)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        return [np.frombuffer(x, self.type) for x in self.runs(texts).to_pylist()]


def _encode(batches: Iterator[pa.RecordBatch], how: Packing) -> Iterator[pa.RecordBatch]:
    tokenizer = _WordIds(how.tokenizer, how.end_id)
    for batch in batches:
        for part in words.slices(batch):
            ids = tokenizer.runs(part["text"])
            sizes = np.diff(_offsets(ids)) // tokenizer.type.itemsize
            width = np.full(len(ids), tokenizer.type.itemsize, np.int32)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["source"], pa.array(sizes), pa.array(width), ids.cast(pa.binary())],
                names=["doc_id", "source", "doc_tokens", "width", "ids"],
            )


def served(ahead: int, n: int, span: int, total: int) -> int:
    """Tokens that queues holding ``ahead`` tokens together have given after n windows."""
    return ahead * min(n * span, total) // total


def places(
    start: int, size: int, ahead: int, own: int, total: int, span: int, length: int
) -> list[tuple[int, int, int, int]]:
    """(start in the document, sequence, offset, length) of the pieces of one document.

    ``start`` is the document's offset in its queue, ``own`` the queue's tokens,
    ``ahead`` those of the queues before it.
    """
    found, at = [], start
    while at < start + size:
        # The window that serves token ``at``: the last to start at or before it.
        n, high = 0, total // span + 1
        while n + 1 < high:
            middle = (n + high) // 2
            if served(ahead + own, middle, span, total) - served(ahead, middle, span, total) > at:
                high = middle
            else:
                n = middle
        first, last = served(ahead, n, span, total), served(ahead, n + 1, span, total)
        given = served(ahead + own, n, span, total) - first
        upto = served(ahead + own, n + 1, span, total) - last
        while at < min(upto, start + size):
            # In the window: the shares of the queues before, then this one's.
            place = min(n * span, total) + (last - first) + at - given
            sequence, offset = divmod(place, length)
            step = min(length - offset, upto - at, start + size - at)
            found.append((at - start, sequence, offset, step))
            at += step
    return found


def _pieces(batches: Iterator[pa.RecordBatch], how: Packing, total: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            out: list[tuple] = []
            part = batch.slice(lo, 500)
            for row in part.to_pylist():
                width = row["width"]
                ids = np.frombuffer(row["ids"], f"<u{width}").astype("<u4")
                for start, sequence, offset, step in places(
                    row["at"], row["doc_tokens"], row["ahead"], row["own"], total,
                    how.window * how.length, how.length,
                ):
                    crc = crc32(ids[start : start + step].tobytes())
                    out.append((row["doc_id"], start, step, crc, row["doc_tokens"], sequence, offset))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=names
            )


def pack(
    docs: DataFrame,
    how: Packing,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a null source is a queue of its
    own; repeated rows are packed one by one, rows without id too. Extra columns
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with scratch(spark, "packing") as work:
        texts = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
            F.col(text_col).alias("text"),
        )
        encoded = work.table(
            texts.mapInArrow(
                lambda x: _encode(x, how),
                "doc_id long, source string, doc_tokens long, width int, ids binary",
            ),
            "encoded",
        )
        rows = encoded.count()
        blocks = max(1, -(-rows // how.block_rows))
        block = F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(blocks)).alias("block")
        sizes = work.table(
            encoded.groupBy("source", block).agg(F.sum("doc_tokens").alias("size")), "sizes"
        )
        by_source = Window.partitionBy("source").orderBy("block")
        order = Window.orderBy("source")
        queues = sizes.groupBy("source").agg(F.sum("size").alias("own"))
        queues = queues.withColumn("ahead", F.sum("own").over(order) - F.col("own"))
        starts = work.table(
            sizes.withColumn("first", F.sum("size").over(by_source) - F.col("size")).join(
                queues, "source"
            ).drop("size"),
            "starts",
        )
        total = queues.agg(F.sum("own")).first()[0] or 1
        inside = Window.partitionBy("source", "block").orderBy("doc_id", "ids")
        placed = encoded.withColumn("block", block).withColumn(
            "before",
            F.sum("doc_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("doc_tokens"),
        )
        placed = placed.join(small(starts), ["source", "block"]).select(
            "doc_id", "doc_tokens", "width", "ids", (F.col("first") + F.col("before")).alias("at"), "own", "ahead"
        )
        pieces = placed.mapInArrow(
            lambda x: _pieces(x, how, total),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long",
        )
        return work.table(pieces, "pieces", keep=True)
