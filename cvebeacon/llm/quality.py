"""Quality scores: random-indexing word vectors and a small calibrated network.

Every word has a class (its shape, the signs around it, whether it repeats the
word before, and a hash of its letters). A class's vector is the sum of sparse
random index vectors of the words around it, gathered over all documents; the
table of classes has a fixed size. A document is the mean of its words' context
and index vectors with three counts. A two-layer numpy network turns that into
a logit and a temperature, fitted on held-back training rows, into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm import words
from cvebeacon.llm.common import scratch, small
from cvebeacon.llm.learning import Network, fit, held_out, label_sample

#: Classes of words: 2 (repeat) x 128 (shape and signs) x 64 (letters).
CLASSES = 2 * 128 * 64
#: Dimensions of index and context vectors.
DIMENSIONS = 32


#: Bytes of text whose words have their vectors in memory at a time.
SLICE_BYTES = 500_000


@dataclass(frozen=True)
class Quality:
    """``sample`` bounds the labelled rows of the fit; all else covers all rows."""

    sample: int = 20_000
    threshold: float = 0.3
    label: str = "quality"
    window: int = 2


def _tail_sign(tail: str) -> int:
    """Kind (0 to 7) of the signs after a word."""
    if not tail:
        return 0
    if tail in (",", ".", ":", ";"):
        return 1 if tail == "," else 2
    if len(tail) == 1:
        return 3
    if len(set(tail)) == 1:
        return 4 + xxhash.xxh32_intdigest(tail[:1].encode()) % 3
    return 7


def word_classes(written: pa.Array) -> np.ndarray:
    """Class of each word, without the repeat bit."""
    core = pc.utf8_ltrim(written, "\"'([{<¿¡«")
    lead = np.asarray(pc.not_equal(core, written)).astype(np.int64)
    bare = pc.replace_substring_regex(core, r"[^\pL\pN]+$", "")
    tail = pc.replace_substring_regex(core, r"^(?s:.*)[\pL\pN]", "")
    empty = pc.equal(bare, "")
    tails = pc.if_else(empty, written, tail).dictionary_encode()
    kinds = np.array([_tail_sign(t) for t in tails.dictionary.to_pylist()], np.int64)
    sign = kinds[np.asarray(tails.indices)]
    rest = pc.utf8_slice_codeunits(bare, 1)
    single = pc.equal(pc.utf8_length(bare), 1)
    tests = [
        empty,
        pc.utf8_is_digit(bare),
        pc.invert(pc.utf8_is_alpha(bare)),
        pc.utf8_is_lower(bare),
        pc.and_(pc.utf8_is_upper(bare), pc.invert(single)),
        pc.or_(pc.utf8_is_lower(rest), single),
    ]
    shape = np.select([np.asarray(t) for t in tests], range(6), 6).astype(np.int64)
    letters = (words.hashes(pc.utf8_lower(bare)) % np.uint64(64)).astype(np.int64)
    return (((lead * 8 + shape) * 8 + sign) << 6) | letters


def classes(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word, text after text, and words per text."""
    split = pc.utf8_split_whitespace(words.texts_array(texts))
    at, distinct, counts = words.numbered(split)
    if not len(at):
        return np.zeros(0, np.int64), counts
    repeat = np.zeros(len(at), np.int64)
    repeat[1:] = at[1:] == at[:-1]
    repeat[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return word_classes(distinct)[at] | (repeat << 13), counts


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors: four signs for the shape and two for the class."""
    random = np.random.default_rng(11)
    table = np.zeros((CLASSES, DIMENSIONS), np.float32)
    for group in range(CLASSES // 64):
        at = random.permutation(DIMENSIONS)[:4]
        table[group * 64 : group * 64 + 64, at] = random.choice([-1, 1], 4)
    for row in table:
        at = random.permutation(DIMENSIONS)[:2]
        row[at] += random.choice([-1, 1], 2)
    return table


def _contexts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For each class that a task meets, the sum of index vectors around its words."""
    index = index_vectors()
    total = np.zeros((CLASSES, DIMENSIONS))
    seen = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for part in words.slices(batch, size=SLICE_BYTES):
            flat, counts = classes(part["text"])
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(counts)), counts)
            around = np.zeros((len(flat), DIMENSIONS), np.float32)
            for step in range(1, window + 1):
                same = (owner[step:] == owner[:-step])[:, None]
                around[step:] += index[flat[:-step]] * same
                around[:-step] += index[flat[step:]] * same
            order = np.argsort(flat, kind="stable")
            met, starts = np.unique(flat[order], return_index=True)
            total[met] += np.add.reduceat(around[order], starts, axis=0)
            seen += np.bincount(flat, minlength=CLASSES)
    met = np.flatnonzero(seen)
    names = ["class", "n", *(f"d{i}" for i in range(DIMENSIONS))]
    columns = [met, seen[met], *total[met].T]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def context_table(docs: DataFrame, window: int) -> np.ndarray:
    """Context vector of every class over all documents, at unit length.

    The table has CLASSES rows whatever the input; tasks send sums only.
    """
    fields = ", ".join(f"d{i} double" for i in range(DIMENSIONS))
    sums = docs.mapInArrow(lambda x: _contexts(x, window), f"class long, n long, {fields}")
    sums = sums.groupBy("class").agg(
        F.sum("n").alias("n"), *(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIMENSIONS))
    )
    rows = sums.toPandas()
    table = np.zeros((CLASSES, DIMENSIONS), np.float32)
    if len(rows):
        values = rows[[f"d{i}" for i in range(DIMENSIONS)]].to_numpy(float)
        length = np.linalg.norm(values, axis=1, keepdims=True)
        table[rows["class"].to_numpy(int)] = values / np.maximum(length, 1e-12)
    return table


def _pool(batches: Iterator[pa.RecordBatch], context: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = np.hstack([context, index_vectors()])
    for batch in batches:
        for part in words.slices(batch, size=SLICE_BYTES):
            flat, counts = classes(part["text"])
            pooled = np.zeros((len(counts), table.shape[1] + 3), np.float32)
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            if len(some):
                size = counts[some][:, None]
                pooled[some, :-3] = np.add.reduceat(table[flat], starts, axis=0) / size
                bounds = zip(starts, counts[some], strict=True)
                kinds = np.array([len(np.unique(flat[a : a + n])) for a, n in bounds])
                pooled[some, -3] = np.log1p(counts[some])
                pooled[some, -2] = kinds / counts[some]
                pooled[some, -1] = np.add.reduceat(flat >> 13, starts) / counts[some]
            values = pa.array(pooled.ravel())
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(len(counts) + 1, dtype=np.int32) * pooled.shape[1]), values
            )
            yield pa.RecordBatch.from_arrays([part["doc_id"], vectors], names=["doc_id", "vector"])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = net.score(matrix(batch["vector"], len(net.mean)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(score)], names=["doc_id", "score"]
            )


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    how: Quality = Quality(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    Null and empty texts have the zero vector and are scored like any other; a
    row without id is scored and never learned from; rows that share an id are
    scored one by one. An empty table gives an empty result; without labels of
    both classes every score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark, "quality") as work:
        context = spark.sparkContext.broadcast(context_table(texts.select("text"), how.window))
        pooled = work.table(
            texts.mapInArrow(lambda x: _pool(x, context.value), "doc_id long, vector array<float>"),
            "pooled",
        )
        sample = work.table(label_sample(labels, how.label, how.sample), "sample")
        learned = pooled.join(small(sample), "doc_id").dropDuplicates(["doc_id"])
        rows = sorted(learned.select("doc_id", "label", "vector").collect())
        width = 2 * DIMENSIONS + 3
        x = np.array([r["vector"] for r in rows], float).reshape(-1, width)
        net = fit(x, np.array([r["label"] for r in rows], float))
        shared = spark.sparkContext.broadcast(net)
        scored = pooled.mapInArrow(
            lambda x: _score(x, shared.value), "doc_id long, score double"
        ).select(
            "doc_id",
            held_out().alias("held_out"),
            "score",
            (F.col("score") >= how.threshold).cast("int").alias("predicted"),
        )
        return work.table(scored, "scores", keep=True)


def keep_good(
    docs: DataFrame, labels: DataFrame, how: Quality = Quality(), id_col: str = "doc_id"
) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns stay.

    Of rows that share an id all go if one is rejected; rows without id stay.
    """
    found = quality_scores(docs, labels, how, id_col)
    gone = found.where("predicted = 0").select(F.col("doc_id").alias("__gone"))
    return docs.join(small(gone.distinct()), docs[id_col] == F.col("__gone"), "left_anti")
