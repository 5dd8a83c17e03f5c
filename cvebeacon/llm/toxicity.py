"""Toxicity: words restored through a noisy channel, then scored.

Method: letters may have been replaced (4 for a, $ for s), spread out by spaces or
signs, or repeated. Every word with a sign that may stand for a letter, or with a
repeat, becomes a lattice of what each character may stand for, of any length;
Viterbi finds the likeliest letters under a character trigram model counted over all
documents. Spread text has word breaks in its lattice too. Words count as written and
as restored. They have log-odds of the label from training rows; a document's totals go through a small calibrated network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm import words
from cvebeacon.llm.common import scratch, small
from cvebeacon.llm.learning import Network, fit, held_out, label_sample

#: Letters of the model: a-z are 1 to 26, anything else 0.
LETTERS = 27

#: Letters that a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}


@dataclass(frozen=True)
class Toxicity:
    """``sample`` bounds the labelled rows; ``lexicon`` the words with log-odds."""

    sample: int = 20_000
    lexicon: int = 5_000
    threshold: float = 0.5
    label: str = "toxic"


_CODE = np.zeros(256, np.int64)
for _i in range(26):
    _CODE[ord("a") + _i] = _CODE[ord("A") + _i] = _i + 1


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for part in words.slices(batch):
            text = " ".join(t for t in part["text"].to_pylist() if t)
            code = _CODE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
            if len(code) > 2:
                seen += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=LETTERS**3)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["trigram", "n"])


def character_model(texts: DataFrame) -> np.ndarray:
    """log p(third | first, second) from the trigrams of all texts, add-one."""
    counts = texts.mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    table = np.ones(LETTERS**3)
    for row in counts.toPandas().itertuples():
        table[row.trigram] += row.n
    table = table.reshape(LETTERS, LETTERS, LETTERS)
    return np.log(table / table.sum(axis=2, keepdims=True))


def decode(
    word: str, model: np.ndarray, swap: float = 1.5, drop: float = 3.0, again: float = 0.7, breaks: bool = False
) -> str:
    """The likeliest lower-case letters behind a word, with ``breaks`` words with spaces between.

    States are the last two letters. A letter stands for itself, a sign for its
    letters at cost ``swap``; signs may be noise at cost ``drop``; a repeat of the
    last letter may be spurious at cost ``again``. Letters outside a-z stay. Each
    step keeps where its states came from, so time grows with the length only.
    """
    cost = _lists(model)
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    previous = ""
    for char in word.lower():
        after: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        foreign = char.isalpha() and not "a" <= char <= "z"
        own = [(char, 0 if foreign else ord(char) - 96, 0.0)] if char.isalpha() else []
        options = own + [(letter, ord(letter) - 96, swap) for letter in STANDS_FOR.get(char, "")]
        for (x, y), score in best.items():
            offers = [((y, z), score + cost[x][y][z] - price, letter) for letter, z, price in options]
            if breaks and y:
                ended = score + cost[x][y][0]
                offers += [((0, z), ended + cost[y][0][z] - price, " " + letter) for letter, z, price in options]
            if not own:
                offers.append(((x, y), score - drop, ""))
            if char == previous and (y or foreign):
                offers.append(((x, y), score - again, ""))
            for state, value, letter in offers:
                if state not in after or value > after[state]:
                    after[state], came[state] = value, ((x, y), letter)
        steps.append(came)
        best, previous = after, char
    state = max(best, key=lambda at: (best[at] + cost[at[0]][at[1]][0], at))
    letters = []
    for came in reversed(steps):
        state, letter = came[state]
        letters.append(letter)
    return "".join(reversed(letters))


_LISTS: dict[int, tuple[np.ndarray, list]] = {}


def _lists(model: np.ndarray) -> list:
    """The model as lists, which Python reads faster than an array; the last one is kept."""
    if id(model) not in _LISTS or _LISTS[id(model)][0] is not model:
        _LISTS.clear()
        _LISTS[id(model)] = (model, model.tolist())
    return _LISTS[id(model)][1]


_SPREAD = re.compile(r"(?<!\S)(?:[A-Za-z0-9@$!|+(€][ .*_-]+){2,}[A-Za-z0-9@$!|+(€](?![A-Za-z0-9])")
_REPEAT = re.compile(r"([a-z])\1\1")
_AGAIN = re.compile(r"(.)\1")
_EDGE = ".,;:!?\"'()[]{}<>*%&#~^_-=|/\\«»¿¡…"
_EDGE_NOISE = "".join(c for c in _EDGE if c not in STANDS_FOR)


class _Restored(dict):
    """The word as written and, if it differs, as restored, by written word; memory is bounded."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def __missing__(self, word: str) -> tuple[list[str], bool]:
        if len(self) >= words.MEMORY:
            self.clear()
        bare = word.strip(_EDGE).lower()
        whole = word.strip(_EDGE_NOISE).lower()
        signs = any(c in STANDS_FOR for c in whole)
        found = [bare]
        # Signs at an edge may be letters or punctuation: both readings count.
        for own in {bare, whole} if signs or _AGAIN.search(bare) else ():
            restored_word = decode(own, self.model)
            if restored_word and restored_word not in found:
                found.append(restored_word)
        swapped = any("a" <= c <= "z" for c in bare) and any(c in STANDS_FOR for c in bare)
        value = self[word] = (found, swapped or bool(_REPEAT.search(bare)))
        return value


def restored(text: str | None, known: _Restored) -> tuple[list[str], int]:
    """Words of a text as written and restored, and how many were distorted."""
    if not text:
        return [], 0
    odd = 0
    extra = []
    for m in _SPREAD.finditer(text):
        joined = re.sub(r"[ .*_-]+", "", m[0])
        whole = decode(joined, known.model)
        extra += [whole, *(w for w in decode(joined, known.model, breaks=True).split() if w != whole)]
        odd += 1
    found = [known[w] for w in text.split()]
    return [w for own, _ in found for w in own] + extra, odd + sum(o for _, o in found)


def _word_rows(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = _Restored(model)
    for batch in batches:
        for part in words.slices(batch):
            found = [set(restored(t, known)[0]) for t in part["text"].to_pylist()]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part["label"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                    pa.array([w for f in found for w in f], pa.string()),
                ],
                names=["label", "word"],
            )


WIDTH = 8


def _features(
    batches: Iterator[pa.RecordBatch], model: np.ndarray, odds: dict[str, float]
) -> Iterator[pa.RecordBatch]:
    known = _Restored(model)
    for batch in batches:
        for part in words.slices(batch):
            rows = np.zeros((part.num_rows, WIDTH), np.float32)
            for i, text in enumerate(part["text"].to_pylist()):
                found, odd = restored(text, known)
                hits = [odds[w] for w in found if w in odds]
                good = [h for h in hits if h > 0]
                n = max(len(found), 1)
                rows[i] = (
                    max(good, default=0.0),
                    np.log1p(sum(good)),
                    len(good) / n,
                    np.log1p(len(good)),
                    sum(hits) / n,
                    min(hits, default=0.0),
                    np.log1p(len(found)),
                    odd / n,
                )
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * WIDTH), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays([part["doc_id"], vectors], names=["doc_id", "vector"])


def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch["vector"].flatten(), np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(net.score(x))], names=["doc_id", "score"])


def word_odds(counted: DataFrame, positives: int, negatives: int, most: int) -> dict[str, float]:
    """Log-odds of words that labels separate clearly, the clearest ``most`` of them."""
    p = (F.col("n1") + 0.5) / (positives + 1.0)
    q = (F.col("n0") + 0.5) / (negatives + 1.0)
    z = (F.col("n1") / max(positives, 1) - F.col("n0") / max(negatives, 1)) / F.sqrt(
        p * (1 - F.least(p, F.lit(0.999))) / max(positives, 1)
        + q * (1 - F.least(q, F.lit(0.999))) / max(negatives, 1)
    )
    clear = counted.where("n0 + n1 >= 3 and word <> ''").select("word", F.log(p / q).alias("odds"), z.alias("z"))
    clear = clear.where("abs(z) >= 3").orderBy(F.desc(F.abs("z")), "word").limit(most)
    return {r["word"]: r["odds"] for r in clear.collect()}


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    how: Toxicity = Toxicity(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (0 or 1).

    Null and empty texts have no words and are scored like any other; rows that
    share an id are scored one by one; a row without id is scored and never
    learned from. An empty table gives an empty result; without labels of both
    classes every score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark, "toxicity") as work:
        model = spark.sparkContext.broadcast(character_model(texts.select("text")))
        sample = work.table(label_sample(labels, how.label, how.sample), "sample")
        taught = texts.join(small(sample), "doc_id").select("label", "text")
        counted = work.table(
            taught.mapInArrow(lambda x: _word_rows(x, model.value), "label int, word string")
            .groupBy("word")
            .agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")),
            "counted",
        )
        positives, negatives = sample.agg(
            F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))
        ).first()
        odds = spark.sparkContext.broadcast(word_odds(counted, positives, negatives, how.lexicon))
        pooled = work.table(
            texts.mapInArrow(
                lambda x: _features(x, model.value, odds.value), "doc_id long, vector array<float>"
            ),
            "features",
        )
        learned = pooled.join(small(sample), "doc_id").dropDuplicates(["doc_id"])
        rows = sorted(learned.select("doc_id", "label", "vector").collect())
        x = np.array([r["vector"] for r in rows], float).reshape(-1, WIDTH)
        net = spark.sparkContext.broadcast(fit(x, np.array([r["label"] for r in rows], float), hidden=16))
        scored = pooled.mapInArrow(lambda x: _score(x, net.value), "doc_id long, score double").select(
            "doc_id",
            held_out().alias("held_out"),
            "score",
            (F.col("score") >= how.threshold).cast("int").alias("predicted"),
        )
        return work.table(scored, "scores", keep=True)
