"""MinHash near-duplicates: banded minima, full verification, components.

Method: each document's distinct word shingles go through many universal hash
functions; the minima form a signature that is cut into bands. Documents that
share a band are candidates, their signatures are compared, links are confirmed
on the full shingle sets, and connected components follow by alternating
large-star and small-star.

Hot groups: documents with equal sets are one node from the start. In a band
shared by many, each document is first compared with the smallest one only.
Documents of bands that hold more than one component after that meet by the rarest
of their shingles: similar sets share one of the first ``n - ceil(similarity * n) + 1``,
and what lies before it bounds what they share. So no pairs are lost, and a group of
thousands that resemble one another, but not enough, is not expanded into all pairs.

With 32 bands of 4 minima a pair at similarity 0.8 is missed with probability
(1 - 0.8^4)^32 < 1e-7. The signature filter drops pairs that agree in fewer than
0.62 of 128 minima, more than five standard deviations below 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm import lines, words
from cvebeacon.llm.common import Scratch, scratch, small
from cvebeacon.llm.components import components


@dataclass(frozen=True)
class MinHash:
    """Parameters: links need ``similarity`` as a fraction of whole numbers."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 32
    rows: int = 4
    least_agreement: float = 0.62
    seed: int = 7

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        draw = random.integers(0, 2**64, (2, self.bands * self.rows), np.uint64, endpoint=False)
        return draw[0] | np.uint64(1), draw[1]


def signature(distinct: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of all hash functions a*x+b over the set, as 32-bit values."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 4096):
        values = np.multiply.outer(a, distinct[at : at + 4096])
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_id", pa.binary()),
        ("signature", pa.binary()),
        ("bands", pa.list_(pa.int64())),
    ]
)


def _sign(batches: Iterator[pa.RecordBatch], how: MinHash) -> Iterator[pa.RecordBatch]:
    a, b = how.coefficients()
    salt = words.mix(np.arange(1, how.bands + 1, dtype=np.uint64))
    for batch in batches:
        for part in words.slices(batch):
            flat, counts = words.word_hashes(part["text"])
            values, number = words.shingles(flat, counts, how.words)
            sizes, ids, signatures, bands = [], [], [], []
            for doc in np.split(values, np.cumsum(number)[:-1]):
                distinct = np.unique(doc)
                sizes.append(len(distinct))
                if not len(distinct):
                    ids.append(None), signatures.append(None), bands.append(None)
                    continue
                own = signature(distinct, a, b)
                band = salt.copy()
                for row in own.astype(np.uint64).reshape(how.bands, how.rows).T:
                    band = words.mix(band * np.uint64(0x9E3779B97F4A7C15) + row)
                ids.append(words.set_id(distinct))
                signatures.append(own.tobytes())
                bands.append(band.view(np.int64))
            columns = [part["doc_id"], sizes, ids, signatures, bands]
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(columns, _SIGNED, strict=True)
                ],
                schema=_SIGNED,
            )


def _distinct(batches: Iterator[pa.RecordBatch], how: MinHash) -> Iterator[pa.RecordBatch]:
    """The set of each text beside its other columns."""
    for batch in batches:
        for part in words.slices(batch):
            flat, counts = words.word_hashes(part["text"])
            values, number = words.shingles(flat, counts, how.words)
            sets = [np.unique(x).tobytes() for x in np.split(values, np.cumsum(number)[:-1])]
            yield part.drop_columns(["text"]).append_column("elements", pa.array(sets, pa.binary()))


def _elements(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All sets in turn and their sizes."""
    sets = part["elements"].to_pylist()
    return np.frombuffer(b"".join(sets), np.uint64), np.array([len(x) // 8 for x in sets], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(lines.COUNTERS, np.int64)
    for batch in batches:
        for part in words.slices(batch, "elements"):
            at = (_elements(part)[0] % np.uint64(lines.COUNTERS)).astype(np.int64)
            seen += np.bincount(at, minlength=lines.COUNTERS)
    yield lines.counted(seen)


def _rarest(batches: Iterator[pa.RecordBatch], how: MinHash, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set, one of which every similar set shares."""
    for batch in batches:
        for part in words.slices(batch, "elements"):
            tokens, n = lines.rarest_first(*_elements(part), rank)
            size = np.minimum(lines.prefix_size(n, how), n)
            at = lines.ranges(np.cumsum(n) - n, size)
            owner = np.repeat(np.arange(len(n)), size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[at].view(np.int64)),
                    part["doc_id"].take(pa.array(owner)),
                    part["component"].take(pa.array(owner)),
                    pa.array(n[owner].astype(np.int32)),
                    pa.array((at - (np.cumsum(n) - n)[owner]).astype(np.int32)),
                ],
                names=["shingle", "doc_id", "component", "n", "i"],
            )


def _apart(work: Scratch, sets: DataFrame, how: MinHash) -> DataFrame:
    """Pairs of different components that may be similar, by their rarest shingles."""
    rank = work.spark.sparkContext.broadcast(lines.ranks(sets.select("elements").mapInArrow(_count, lines.COUNTED)))
    rare = work.table(
        sets.mapInArrow(
            lambda x: _rarest(x, how, rank.value), "shingle long, doc_id long, component long, n int, i int"
        ),
        "rare",
    )
    left, right = (
        rare.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "component", "n", "i")))
        for x in ("a", "b")
    )
    num, den = how.numerator, how.denominator
    # At their first shared shingle: they share none before it.
    near = F.expr(
        f"a_doc_id < b_doc_id and a_component <> b_component"
        f" and {num + den} * least(a_n - a_i, b_n - b_i) >= {num} * (a_n + b_n)"
    )
    found = left.join(right, "shingle").where(near)
    found = work.table(found.selectExpr("a_doc_id as a", "b_doc_id as b").distinct(), "apart")
    work.drop(rare)
    return found


def _agree(batches: Iterator[pa.RecordBatch], how: MinHash) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        pairs = zip(batch["sig_a"].to_pylist(), batch["sig_b"].to_pylist(), strict=True)
        keep = [
            np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32))
            >= how.least_agreement
            for x, y in pairs
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch], how: MinHash) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        pairs = zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist(), strict=True)
        for x, y in pairs:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            keep.append(how.denominator * both >= how.numerator * union)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _attach(pairs: DataFrame, values: DataFrame, column: str, name: str) -> DataFrame:
    """``pairs`` with the value of both sides as ``name``_a and ``name``_b."""
    for side in ("a", "b"):
        own = values.select(F.col("doc_id").alias(side), F.col(column).alias(f"{name}_{side}"))
        pairs = pairs.join(own, side)
    return pairs


def _likely(work: Scratch, pairs: DataFrame, nodes: DataFrame, how: MinHash) -> DataFrame:
    """The pairs whose signatures agree, as a table."""
    signed = _attach(pairs, nodes, "signature", "sig")
    return work.table(signed.mapInArrow(lambda x: _agree(x, how), "a long, b long"), "likely")


def _sets(work: Scratch, wanted: DataFrame, texts: DataFrame, how: MinHash) -> DataFrame:
    """The rows of ``wanted`` with the full set of their ``doc_id``, as a table."""
    found = texts.join(small(wanted), "doc_id").dropDuplicates(["doc_id"])
    others = [f for f in wanted.schema.fields if f.name != "doc_id"]
    schema = ", ".join(["doc_id long", *(f"{f.name} {f.dataType.simpleString()}" for f in others), "elements binary"])
    found = found.select("doc_id", *(f.name for f in others), "text")
    return work.table(found.mapInArrow(lambda x: _distinct(x, how), schema), "sets")


def _links(work: Scratch, likely: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """The pairs whose full sets pass, as a table; ``sets`` goes."""
    both = _attach(likely, sets, "elements", "set")
    links = work.table(both.mapInArrow(lambda x: _linked(x, how), "a long, b long"), "links")
    work.drop(sets)
    return links


def near_duplicates(
    docs: DataFrame, how: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``id_col`` is the integral key; rows that share an id are one node. Null and
    wordless texts have no shingles and are linked with nothing. A row without
    id is never linked: component_id is null and kept true. Other columns of
    ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark, "minhash") as work:
        signed = work.table(
            texts.mapInArrow(
                lambda x: _sign(x, how),
                "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>",
            ),
            "signed",
        )
        known = signed.where("doc_id is not null and set_id is not null")
        sets = work.table(
            known.groupBy("set_id").agg(F.min("doc_id").alias("node")), "equal-sets"
        )
        copies = known.select("set_id", F.col("doc_id").alias("a")).join(sets, "set_id")
        copies = work.table(
            copies.where("a <> node").select("a", F.col("node").alias("b")).distinct(), "copies"
        )
        # One row for each set: rows with the id of its smallest document.
        nodes = work.table(
            known.join(sets, "set_id").where("doc_id = node").dropDuplicates(["set_id"]).select(
                "doc_id", "signature", "bands"
            ),
            "nodes",
        )
        banded = nodes.select("doc_id", F.explode("bands").alias("band"))
        leaders = banded.groupBy("band").agg(
            F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")
        )
        leaders = work.table(leaders.where("leader < last").select("band", "leader"), "leaders")
        members = work.table(banded.join(leaders, "band"), "members")
        pairs = work.table(
            members.where("doc_id <> leader")
            .select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
            .distinct(),
            "pairs",
        )
        likely = _likely(work, pairs, nodes, how)
        wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        links = _links(work, likely, _sets(work, work.table(wanted, "wanted"), texts, how), how)

        # Candidates that are still apart: bands with more than one component.
        first = work.table(components(work, links.unionByName(copies)), "components")
        placed = members.join(
            first.withColumnRenamed("node", "doc_id"), "doc_id", "left"
        ).select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        mixed = placed.groupBy("band").agg(
            F.min("component").alias("low"), F.max("component").alias("high")
        )
        mixed = placed.join(mixed.where("low < high").select("band"), "band", "left_semi")
        mixed = work.table(mixed.select("doc_id", "component").distinct(), "mixed")
        sets = _sets(work, mixed, texts, how)
        apart = _apart(work, sets, how).join(pairs, ["a", "b"], "left_anti")
        more = _links(work, _likely(work, apart, nodes, how), sets, how)
        edges = links.unionByName(copies).unionByName(more)
        final = work.table(components(work, edges), "components")
        result = (
            signed.select("doc_id", "n_shingles")
            .join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select(
                "doc_id",
                "n_shingles",
                F.coalesce("component", "doc_id").alias("component_id"),
                F.expr("coalesce(component, doc_id) <=> doc_id").alias("kept"),
            )
        )
        return work.table(result, "result", keep=True)


def keep_one(docs: DataFrame, how: MinHash = MinHash(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that are not kept; all columns stay."""
    found = near_duplicates(docs, how, id_col)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(small(gone), docs[id_col] == F.col("__gone"), "left_anti")
