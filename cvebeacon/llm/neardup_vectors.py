"""Embedding near-duplicates: a neighbour graph refined by NN-descent.

Method: equal vectors are one node. The first neighbour lists come from random
hyperplane codes: nodes are sorted by code, and those next to each other whose
sketches are near are scored. NN-descent then joins each node's neighbours with
one another, scores the new pairs and keeps the nearest; lists whose every entry is
above the threshold are saturated and enlarged. Edges above the threshold give
components.

Exact finish: lists are bounded, so in dense groups the descent may miss the only
link of a node. Nodes are dealt to the nearest of some pivots; a node is also a
guest in every cell whose border is within the threshold's distance. Own nodes and
guests of a cell are compared block against block, and links between components
are added, so components are exact whatever the descent has found.

Counting: all links of a node lie inside its component, so links are counted there
exactly, block against block in numpy; only counts leave a task, never the pairs.

Codes of b bits in T tables: a pair at the threshold differs in a bit with
probability angle / pi, and T is set so that it is missed in all tables with
probability below ``miss``, as far as a code is shared by few. Sketches of 256 bits drop pairs more than seven
standard deviations from what the threshold allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm.common import Scratch, scratch, small
from cvebeacon.llm.components import components
from cvebeacon.llm.vectors import dimension_column, in_order, unit, unpack, usable

SKETCH = 256


@dataclass(frozen=True)
class NearVectors:
    """``neighbours`` is the first list size; ``pivots`` the most cells of a label."""

    threshold: float = 0.98
    neighbours: int = 8
    largest: int = 32
    beside: int = 4
    miss: float = 1e-7
    descents: int = 3
    pivots: int = 256
    block: int = 4096
    seed: int = 3

    def differing(self) -> float:
        return math.acos(self.threshold) / math.pi

    def sketch_limit(self) -> int:
        p = self.differing()
        return int(SKETCH * p + 7 * math.sqrt(SKETCH * p * (1 - p))) + 1


def _codes(
    batches: Iterator[pa.RecordBatch], how: NearVectors, bits: int, tables: int, seed: int
) -> Iterator[pa.RecordBatch]:
    """For each node and table: the code of its hyperplane sides, a position, a sketch."""
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        dims = np.asarray(batch["dim"])
        for d in np.unique(dims):
            if d not in planes:
                random = np.random.default_rng([how.seed, seed, int(d)])
                planes[d] = random.normal(size=(d, tables * (bits + 1))), random.normal(size=(d, SKETCH))
            part = batch.filter(pa.array(dims == d))
            x = unit(unpack(part["v"].to_pylist()))
            side = (x @ planes[d][0]).reshape(len(x), tables, bits + 1)
            weights = 1 << np.arange(bits, dtype=np.int64)
            code = ((side[:, :, :bits] > 0) * weights).sum(axis=2)
            sketch = np.packbits(x @ planes[d][1] > 0, axis=1)
            at = np.repeat(np.arange(len(x)), tables)
            yield pa.RecordBatch.from_arrays(
                [
                    part["group"].take(pa.array(at)),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))),
                    pa.array(code.ravel()),
                    pa.array(side[:, :, bits].ravel()),
                    part["node"].take(pa.array(at)),
                    pa.array([s.tobytes() for s in sketch], pa.binary()).take(pa.array(at)),
                ],
                names=["group", "t", "code", "p", "node", "sketch"],
            )


def _adjacent(batches: Iterator[pa.RecordBatch], how: NearVectors) -> Iterator[pa.RecordBatch]:
    """Pairs next to each other in a sorted partition, of one code, with near sketches."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if tail is not None:
            table = pa.concat_tables([tail, table])
        n = table.num_rows
        fresh = n - batch.num_rows
        if not batch.num_rows:
            continue
        code, t, node = (np.asarray(table[c].combine_chunks()) for c in ("code", "t", "node"))
        group = np.asarray(table["group"].combine_chunks())
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, -1)
        a, b = [], []
        for step in range(1, how.beside + 1):
            if n <= step:
                break
            same = (code[step:] == code[:-step]) & (t[step:] == t[:-step]) & (group[step:] == group[:-step])
            # Pairs within the rows kept from the last batch were made then.
            same[: max(fresh - step, 0)] = False
            i = np.flatnonzero(same)
            apart = np.bitwise_count(sketch[i] ^ sketch[i + step]).sum(axis=1, dtype=np.int64)
            i = i[apart <= how.sketch_limit()]
            a.append(node[i]), b.append(node[i + step])
        tail = table.slice(max(n - how.beside, 0))
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cosine = np.empty(batch.num_rows)
            lengths = np.array([len(v) * 2 + (v[:1] == b"f") for v in batch["v_a"].to_pylist()])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                x, y = (unit(unpack(batch[c].take(pa.array(at)).to_pylist())) for c in ("v_a", "v_b"))
                cosine[at] = in_order(x, y)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(cosine)], names=["a", "b", "cosine"])


def _scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of one group with their cosine."""
    for x in ("a", "b"):
        own = nodes.select(F.col("node").alias(x), F.col("group").alias(f"g_{x}"), F.col("v").alias(f"v_{x}"))
        pairs = pairs.join(own, x)
    return pairs.where("g_a = g_b").mapInArrow(_cosines, "a long, b long, cosine double")


def _start(work: Scratch, nodes: DataFrame, how: NearVectors, bits: int, seed: int) -> DataFrame:
    """Scored pairs from the codes of one seed."""
    tables = max(1, math.ceil(math.log(how.miss) / math.log(1 - (1 - how.differing()) ** bits)))
    coded = nodes.select("group", F.lit(0).alias("t"), "node", "v", "dim").drop("t").mapInArrow(
        lambda x: _codes(x, how, bits, tables, seed),
        "group long, t int, code long, p double, node long, sketch binary",
    )
    keys = ["group", "t", "code", "p", "node"]
    beside = coded.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pairs = work.table(
        beside.mapInArrow(lambda x: _adjacent(x, how), "a long, b long").distinct(), "beside"
    )
    return work.table(_scored(pairs, nodes), "scored")


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """Nearest neighbours of every node, ``size`` at most, both ways, as (node, list, least)."""
    both = edges.selectExpr("inline(array(struct(a as node, b as other, cosine), struct(b as node, a as other, cosine)))")
    rank = F.expr("row_number() over (partition by node order by cosine desc, other)")
    near = both.withColumn("rank", rank).where(F.col("rank") <= size)
    return near.groupBy("node").agg(
        F.collect_list("other").alias("others"), F.min("cosine").alias("least"), F.count("*").alias("n")
    )


def _descend(
    work: Scratch, nodes: DataFrame, scored: DataFrame, placed: DataFrame, how: NearVectors
) -> DataFrame:
    """Pairs of neighbours of one node, in different components, with their cosine.

    Lists that are full of links are saturated: up to ``largest`` entries of them
    are used. Each node yields a bounded number of pairs.
    """
    lists = _lists(scored, how.largest)
    full = F.expr(f"filter(others, (x, i) -> i < {how.neighbours})")
    saturated = (F.col("n") >= how.neighbours) & (F.col("least") >= how.threshold)
    used = lists.select(F.when(saturated, F.col("others")).otherwise(full).alias("others"))
    pairs = used.select(
        F.expr(
            "flatten(transform(others, (x, i) -> transform(slice(others, i + 2, size(others)),"
            " y -> struct(least(x, y) as a, greatest(x, y) as b))))"
        ).alias("pairs")
    ).selectExpr("inline(pairs)")
    for x in ("a", "b"):
        own = placed.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        pairs = pairs.join(own, x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    fresh = pairs.where("c_a <> c_b").select("a", "b").distinct()
    fresh = fresh.join(scored.select("a", "b"), ["a", "b"], "left_anti")
    return work.table(_scored(fresh, nodes), "descent")


def _cells(
    batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], how: NearVectors
) -> Iterator[pa.RecordBatch]:
    """Every node in the cell of its nearest pivot, and as a guest in earlier cells it may reach.

    Of x in cell p and a linked y in cell q: (y, q - p) exceeds (x, q - p), which is
    at most 0, by no more than the distance of x and y times that of the pivots.
    """
    reach = math.sqrt(max(2 - 2 * how.threshold, 0))
    for batch in batches:
        if not batch.num_rows:
            continue
        dims = np.asarray(batch["dim"])
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            cell = np.zeros(part.num_rows, np.int64)
            i = j = np.zeros(0, np.int64)
            if d in pivots:
                own = pivots[d]
                side = unit(unpack(part["v"].to_pylist())) @ own.T
                cell = side.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
                near = side.max(axis=1)[:, None] - side <= reach * apart[cell] + 1e-6
                near &= np.arange(len(own))[None, :] < cell[:, None]
                i, j = np.nonzero(near)
            at = pa.array(np.concatenate([np.arange(part.num_rows), i]))
            yield pa.RecordBatch.from_arrays(
                [
                    part["group"].take(at),
                    pa.array(np.concatenate([cell, j]).astype(np.int32)),
                    pa.array(np.arange(len(at)) >= part.num_rows),
                    part["node"].take(at),
                    part["component"].take(at),
                    part["v"].take(at),
                ],
                names=["group", "cell", "guest", "node", "component", "v"],
            )


def _joining(left: pa.Table, right: pa.Table, how: NearVectors) -> pa.Table:
    """Links of one block with another that join components, a spanning forest of them."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        x, y = (unit(unpack(t["v"].to_pylist())) for t in (left, right))
        own, other = left["node"].to_numpy(), right["node"].to_numpy()
        mine, theirs = (t["component"].to_numpy().copy() for t in (left, right))
        for lo in range(0, len(x), 512):
            cosine = x[lo : lo + 512] @ y.T
            near = (cosine >= how.threshold - 1e-12) & (mine[lo : lo + 512, None] != theirs[None, :])
            for i in np.flatnonzero(near.any(axis=1)):
                j = np.flatnonzero(near[i] & (theirs != mine[lo + i]))
                # Sums in another order may differ in the last bits: decide those by one order.
                close = np.flatnonzero(cosine[i, j] < how.threshold + 1e-12)
                low = in_order(np.repeat(x[lo + i][None, :], len(close), axis=0), y[j[close]]) < how.threshold
                j = np.delete(j, close[low])
                if not len(j):
                    continue
                joined, first = np.unique(theirs[j], return_index=True)
                a += [own[lo + i]] * len(joined)
                b += list(other[j[first]])
                joined = np.append(joined, mine[lo + i])
                for places in (mine, theirs):
                    places[np.isin(places, joined)] = joined.min()
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _finish(work: Scratch, placed_nodes: DataFrame, nodes: DataFrame, n: int, how: NearVectors) -> DataFrame:
    """Links that join all components with a link between them, as a table (a, b)."""
    most = min(how.pivots, math.ceil(n / how.block))
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(how.seed)), "node").limit(most).select("dim", "v").collect()
    pivots = {
        d: unit(unpack([bytes(r["v"]) for r in drawn if r["dim"] == d])) for d in {r["dim"] for r in drawn}
    }
    cells = work.table(
        placed_nodes.select("group", "dim", "node", "component", "v").mapInArrow(
            lambda x: _cells(x, pivots, how),
            "group long, cell int, guest boolean, node long, component long, v binary",
        ),
        "cells",
    )
    sizes = cells.groupBy("group", "cell").agg(
        F.ceil(F.count_if(~F.col("guest")) / how.block).alias("owns"),
        F.ceil(F.count_if("guest") / how.block).alias("guests"),
        F.min("component").alias("least"), F.max("component").alias("last"),
    )
    # Cells of one component have nothing to join; guests without own nodes meet in another cell.
    sizes = sizes.where("owns > 0 and least < last").select("group", "cell", "owns", "guests")
    members = work.table(
        cells.join(sizes, ["group", "cell"]).withColumn(
            "own", F.expr("pmod(xxhash64(node), if(guest, guests, owns)) + if(guest, owns, 0)")
        ),
        "cell-members",
    )
    at = ["group", "cell"]
    left = members.where("not guest").select(
        *at, F.col("own").alias("i"), F.explode(F.expr("sequence(own, owns + guests - 1)")).alias("j"),
        "node", "component", "v",
    )
    right = members.select(
        *at, F.explode(F.expr("sequence(0L, if(guest, owns - 1, own))")).alias("i"), F.col("own").alias("j"),
        "node", "component", "v",
    )
    keys = [*at, "i", "j"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(
        lambda x, y: _joining(x, y, how), "a long, b long"
    )
    return work.table(found.distinct(), "joining")


def _count(left: pa.Table, right: pa.Table, how: NearVectors) -> pa.Table:
    """Links of the nodes of one block with those of another, weighted by copies."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    x, y = (unit(unpack(t["v"].to_pylist())) for t in (left, right))
    weight = right["weight"].to_numpy()
    own, other = left["node"].to_numpy(), right["node"].to_numpy()
    total = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 512):
        cosine = x[lo : lo + 512] @ y.T
        near = cosine >= how.threshold
        # Sums in another order may differ in the last bits: decide those by one order.
        i, j = np.nonzero(np.abs(cosine - how.threshold) < 1e-12)
        near[i, j] = in_order(x[lo + i], y[j]) >= how.threshold
        near &= own[lo : lo + 512, None] != other[None, :]
        total[lo : lo + 512] = near @ weight
    return pa.table({"node": pa.array(own), "n": pa.array(total)})


def _placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    joined = nodes.join(found, "node", "left")
    return joined.withColumn("component", F.coalesce("component", "node"))


def near_vectors(
    rows: DataFrame,
    how: NearVectors = NearVectors(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors of equal label and length. Null, zero and non-finite
    vectors and vectors without label have none and are their own component;
    so have rows without id, whose component is null. Rows that share an id are
    one vector, that of the smallest label and components, and all get its
    result. Extra columns are not read. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    with scratch(spark, "near-vectors") as work:
        known = work.table(
            usable(rows, id_col, vector_col, label_col).withColumn("dim", dimension_column()),
            "vectors",
        )
        copies = work.table(
            known.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")),
            "copies",
        )
        nodes = work.table(
            copies.withColumn("group", F.xxhash64("label", "dim")).select("node", "group", "dim", "v", "weight"),
            "nodes",
        )
        n = nodes.count()
        bits = max(8, math.ceil(math.log2(max(n, 2))) - 3)
        scored = _start(work, nodes, how, bits, 0)
        links = scored.where(F.col("cosine") >= how.threshold).select("a", "b")
        placed = work.table(components(work, links), "components")
        for _ in range(how.descents):
            fresh = _descend(work, nodes, scored, placed, how)
            scored = work.table(scored.unionByName(fresh), "scored")
            won = fresh.where(F.col("cosine") >= how.threshold).select("a", "b")
            if won.isEmpty():
                break
            links = work.table(links.unionByName(won), "links")
            placed = work.table(components(work, links), "components")
        placed_nodes = work.table(_placed(nodes, placed), "placed")
        joining = _finish(work, placed_nodes, nodes, n, how)
        if not joining.isEmpty():
            links = work.table(links.unionByName(joining), "links")
            placed = work.table(components(work, links), "components")
            placed_nodes = work.table(_placed(nodes, placed), "placed")
        sizes = placed_nodes.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
        blocks = F.ceil(F.col("size") / how.block)
        members = placed_nodes.join(sizes, "component").select(
            "component", "node", "v", "weight", blocks.alias("blocks"),
            F.pmod(F.xxhash64("node"), blocks).alias("own"),
        )
        members = work.table(members, "members")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        left = members.select(
            F.col("component").alias("component"), F.col("own").alias("i"), F.explode(every).alias("j"),
            F.col("node").alias("node"), F.col("v").alias("v"), F.col("weight").alias("weight"),
        )
        right = members.select("component", F.explode(every).alias("i"), F.col("own").alias("j"), "node", "v", "weight")
        keys = ["component", "i", "j"]
        counted = (
            left.groupBy(keys)
            .cogroup(right.groupBy(keys))
            .applyInArrow(
                lambda x, y: _count(x, y, how), "node long, n long"
            )
            .groupBy("node")
            .agg(F.sum("n").alias("n"))
        )
        counted = work.table(
            placed_nodes.select("node", "component", "weight")
            .join(counted, "node", "left")
            .select("node", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
            "counted",
        )
        # A text of many copies has one row here, its copies find it by their vector.
        of = copies.where("weight > 1").select("label", "dim", "v", "node")
        alone = copies.where("weight = 1").select(F.col("node").alias("vec_id"), "node")
        several = known.join(of, ["label", "dim", "v"]).select("vec_id", "node")
        found = several.unionByName(alone).join(counted, "node").select(
            F.col("vec_id").alias("id"), F.col("component").alias("found"), F.col("n_links").alias("links")
        )
        found = work.table(found, "found")
        own = rows.select(F.col(id_col).cast("long").alias("vec_id"))
        result = own.join(found, own["vec_id"] == found["id"], "left").select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("found", "vec_id").alias("component_id"),
            F.expr("coalesce(found, vec_id) <=> vec_id").alias("kept"),
        )
        return work.table(result, "result", keep=True)
