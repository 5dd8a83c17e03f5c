"""Nearest neighbours by learned partitions of a neighbour graph.

Method: on a bounded sample the graph of nearest neighbours is cut by recursive
bisection into partitions of equal size, so that few neighbours are parted. A
small network learns from a vector the share of its neighbours in each partition.
Every row is indexed in the partition the network finds likeliest; a query goes to
the likeliest partitions, as many as reach the target recall on the sample, and
is ranked against all their rows by exact inner products.

Hot partitions are cut into blocks of rows and of queries, so no task holds a
whole partition, and no row is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.llm.common import scratch
from cvebeacon.llm.vectors import dimension_column, in_order, unpack, usable


@dataclass(frozen=True)
class LearnedSearch:
    """``sample`` bounds the rows of the fit; everything else covers all rows."""

    k: int = 20
    every: int = 20
    sample: int = 12_000
    partition_rows: int = 250
    most: int = 64
    recall: float = 0.97
    hidden: int = 128
    row_block: int = 16_384
    query_block: int = 4_096
    seed: int = 9


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k others with the largest inner product."""
    found = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        score = x[lo : lo + 1024] @ x.T
        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = -np.inf
        found[lo : lo + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return found


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Partition of each row: halves of the graph, halved again, by smoothed directions.

    Values start from the direction of largest spread and are averaged over
    neighbours, which nears the graph's second eigenvector; the median cuts.
    """
    random = np.random.default_rng(seed)
    label = np.zeros(len(x), np.int64)
    level = 1
    while level < parts:
        after = np.empty_like(label)
        for own in range(level):
            at = np.flatnonzero(label == own)
            inside = np.full(len(x), -1)
            inside[at] = np.arange(len(at))
            near = inside[graph[at]]
            known = near >= 0
            y = x[at] - x[at].mean(axis=0)
            v = random.normal(size=y.shape[1])
            for _ in range(15):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-30
            value = y @ v
            for _ in range(30):
                pulled = np.where(known, value[near], 0).sum(axis=1) + value
                pulled /= known.sum(axis=1) + 1
                value = pulled - pulled.mean()
                value /= np.abs(value).max() + 1e-30
            order = np.argsort(value, kind="stable")
            half = np.empty(len(at), np.int64)
            half[order] = np.arange(len(at)) * 2 // max(len(at), 1)
            after[at] = own * 2 + half
        label, level = after, level * 2
    return label


class Router:
    """Two layers and a softmax over partitions, fitted with Adam."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int, seed: int, epochs: int = 40):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self.inputs(x)
        d, p = z.shape[1], target.shape[1]
        self.w = [
            random.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden),
            random.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p),
        ]
        first, second = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(len(z)), max(1, len(z) // 256)):
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                delta = (softmax(h @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = delta @ self.w[2].T * (h > 0)
                slopes = [z[rows].T @ back, back.sum(0), h.T @ delta, delta.sum(0)]
                step += 1
                for i, slope in enumerate(slopes):
                    slope = slope + 1e-5 * self.w[i]
                    first[i] = 0.9 * first[i] + 0.1 * slope
                    second[i] = 0.999 * second[i] + 0.001 * slope * slope
                    rate = 0.002 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.w[i] = self.w[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, likeliest first."""
        h = np.maximum(self.inputs(x) @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, how: LearnedSearch) -> tuple[Router | None, int, int]:
    """The router, the number of partitions, and how many of them a query visits.

    A quarter of the sample is held back: its neighbours' partitions, as the
    router assigns them, give the recall for each number of visits.
    """
    parts = 1
    while parts * 2 <= how.most and len(x) // (parts * 2) >= how.partition_rows:
        parts *= 2
    if parts == 1:
        return None, 1, 1
    graph = neighbour_graph(x, how.k)
    label = balanced_partitions(x, graph, parts, how.seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), how.k), label[graph].ravel()), 1 / how.k)
    held = np.arange(len(x)) % 4 == 0
    router = Router(x[~held], target[~held], how.hidden, how.seed)
    order = router.order(x)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    needed = rank[np.flatnonzero(held)[:, None], order[:, 0][graph[held]]]
    reached = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    visits = int(np.argmax(reached >= how.recall)) + 1 if (reached >= how.recall).any() else parts
    return router, parts, visits


def _nearest(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k rows nearest to each query of the block, ties to the smaller id."""
    names = ["query_id", "vec_id", "score"]
    out: list[list] = [[], [], []]
    if queries.num_rows and rows.num_rows:
        q, x = (unpack(t["v"].to_pylist()) for t in (queries, rows))
        asked, ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        slack = 1e-12 * np.abs(x).max() * x.shape[1]
        for lo in range(0, len(q), 256):
            score = q[lo : lo + 256] @ x.T
            score[asked[lo : lo + 256, None] == ids[None, :]] = -np.inf
            least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else None
            for i, own in enumerate(score):
                near = np.isfinite(own)
                if least is not None and np.isfinite(least[i]):
                    near &= own >= least[i] - slack * np.abs(q[lo + i]).max()
                at = np.flatnonzero(near)
                exact = in_order(np.broadcast_to(q[lo + i], (len(at), x.shape[1])), x[at])
                best = np.lexsort((ids[at], -exact))[:k]
                out[0].append(np.full(len(best), asked[lo + i]))
                out[1].append(ids[at[best]])
                out[2].append(exact[best])
    columns = [np.concatenate(o) if o else [] for o in out]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def search(
    rows: DataFrame,
    how: LearnedSearch = LearnedSearch(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The nearest rows of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``. Null, zero and
    non-finite vectors and rows without id take no part; vectors are compared
    with those of equal length only; rows that share an id are one vector, the
    smallest. Ties go to the smaller id. Extra columns are not read. An empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    with scratch(spark, "learned-search") as work:
        known = work.table(
            usable(rows, id_col, vector_col).select("vec_id", "v", dimension_column().alias("dim")), "vectors"
        )
        drawn = known.orderBy(F.xxhash64("vec_id", F.lit(how.seed)), "vec_id").limit(how.sample)
        drawn = drawn.select("dim", "v").toArrow()
        routers = {}
        for dim in set(drawn["dim"].to_pylist()):
            own = drawn.filter(pa.compute.equal(drawn["dim"], dim))
            routers[dim] = fit_router(unpack(own["v"].to_pylist()), how)
        shared = spark.sparkContext.broadcast(routers)

        def route(batches):
            for batch in batches:
                dims = np.asarray(batch["dim"])
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    # Lengths that the sample missed have one partition.
                    router, _, visits = shared.value.get(int(dim), (None, 1, 1))
                    if router is None:
                        order, visits = np.zeros((part.num_rows, 1), np.int32), 1
                    else:
                        order = router.order(unpack(part["v"].to_pylist())).astype(np.int32)
                    visited = pa.array(list(order[:, :visits]), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [part["vec_id"], part["v"], part["dim"], pa.array(order[:, 0]), visited],
                        names=["vec_id", "v", "dim", "part", "visits"],
                    )

        routed = work.table(
            known.mapInArrow(route, "vec_id long, v binary, dim int, part int, visits array<int>"), "routed"
        )
        asked = routed.where(F.pmod("vec_id", F.lit(how.every)) == 0).select(
            "vec_id", "v", "dim", F.explode("visits").alias("part")
        )
        # Block counts of each partition: a table of at most ``most`` rows for each length.
        sizes = routed.groupBy("dim", "part").agg(F.ceil(F.count("*") / how.row_block).alias("blocks"))
        groups = asked.groupBy("dim", "part").agg(F.ceil(F.count("*") / how.query_block).alias("groups"))
        shape = work.table(sizes.join(groups, ["dim", "part"]), "shape")
        hashed = F.xxhash64("vec_id")
        left = asked.join(shape, ["dim", "part"]).select(
            F.col("dim").alias("dim"), F.col("part").alias("part"), F.pmod(hashed, F.col("groups")).alias("g"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
            F.col("vec_id").alias("vec_id"), F.col("v").alias("v"),
        )
        right = routed.join(shape, ["dim", "part"]).select(
            "dim", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"),
            F.pmod(hashed, F.col("blocks")).alias("b"), "vec_id", "v",
        )
        keys = ["dim", "part", "g", "b"]
        near = (
            left.groupBy(keys)
            .cogroup(right.groupBy(keys))
            .applyInArrow(
                lambda x, y: _nearest(x, y, how.k), "query_id long, vec_id long, score double"
            )
        )
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        result = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= how.k)
        return work.table(result.select("query_id", "rank", "vec_id", "score"), "result", keep=True)
