"""Whitening of embeddings by spectral divide and conquer.

Method: tasks sum the vectors, then the products of the centred vectors, and send one
small matrix each. The driver holds that one matrix of dimension x dimension. The polar
factor of the shifted matrix (QDWH: dynamically weighted Halley steps) tells the
eigenvalues above the shift from those below it: half of the factor plus half of the
identity projects onto the upper invariant subspace. Each part is split again until it is
diagonal; parts that lie below the components asked for are left alone. The scaled
components go to the tasks, which whiten their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvebeacon.llm.common import scratch

#: Largest size of a scaled entry: batches of them still add up in 64 bits.
LARGEST = float(1 << 45)
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Whitening:
    """An entry c counts as floor(scale * c) + offset."""

    components: int = 8
    scale: int = 1024
    offset: int = 100_000


# ---- the matrix on the driver -----------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH.

    A zero singular value stays zero; the caller looks at that.
    """
    m = len(a)
    x = a / np.linalg.norm(a)
    low, eye = _EPS / 4, np.eye(m)
    for _ in range(40):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - l2) / (l2 * root), 0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        low = min(low * (p + q * l2) / (1 + r * l2), 1.0)
        if r > 100:  # ill-conditioned: by QR, without the inverse of a product
            tall = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            after = (q / r) * x + ((p - q / r) / np.sqrt(r)) * (tall[:m] @ tall[m:].T)
        else:
            after = (q / r) * x + (p - q / r) * np.linalg.solve(eye + r * (x @ x), x)
        after = (after + after.T) / 2
        change = np.linalg.norm(after - x)
        x = after
        if change < 1e-14 * np.sqrt(m) or (change < 1e-5 and low > 1 - 1e-14):
            break
    return x


def _bases(a: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """An orthogonal matrix whose first k columns span the upper invariant subspace."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    # The mean lies strictly between the extremes; an eigenvalue on the shift moves it.
    for step in (0.0, 0.11, -0.13, 0.29, -0.31, 0.47, -0.53):
        u = polar(a - (mean + step * spread) * np.eye(m))
        k = round((np.trace(u) + m) / 2)
        if 0 < k < m and np.linalg.norm(u @ u - np.eye(m)) < 1e-6:
            break
    else:
        raise ArithmeticError("no shift splits the spectrum")
    upper, lower = (np.eye(m) + u) / 2, (np.eye(m) - u) / 2
    parts = []
    for projector, size in ((upper, k), (lower, m - k)):
        basis = draw.normal(size=(m, size))
        for _ in range(3):
            basis = np.linalg.qr(projector @ basis)[0]
        parts.append(basis)
    return np.linalg.qr(np.hstack(parts))[0], k


def largest_components(
    a: np.ndarray, wanted: int, draw: np.random.Generator | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    draw = draw or np.random.default_rng(1)
    m = len(a)
    a = (a + a.T) / 2
    diagonal = np.diag(a).copy()
    if m == 1 or np.linalg.norm(a - np.diag(diagonal)) <= _EPS * np.linalg.norm(a):
        order = np.argsort(-diagonal, kind="stable")[:wanted]
        return diagonal[order], np.eye(m)[:, order]
    basis, k = _bases(a, draw)
    values, vectors = [], []
    for part in (basis[:, :k], basis[:, k:]):
        left = wanted - sum(map(len, values))
        if left > 0:
            e, v = largest_components(part.T @ a @ part, left, draw)
            values.append(e)
            vectors.append(part @ v)
    # Values again from the vectors, so that errors of the parts do not add up.
    v = np.hstack(vectors)
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


# ---- rows -------------------------------------------------------------------


def _scaled(cells: pa.ListArray, size: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Which cells are usable vectors of this size, and those as rows of integers."""
    sizes = pc.fill_null(pc.list_value_length(cells), 0)
    fits = np.asarray(pc.equal(sizes, size))
    flat = cells.filter(pa.array(fits)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)
    with np.errstate(invalid="ignore", over="ignore"):
        good = (np.abs(x * scale) < LARGEST).all(axis=1)
    fits[fits] = good
    return fits, np.floor(x[good] * scale).astype(np.int64) + offset


def _sums(how: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number and exact sums of the vectors of each size, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            cells = batch["e"]
            for size in set(pc.list_value_length(cells).drop_null().to_pylist()) - {0}:
                x = _scaled(cells, size, how.scale, how.offset)[1]
                if len(x):
                    n, s = found.get(size, (0, 0))
                    found[size] = (n + len(x), s + x.sum(axis=0).astype(object))
        rows = [(size, i, n, int(v)) for size, (n, s) in found.items() for i, v in enumerate(s)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "i", "n", "s"])

    return run


class _Centred:
    """n * x - sums, exact: in 64 bits where they hold it, else as Python integers."""

    def __init__(self, n: int, sums: list[int], how: Whitening):
        self.n, self.how, self.size = n, how, len(sums)
        self.middle = np.array([round(s / n) for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.middle, strict=True)]

    def rows(self, cells: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        fits, x = _scaled(cells, self.size, self.how.scale, self.how.offset)
        x = x - self.middle
        widest = int(np.abs(x).max(initial=0)) + 1
        if self.n * widest < 1 << 62:
            return fits, x * self.n - np.array(self.rest, np.int64)
        return fits, x.astype(object) * self.n - np.array(self.rest, object)

    def squares(self, z: np.ndarray) -> list[int]:
        """Sum of squares of each row."""
        if z.dtype != object and self.size * int(np.abs(z).max(initial=0)) ** 2 < 1 << 62:
            return np.einsum("ij,ij->i", z, z).tolist()
        exact = z.astype(object)
        return [int(v) for v in (exact * exact).sum(axis=1)]


def _products(centred: _Centred) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sum of products of centred vectors, upper triangle, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((centred.size, centred.size))
        for batch in batches:
            y = centred.rows(batch["e"])[1].astype(np.float64) / centred.n
            total += y.T @ y
        i, j = np.triu_indices(centred.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "p"]
        )

    return run


def _project(centred: _Centred, matrix: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, deviation and whitened values of the usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = matrix.shape[1]
        for batch in batches:
            fits, z = centred.rows(batch["e"])
            w = (z.astype(np.float64) / centred.n) @ matrix
            squares = centred.squares(z)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].filter(pa.array(fits)),
                    pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()),
                    pa.array(squares, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel())
                    ),
                ],
                names=["vec_id", "deviation", "deviation_exact", "w"],
            )

    return run


_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, eigenvalue double, deviation_exact decimal(38,0)"
)


def whiten(
    rows: DataFrame, how: Whitening = Whitening(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, ...

    Left out: vectors that are null, empty, hold null or non-finite entries or entries of
    2**45 / scale and more, and vectors whose length is not the most frequent one (of two
    equally frequent lengths the smaller counts). All others count, repeated rows and rows
    without id each for itself. There are as many components as asked for, but no more
    than the vectors have dimensions, and none whose variance is zero up to rounding: equal
    vectors, one vector or an empty table give an empty result. ``deviation`` is null where
    a long cannot hold it; ``deviation_exact`` always has it. Extra columns are not read.
    """
    spark = rows.sparkSession
    taken = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")
    )
    with scratch(spark, "whitening") as work:
        sums = work.table(
            taken.select("e")
            .mapInArrow(_sums(how), "size int, i int, n long, s decimal(38,0)")
            .groupBy("size", "i")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s")),
            "sums",
        )
        best = sums.where("i = 0").orderBy(F.desc("n"), "size").select("size", "n").first()
        if best is None:
            return spark.createDataFrame([], _RESULT)
        size, n = best
        found = {r["i"]: int(r["s"]) for r in sums.where(F.col("size") == size).collect()}
        centred = _Centred(n, [found[i] for i in range(size)], how)
        products = (
            taken.select("e")
            .mapInArrow(_products(centred), "i int, j int, p double")
            .groupBy("i", "j")
            .agg(F.sum("p").alias("p"))
            .collect()
        )
        variance = np.zeros((size, size))
        for i, j, p in products:
            variance[i, j] = variance[j, i] = p / n
        values, vectors = largest_components(variance, how.components)
        real = values > max(values.max(initial=0), 0) * size * 8 * _EPS
        values, vectors = values[real], vectors[:, real]
        if not len(values):
            return spark.createDataFrame([], _RESULT)
        white = work.table(
            taken.mapInArrow(
                _project(centred, vectors / np.sqrt(values)),
                "vec_id long, deviation long, deviation_exact decimal(38,0), w array<double>",
            ),
            "white",
            keep=True,
        )
        pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
        measured = white.agg(
            *[
                F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)).alias(f"c{i}_{j}")
                for i, j in pairs
            ]
        ).first()
        # Divided like a share of variance: the trace counts all dimensions.
        parts = F.array(*[F.lit(float(v)) for v in values / np.trace(variance)])
        return white.select("*", F.posexplode("w").alias("at", "whitened")).select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            parts[F.col("at")].alias("explained"),
            F.lit(float(max(measured))).alias("identity_error"),
            F.array(*[F.lit(float(v)) for v in values])[F.col("at")].alias("eigenvalue"),
            "deviation_exact",
        )
