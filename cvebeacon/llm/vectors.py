"""Embedding columns as bytes, and numpy on them inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(
    rows: DataFrame, id_col: str, vector_col: str, label_col: str | None = None
) -> DataFrame:
    """vec_id, label (0 without a label column), v (little-endian doubles), one row per id.

    Left out: rows without id or label and vectors that are null, empty, zero or
    hold null or non-finite components. Of rows that share an id the one with the
    smallest label and vector counts.
    """
    vector = F.col(vector_col).cast("array<double>")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    taken = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    taken = taken.where(
        "vec_id is not null and label is not null and e is not null and size(e) > 0"
    ).where(~bad & F.exists("e", lambda x: x != 0))
    packed = taken.mapInArrow(_pack, "vec_id long, label string, v binary")
    return packed.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.asarray(e.values, "<f8").tobytes() for e in batch["e"]]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], pa.array([_narrow(x) for x in packed], pa.binary())],
            names=["vec_id", "label", "v"],
        )


def _narrow(raw: bytes) -> bytes:
    """Single precision if that loses nothing, marked by one byte more."""
    x = np.frombuffer(raw, "<f8")
    with np.errstate(over="ignore"):
        y = x.astype("<f4")
    return b"f" + y.tobytes() if np.array_equal(y.astype("<f8"), x) else b"d" + raw


def unpack(values: list[bytes]) -> np.ndarray:
    """The vectors as rows of doubles; all must have the same length."""
    if not values:
        return np.zeros((0, 0))
    if all(v[:1] == b"f" for v in values) and len({len(v) for v in values}) == 1:
        joined = np.frombuffer(b"".join(v[1:] for v in values), "<f4")
        return joined.reshape(len(values), -1).astype(np.float64)
    return np.stack([np.frombuffer(v[1:], "<f4" if v[:1] == b"f" else "<f8").astype(np.float64) for v in values])


def dimension(v: bytes) -> int:
    return (len(v) - 1) // (4 if v[:1] == b"f" else 8)


def dimension_column(v: str = "v"):
    width = F.when(F.substring(v, 1, 1) == F.lit(b"f"), 4).otherwise(8)
    return ((F.octet_length(v) - 1) / width).cast("int")


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(in_order(x, x))[:, None]
