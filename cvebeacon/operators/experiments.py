"""All source experiments from one pass over the training rows.

The features of an experiment are those of the full row, switched on or off by
the row's sources. So the weighted sums X'X and X'y of every experiment are
made of one small matrix per set of sources: one scan gathers those, the driver
solves the ridge fits, a second scan scores the test rows under all of them.
The driver holds matrices of the number of features, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.operators.features import FeatureConfig, assemble_features, category_table, mentions_source
from cvebeacon.operators.metrics import BATCH, THRESHOLD, element_loss, is_high
from cvebeacon.operators.ordering import running_totals_by, shuffled_index
from cvebeacon.operators.training import (
    SEED,
    drop_unscored,
    experiments,
    invert_target,
    sample_weight,
    split,
    transform_target,
)
from cvebeacon.session import materialize


@dataclass(frozen=True)
class GramConfig:
    """``ridge`` is a share of the total weight; predictions are rounded to ``digits``.

    Rounding makes rows with equal features tie whatever the order of summation.
    """

    target: str = "logit"
    alpha: float = 1.0
    threshold: float = THRESHOLD
    ridge: float = 1e-4
    digits: int = 9
    seed: int = SEED


def source_mask(source: Column, names: tuple[str, ...]) -> Column:
    """One bit per source name the row mentions."""
    mask = F.lit(0)
    for i, name in enumerate(names):
        mask = mask + mentions_source(source, name).cast("int") * (1 << i)
    return mask


# ---- sums -------------------------------------------------------------------


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sum(w z z') per mask, z being features, 1 and target; once for each task."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        z = np.column_stack([x, np.ones(batch.num_rows), batch["y"].to_numpy(zero_copy_only=False)])
        w, masks = (batch[c].to_numpy(zero_copy_only=False) for c in ("w", "mask"))
        for mask in np.unique(masks):
            part = z[masks == mask]
            total = totals.setdefault(int(mask), np.zeros((z.shape[1], z.shape[1])))
            total += (part * w[masks == mask, None]).T @ part
    rows = [(mask, i, row) for mask, total in totals.items() for i, row in enumerate(total)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.list_(pa.float64())),
        ],
        names=["mask", "i", "row"],
    )


def gram_matrices(rows: DataFrame) -> dict[int, np.ndarray]:
    """Weighted sums of products per mask; ``rows`` has mask, x (array), y, w."""
    summed = (
        rows.select("mask", "x", "y", "w")
        .mapInArrow(_partial_sums, "mask int, i int, row array<double>")
        .groupBy("mask", "i")
        .agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    )
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in summed.collect():
        found.setdefault(r["mask"], {})[r["i"]] = r["row"].toArray()
    return {m: np.stack([part[i] for i in range(len(part))]) for m, part in found.items()}


# ---- layouts and fits ---------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Columns of one experiment: place in the full row and the bits that switch it on (0: always)."""

    base: np.ndarray
    bits: np.ndarray

    def active(self, mask: int) -> np.ndarray:
        return (self.bits == 0) | ((self.bits & mask) != 0)


def layout(features: FeatureConfig, size: int) -> Layout:
    """``size`` features of the full row, then its constant 1.

    All sources on: one block per text. Otherwise a block per enabled source.
    """
    bit = {n: 1 << i for i, n in enumerate(features.all_sources)}
    base, bits = [], []
    texts = [features.text, features.description]
    at = 0
    for on in texts:
        if on:
            block = range(at, at + features.vector_size)
            for b in [bit[n] for n in features.sources] if features.per_source_blocks else [0]:
                base += block
                bits += [b] * len(block)
            at += features.vector_size
    base += range(at, size)
    bits += [0] * (size - at)
    base += [size] * (len(features.sources) + 1)
    bits += [bit[n] for n in features.sources] + [0]
    return Layout(np.array(base), np.array(bits))


def ridge_fit(grams: dict[int, np.ndarray], columns: Layout, ridge: float) -> np.ndarray:
    """Coefficients of the layout's columns; the last one, the intercept, is not shrunk."""
    k = len(columns.base)
    a, b, weight = np.zeros((k, k)), np.zeros(k), 0.0
    for mask, gram in grams.items():
        on = np.flatnonzero(columns.active(mask))
        at = columns.base[on]
        a[np.ix_(on, on)] += gram[np.ix_(at, at)]
        b[on] += gram[at, -1]
        weight += gram[-2, -2]
    if weight == 0:
        return np.zeros(k)
    a[np.arange(k - 1), np.arange(k - 1)] += ridge * weight
    return np.linalg.solve(a, b)


def _scorer(weights: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Raw predictions of all experiments; ``weights`` holds features x experiments per mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            masks = batch["mask"].to_numpy(zero_copy_only=False)
            raw = np.zeros((n, next(iter(weights.values())).shape[1]))
            for mask in np.unique(masks):
                at = masks == mask
                raw[at] = x[at] @ weights[int(mask)][:-1] + weights[int(mask)][-1]
            kept = [batch[c] for c in batch.schema.names if c not in ("x", "mask")]
            names = [c for c in batch.schema.names if c not in ("x", "mask")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(list(raw), pa.list_(pa.float64()))], names=[*names, "raw"])

    return run


# ---- evaluation -----------------------------------------------------------------


def evaluate_runs(scored: DataFrame, keys: list[str], names: list[str], config: GramConfig) -> DataFrame:
    """One row per experiment: test_rows, test_loss, r2, pr_auc.

    ``scored`` has the keys, ``epss_score`` and ``raw``, an array by experiment.
    The batches of the loss are the same for all.
    """
    batched = shuffled_index(scored, keys, config.seed).withColumn("batch", F.floor(F.col("row_index") / BATCH))
    each = batched.select(
        "batch", "epss_score", F.posexplode("raw").alias("run", "raw")
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), invert_target(F.col("raw"), config.target)))
    each = materialize(each.withColumn("predicted", F.round(bounded, config.digits)).drop("raw"), "runs")
    actual, predicted = F.col("epss_score"), F.col("predicted")
    spaced = element_loss(transform_target(actual, config.target), transform_target(predicted, config.target))
    error = predicted - actual
    # One row per batch holds the sums of both measures.
    batches = each.groupBy("run", "batch").agg(
        F.avg(spaced * sample_weight(actual, config.alpha, config.threshold)).alias("loss"),
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("residual"),
        F.sum("epss_score").alias("s"),
        F.sum(actual * actual).alias("q"),
    )
    sums = batches.groupBy("run").agg(
        F.avg("loss").alias("test_loss"),
        F.sum("n").alias("test_rows"),
        F.sum("residual").alias("residual"),
        F.sum("q").alias("q"),
        (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("spread"),
    )
    constant = F.when(F.col("residual") == 0, 1.0).otherwise(0.0)
    r2 = (
        F.when(F.col("test_rows") < 2, None)
        .when(F.col("spread") <= 1e-13 * F.col("q"), constant)
        .otherwise(1 - F.try_divide("residual", "spread"))
    )
    by_score = each.groupBy("run", "predicted").agg(
        F.sum(is_high(actual, config.threshold)).alias("positives"), F.count(F.lit(1)).alias("rows")
    )
    ranked = running_totals_by(by_score, "run", "predicted", ["positives", "rows"], descending=True)
    before, hits = F.col("running_rows") - F.col("rows"), F.col("running_positives") - F.col("positives")
    precision = F.col("running_positives") / F.col("running_rows")
    precision_before = F.when(before == 0, 1.0).otherwise(F.try_divide(hits, before))
    area = ranked.groupBy("run").agg(
        F.sum(F.try_divide("positives", "total_positives") * (precision + precision_before) / 2).alias("area"),
        F.max("total_positives").alias("p"),
        F.max("total_rows").alias("n"),
    )
    title = F.array(*map(F.lit, names))[F.col("run")]
    # As many rows as experiments.
    return sums.join(F.broadcast(area), "run").select(
        title.alias("experiment"),
        "test_rows",
        "test_loss",
        r2.alias("r2"),
        F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("area")).alias("pr_auc"),
    )


def experiment_runs(
    df: DataFrame,
    keys: list[str],
    features: FeatureConfig = FeatureConfig(),
    config: GramConfig = GramConfig(),
    runs: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per experiment: experiment, features, train_rows, test_rows, test_loss, r2, pr_auc.

    All experiments see the same rows and the same split; only their features
    differ. Rows without a score are left out; rows of the split ``validation``
    take no part in a closed-form fit.
    """
    runs = runs or experiments(features.all_sources)
    table = materialize(split(materialize(drop_unscored(df), "scored"), keys), "split")
    categories = category_table(table) if features.cvss_categorical else None
    full = assemble_features(table, replace(features, sources=()), categories)
    score = F.col("epss_score")
    rows = materialize(
        full.select(
            *keys,
            "split",
            "epss_score",
            source_mask(F.col("source"), features.all_sources).alias("mask"),
            vector_to_array("features").alias("x"),
            transform_target(score, config.target).alias("y"),
            sample_weight(score, config.alpha, config.threshold).alias("w"),
        ).filter("split <> 'validation'"),
        "rows",
    )
    masks = rows.groupBy("mask").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.max(F.size("x")).alias("size")
    ).collect()  # one row per set of sources
    if not masks:
        raise ValueError("no scored rows")
    size = masks[0]["size"]
    grams = gram_matrices(rows.filter("split = 'train'"))
    weights = {r["mask"]: np.zeros((size + 1, len(runs))) for r in masks}
    sizes = []
    for at, enabled in enumerate(runs.values()):
        columns = layout(replace(features, sources=enabled), size)
        found = ridge_fit(grams, columns, config.ridge)
        sizes.append(len(columns.base) - 1)
        for mask, matrix in weights.items():
            on = columns.active(mask)
            np.add.at(matrix[:, at], columns.base[on], found[on])
    test = rows.filter("split = 'test'").select(*keys, "epss_score", "mask", "x")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in test.schema if f.name not in ("mask", "x"))
    scored = materialize(test.mapInArrow(_scorer(weights), f"{kinds}, raw array<double>"), "predicted")
    evaluated = evaluate_runs(scored, keys, list(runs), config)
    place = F.array_position(F.array(*map(F.lit, runs)), F.col("experiment")).cast("int") - 1
    return evaluated.select(
        "experiment",
        F.array(*map(F.lit, sizes))[place].cast("long").alias("features"),
        F.lit(sum(r["train"] for r in masks)).cast("long").alias("train_rows"),
        "test_rows",
        "test_loss",
        "r2",
        "pr_auc",
    )
