"""Targets, weights, splits, batches and the regression."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.operators.features import (
    SOURCES,
    FeatureConfig,
    assemble_features,
    category_table,
    mentions_source,
)
from cvebeacon.operators.metrics import THRESHOLD, batch_loss, pr_auc, r_squared
from cvebeacon.operators.ordering import first_fraction, shuffled_index
from cvebeacon.session import materialize

SEED = 42
BATCH = 128
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.1
_EDGE = 1e-6


def drop_unscored(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["epss_score"])


# ---- targets and weights --------------------------------------------------


def transform_target(score: Column, kind: str = "identity") -> Column:
    if kind == "identity":
        return score
    if kind == "log1p":
        return F.log1p(score)
    if kind == "logit":
        clipped = F.greatest(F.least(score, F.lit(1 - _EDGE)), F.lit(_EDGE))
        # greatest and least skip NULLs; a missing score stays missing
        return F.when(score.isNotNull(), F.log(clipped / (1 - clipped)))
    raise ValueError(f"unknown target transform {kind!r}; known: identity, log1p, logit")


def invert_target(value: Column, kind: str = "identity") -> Column:
    if kind == "identity":
        return value
    if kind == "log1p":
        return F.expm1(value)
    if kind == "logit":
        return 1 / (1 + F.exp(-value))
    raise ValueError(f"unknown target transform {kind!r}; known: identity, log1p, logit")


def sample_weight(raw_score: Column, alpha: float = 1.0, threshold: float = THRESHOLD) -> Column:
    return F.lit(1.0) + F.lit(float(alpha)) * (raw_score >= threshold).cast("double")


# ---- splits and batches ---------------------------------------------------


def split(
    df: DataFrame,
    keys: list[str],
    seed: int = SEED,
    test_fraction: float = TEST_FRACTION,
    validation_fraction: float = VALIDATION_FRACTION,
) -> DataFrame:
    """Add ``split``: test only from rows with status ``original``, the rest train/validation.

    Held-out parts have ceil(fraction * n) rows. The frame is read several
    times, so pass a stored table.
    """
    original = F.coalesce(F.col("epss_status") == "original", F.lit(False))
    is_test = first_fraction(df, keys, seed, test_fraction, original)
    marked = df.withColumn("split", F.when(is_test, "test"))
    rest = F.col("split").isNull()
    is_validation = first_fraction(marked, keys, seed + 1, validation_fraction, rest)
    label = F.coalesce("split", F.when(is_validation, "validation").otherwise("train"))
    return marked.withColumn("split", label)


def plain_batches(df: DataFrame, keys: list[str], batch_size: int = BATCH, seed: int = SEED) -> DataFrame:
    """Add ``batch``: consecutive runs of a repeatable random order."""
    indexed = shuffled_index(df, keys, seed)
    batch = F.floor(F.col("row_index") / batch_size)
    return indexed.withColumn("batch", batch).drop("row_index", "row_total")


def foil_batches(
    df: DataFrame,
    score: str,
    keys: list[str],
    batch_size: int = BATCH,
    threshold: float = THRESHOLD,
    seed: int = SEED,
) -> DataFrame:
    """Batches of one high row and ``batch_size - 1`` low rows; highs are cycled.

    Adds ``batch`` and ``is_high``. Without high rows the low rows form plain
    batches of ``batch_size``. A high row recurs when there are more batches
    than highs and stays out when there are fewer.
    """
    if batch_size < 2:
        raise ValueError("batch_size must be greater than 1")
    marked = df.withColumn("is_high", F.col(score) >= threshold).filter(F.col("is_high").isNotNull())
    indexed = shuffled_index(marked, keys, seed, ["is_high"], "__i", "__n")
    highs = indexed.filter("is_high")
    lows = indexed.filter(~F.col("is_high"))
    high_count = highs.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("n")).select("n").scalar()
    size = F.when(high_count == 0, batch_size).otherwise(batch_size - 1)
    lows = lows.withColumn("batch", F.floor(F.col("__i") / size))
    # Every batch has exactly one low row at its start; it asks for its high row.
    asks = lows.filter(F.pmod(F.col("__i"), size.cast("long")) == 0).select(
        "batch", F.pmod(F.col("batch"), F.greatest(high_count, F.lit(1))).alias("__i")
    )
    cycled = highs.join(asks, "__i").select(*lows.columns)
    return lows.unionByName(cycled).drop("__i", "__n")


# ---- regression -----------------------------------------------------------


@dataclass(frozen=True)
class RegressionConfig:
    target: str = "logit"
    model: str = "linear"
    alpha: float = 1.0
    threshold: float = THRESHOLD
    max_iter: int = 50
    seed: int = SEED


def fit_predict(
    df: DataFrame, features: str = "features", config: RegressionConfig = RegressionConfig()
) -> DataFrame:
    """Weighted regression of the score; adds ``predicted`` in [0, 1] to every row.

    ``df`` carries ``epss_score``, ``split`` and the feature vector; rows of the
    split ``train`` fit the model. The solver passes over its input many times,
    so the input is written to the shared folder first.
    """
    score = F.col("epss_score")
    ready = df.withColumn("__label", transform_target(score, config.target)).withColumn(
        "__weight", sample_weight(score, config.alpha, config.threshold)
    )
    ready = materialize(ready, "training")
    common = dict(
        featuresCol=features, labelCol="__label", weightCol="__weight",
        predictionCol="__prediction", maxIter=config.max_iter,
    )
    if config.model == "linear":
        # Huber loss; a little ridge keeps collinear one-hot blocks solvable.
        estimator = LinearRegression(loss="huber", regParam=1e-4, **common)
    elif config.model == "trees":
        estimator = GBTRegressor(seed=config.seed, **common)
    else:
        raise ValueError(f"unknown model {config.model!r}; known: linear, trees")
    model = estimator.fit(ready.filter(F.col("split") == "train"))
    raw = invert_target(F.col("__prediction"), config.target)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return (
        model.transform(ready)
        .withColumn("predicted", bounded)
        .drop("__label", "__weight", "__prediction")
    )


# ---- source experiments ---------------------------------------------------


def experiments(sources: tuple[str, ...] = SOURCES) -> dict[str, tuple[str, ...]]:
    """Run name -> enabled sources: all, each left out, each alone."""
    runs = {"all_sources": sources}
    runs |= {f"leave_out_{s}": tuple(o for o in sources if o != s) for s in sources}
    runs |= {f"only_{s}": (s,) for s in sources}
    return runs


def experiment_config(base: FeatureConfig, enabled: tuple[str, ...]) -> FeatureConfig:
    return replace(base, sources=enabled)


def evaluate(
    predicted: DataFrame, keys: list[str], config: RegressionConfig = RegressionConfig()
) -> DataFrame:
    """One row ``test_loss, r2, pr_auc`` over the test rows of a prediction table."""
    test = predicted.filter(F.col("split") == "test").withColumn(
        "__weight", sample_weight(F.col("epss_score"), config.alpha, config.threshold)
    )
    space = {c: transform_target(F.col(c), config.target) for c in ("epss_score", "predicted")}
    loss = batch_loss(test.withColumns(space), keys, "epss_score", "predicted", "__weight")
    r2 = r_squared(test, "epss_score", "predicted")
    area = pr_auc(test, "epss_score", "predicted", config.threshold)
    # Three one-row tables side by side.
    return loss.select(
        F.col("loss").alias("test_loss"),
        r2.scalar().alias("r2"),
        area.scalar().alias("pr_auc"),
    )


def run_experiments(
    df: DataFrame,
    keys: list[str],
    features: FeatureConfig = FeatureConfig(),
    config: RegressionConfig = RegressionConfig(),
    runs: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Fit and evaluate one model per source experiment: (experiment, test_loss, r2, pr_auc).

    Every run sees the same rows and the same split; only the features differ.
    """
    table = materialize(split(materialize(drop_unscored(df), "scored"), keys), "split")
    categories = category_table(table) if features.cvss_categorical else None
    results = []
    for name, enabled in (runs or experiments(features.all_sources)).items():
        vectors = assemble_features(table, experiment_config(features, enabled), categories)
        done = materialize(fit_predict(vectors, config=config).drop("features"), "predicted")
        results.append(evaluate(done, keys, config).select(F.lit(name).alias("experiment"), "*"))
    return reduce(DataFrame.unionByName, results)


def experiment_grid(df: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Rows per (experiment, enabled source) with a text block and a one-hot mark.

    Rows first shrink to one per combination of matching sources; only those
    few combinations are multiplied by the experiments. An experiment keeps all
    rows: ``rows`` is the same everywhere, ``active_rows`` differs.
    """
    marks = [mentions_source(F.col("source"), s).alias(s) for s in sources]
    combined = df.groupBy(*marks).agg(F.count(F.lit(1)).alias("n"))
    pairs = [
        F.struct(F.lit(run).alias("experiment"), F.lit(s).alias("source"), F.col(s).alias("hit"))
        for run, enabled in experiments(sources).items()
        for s in enabled
    ]
    return (
        combined.select("n", F.inline(F.array(*pairs)))
        .groupBy("experiment", "source")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("active_rows"),
        )
    )
