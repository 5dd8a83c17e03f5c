"""Distribution statistics and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvebeacon.operators.ordering import running_totals, shuffle_hash, shuffled_index

THRESHOLD = 0.02
BATCH = 128


# ---- distribution ---------------------------------------------------------


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """Rows (probability, value), exact with linear interpolation, NULLs dropped.

    Equal values are counted first and ranked by bucketed running totals, so
    no task holds all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    ranked = running_totals(counts, "value", ["rows"])
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    placed = (
        ranked.select(
            "value",
            F.col("running_rows").alias("last"),
            (F.col("running_rows") - F.col("rows")).alias("first"),
            "total_rows",
            asked,
        )
        .withColumn("position", F.col("probability") * (F.col("total_rows") - 1))
        .withColumn("lower", F.floor("position"))
        .withColumn("upper", F.ceil("position"))
    )

    def holds(position: str) -> Column:
        return (F.col(position) >= F.col("first")) & (F.col(position) < F.col("last"))

    ends = (
        placed.filter(holds("lower") | holds("upper"))
        .groupBy("probability")
        .agg(
            F.max(F.when(holds("lower"), F.col("value"))).alias("low"),
            F.max(F.when(holds("upper"), F.col("value"))).alias("high"),
            F.max(F.col("position") - F.col("lower")).alias("part"),
        )
    )
    return ends.select(
        "probability",
        (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"),
    )


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """One row with ``p25``, ``p50``, ``p75``."""
    return exact_quantiles(df, column, [0.25, 0.5, 0.75]).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
        ]
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Rows (statistic, value): count, mean, std, min, 25%, 50%, 75%, max."""
    plain = df.agg(
        F.count(column).cast("double").alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value"))
        for n in ("count", "mean", "std", "min", "max")
    ])))
    middle = exact_quantiles(df, column, [0.25, 0.5, 0.75]).select(
        F.format_string("%.0f%%", F.col("probability") * 100).alias("statistic"),
        F.col("value").cast("double").alias("value"),
    )
    return plain.unionByName(middle)


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """``bins`` equal-width bins between minimum and maximum, empty ones included.

    The last bin is closed. When all values are equal the range is widened by
    one half on each side.
    """
    spark = df.sparkSession
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    flat = F.col("a") == F.col("b")
    ends = ends.select(
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
    )
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi).otherwise(i * width + lo)

    # The rounded quotient can land one bin off; the edges decide.
    guess = df.filter(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("v"),
        F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1)).alias("i"),
    )
    i, v = F.col("i"), F.col("v")
    placed = F.when(v < edge(i), i - 1).when((v >= edge(i + 1)) & (i < bins - 1), i + 1)
    filled = guess.groupBy(placed.otherwise(i).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    return spark.range(bins).join(filled, "id", "left").select(
        (F.col("id") + 1).alias("bin"),
        edge(F.col("id")).alias("bin_start"),
        edge(F.col("id") + 1).alias("bin_end"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


# ---- losses ---------------------------------------------------------------


def element_loss(actual: Column, predicted: Column, kind: str = "huber") -> Column:
    """Loss of one row: ``huber`` (delta 1), ``mse`` or ``mae``."""
    error = predicted - actual
    if kind == "huber":
        size = F.abs(error)
        return F.when(size <= 1, error * error * 0.5).otherwise(size - 0.5)
    if kind == "mse":
        return error * error
    if kind == "mae":
        return F.abs(error)
    raise ValueError(f"unknown loss {kind!r}; known: huber, mse, mae")


def r_squared(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row ``r2``: NULL below two rows; a constant target gives 1 or 0.

    Only rows where both values are known count.
    """
    df = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(predicted) - F.col(actual)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("residual"),
        (F.var_pop(actual) * F.count(F.lit(1))).alias("spread"),
    )
    constant = F.when(F.col("residual") == 0, 1.0).otherwise(0.0)
    return sums.select(
        F.when(F.col("n") < 2, None)
        .when(F.col("spread") == 0, constant)
        .otherwise(1 - F.try_divide("residual", "spread"))
        .alias("r2")
    )


def batch_loss(
    df: DataFrame,
    keys: list[str],
    actual: str,
    predicted: str,
    weight: str | None = None,
    kind: str = "huber",
    batch_size: int = BATCH,
    seed: int = 42,
) -> DataFrame:
    """Mean over batches of the (weighted) mean loss within a batch.

    A short last batch counts as much as a full one. Batches follow the
    repeatable random order of the row keys.
    """
    loss = element_loss(F.col(actual), F.col(predicted), kind)
    if weight is not None:
        loss = loss * F.col(weight)
    indexed = shuffled_index(df.select(*keys, loss.alias("loss")), keys, seed)
    return (
        indexed.groupBy(F.floor(F.col("row_index") / batch_size).alias("batch"))
        .agg(F.avg("loss").alias("batch_mean"))
        .agg(F.avg("batch_mean").alias("loss"), F.count(F.lit(1)).alias("batches"))
    )


# ---- ranking quality ------------------------------------------------------


def is_high(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def _pr_points(df: DataFrame, actual: str, predicted: str, threshold: float) -> DataFrame:
    """Cumulative positives and rows per distinct score, highest score first."""
    by_score = df.groupBy(F.col(predicted).alias("threshold")).agg(
        F.sum(is_high(F.col(actual), threshold)).alias("positives"),
        F.count(F.lit(1)).alias("rows"),
    )
    return running_totals(by_score, "threshold", ["positives", "rows"], descending=True)


def pr_curve(
    df: DataFrame, actual: str, predicted: str, threshold: float = THRESHOLD
) -> DataFrame:
    """One point per distinct score plus the closing point (precision 1, recall 0)."""
    points = _pr_points(df, actual, predicted, threshold).select(
        F.col("threshold").cast("double").alias("threshold"),
        (F.col("running_positives") / F.col("running_rows")).alias("precision"),
        F.try_divide("running_positives", "total_positives").alias("recall"),
    )
    closing = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(closing)


def pr_auc(
    df: DataFrame, actual: str, predicted: str, threshold: float = THRESHOLD
) -> DataFrame:
    """One row ``pr_auc``: trapezoid area over recall, NULL when one class is absent.

    The point before a score follows from its own running totals, so no value
    has to be fetched from a neighbouring bucket.
    """
    points = _pr_points(df, actual, predicted, threshold)
    rows_before = F.col("running_rows") - F.col("rows")
    hits_before = F.col("running_positives") - F.col("positives")
    precision = F.col("running_positives") / F.col("running_rows")
    precision_before = F.when(rows_before == 0, 1.0).otherwise(
        F.try_divide(hits_before, rows_before)
    )
    step = F.try_divide("positives", "total_positives")
    area = points.agg(
        F.sum(step * (precision + precision_before) / 2).alias("area"),
        F.max("total_positives").alias("positives"),
        F.max("total_rows").alias("rows"),
    )
    two_classes = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    return area.select(F.when(two_classes, F.col("area")).alias("pr_auc"))


# ---- log-log fit ----------------------------------------------------------


def loglog_fit(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Least squares of log10(predicted) on log10(actual) over positive pairs.

    Slope, K = 10**intercept, the fit's end points and its text; NULL when
    fewer than two pairs are usable.
    """
    positive = df.filter((F.col(actual) > 0) & (F.col(predicted) > 0))
    x, y = F.log10(F.col(actual)), F.log10(F.col(predicted))
    fit = positive.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("log10_k"),
        F.min(actual).alias("x_min"),
        F.max(actual).alias("x_max"),
    ).withColumn("k", F.pow(F.lit(10.0), F.col("log10_k")))
    enough = F.col("pairs") >= 2
    equation = F.format_string("y ≈ %.2ex^{%.2f}", F.col("k"), F.col("slope"))
    return fit.select(
        "pairs",
        *[F.when(enough, F.col(c)).alias(c) for c in ("slope", "log10_k", "k", "x_min", "x_max")],
        F.when(enough, F.col("k") * F.pow("x_min", "slope")).alias("y_min"),
        F.when(enough, F.col("k") * F.pow("x_max", "slope")).alias("y_max"),
        F.when(enough & F.col("slope").isNotNull(), equation).alias("equation"),
    )


def ideal_line(df: DataFrame, actual: str) -> DataFrame:
    """End points of the diagonal: overall minimum, smallest positive, maximum."""
    return df.agg(
        F.min(actual).alias("lowest"),
        F.min(F.when(F.col(actual) > 0, F.col(actual))).alias("lowest_positive"),
        F.max(actual).alias("highest"),
    )


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a repeatable hash of their key."""
    return (
        df.withColumn("__hash", shuffle_hash(keys, seed))
        .orderBy("__hash", *keys)
        .limit(n)
        .drop("__hash")
    )


# ---- category agreement ---------------------------------------------------

# Default severity bands, lower limit and name.
CVSS_BANDS = [(9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM"), (0.1, "LOW")]


def cvss_band(score: Column) -> Column:
    chain = F.when(score >= CVSS_BANDS[0][0], CVSS_BANDS[0][1])
    for limit, name in CVSS_BANDS[1:]:
        chain = chain.when(score >= limit, name)
    return chain.when(score.isNotNull(), "NONE")


def category_report(
    df: DataFrame, actual: str, predicted: str, score_actual: str, score_predicted: str
) -> DataFrame:
    """Rows (metric, value) comparing two categories and the scores behind them.

    The categories shrink to a confusion matrix first; everything else works on
    that. ``Lower`` and ``Higher`` compare the scores of unequal categories.
    """
    a, p = F.col(actual), F.col(predicted)
    differs = a != p
    matrix = df.groupBy(a.alias("a"), p.alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(F.col(score_predicted) - F.col(score_actual))).alias("gap"),
        F.count_if(differs & (F.col(score_predicted) < F.col(score_actual))).alias("lower"),
        F.count_if(differs & (F.col(score_predicted) > F.col(score_actual))).alias("higher"),
    )
    per_class = (
        matrix.select(
            F.inline(
                F.array(
                    F.struct(
                        F.col("a").alias("c"),
                        F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                        F.col("n").alias("support"),
                        F.lit(0).cast("long").alias("claimed"),
                    ),
                    F.struct(
                        F.col("p").alias("c"),
                        F.lit(0).cast("long").alias("hit"),
                        F.lit(0).cast("long").alias("support"),
                        F.col("n").alias("claimed"),
                    ),
                )
            )
        )
        .groupBy("c")
        .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"),
             F.sum("claimed").alias("claimed"))
        .select(
            "support",
            F.when(F.col("claimed") > 0, F.try_divide("hit", "claimed")).otherwise(0.0).alias("precision"),
            F.when(F.col("support") > 0, F.try_divide("hit", "support")).otherwise(0.0).alias("recall"),
            F.try_divide(2 * F.col("hit"), F.col("claimed") + F.col("support")).alias("f1"),
        )
    )
    names = ("precision", "recall", "f1")
    averages = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[
            F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
            for m in names
        ],
    )
    same = F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0))
    totals = matrix.agg(
        F.try_divide(F.sum("gap"), F.sum("n")).alias("average_absolute_difference"),
        same.cast("double").alias("same"),
        F.sum("lower").cast("double").alias("lower"),
        F.sum("higher").cast("double").alias("higher"),
        F.try_divide(same, F.sum("n")).alias("accuracy"),
    )
    return _as_rows(totals).unionByName(_as_rows(averages))


def _as_rows(one_row: DataFrame) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in one_row.columns
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, missing, present) in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__all"), *[F.count(F.col(c)).alias(c) for c in columns]
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"), (F.col("__all") - F.col(c)).alias("missing"),
            F.col(c).alias("present"),
        )
        for c in columns
    ]
    return counts.select(F.inline(F.array(*pairs)))
