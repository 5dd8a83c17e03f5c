"""Queries: distribution statistics and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cvebeacon.operators import metrics as M
from cvebeacon.plans import views as V
from cvebeacon.plans.registry import query

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, '{}')"


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(
    "score_quartiles",
    V.with_views(
        "epss",
        "select round(quantile_cont(epss, 0.25), 6) as p25, round(quantile_cont(epss, 0.5), 6) as p50, "
        "round(quantile_cont(epss, 0.75), 6) as p75 from epss",
    ),
)
def score_quartiles(spark, sf_dir):
    return rounded(M.quartiles(V.daily_scores(spark, sf_dir), "epss_score"), "p25", "p50", "p75")


@query(
    "price_quantiles",
    "select unnest([0.01, 0.1, 0.333, 0.5, 0.9, 0.999]) as probability, "
    "round(unnest(quantile_cont(l_extendedprice, [0.01, 0.1, 0.333, 0.5, 0.9, 0.999])), 4) as value from lineitem",
)
def price_quantiles(spark, sf_dir):
    prices = V.table(spark, sf_dir, "lineitem").select("l_extendedprice")
    found = M.exact_quantiles(prices, "l_extendedprice", [0.01, 0.1, 0.333, 0.5, 0.9, 0.999])
    return rounded(found, "value", places=4)


_HIST = """, ends as (select min({c}) as lo, max({c}) as hi from {t}),
edges as (select i, lo + i * ((hi - lo) / {n}) as a,
                 case when i = {n} - 1 then hi else lo + (i + 1) * ((hi - lo) / {n}) end as b
          from ends, range({n}) r(i))
select i + 1 as bin, round(a, 6) as bin_start, round(b, 6) as bin_end, count({c}) as rows
from edges left join {t} on {c} >= a and ({c} < b or (i = {n} - 1 and {c} <= b))
group by i, a, b"""


@query("score_histogram", V.with_views("epss", _HIST.format(c="epss", t="epss", n=100)))
def score_histogram(spark, sf_dir):
    bins = M.histogram(V.daily_scores(spark, sf_dir), "epss_score")
    return rounded(bins, "bin_start", "bin_end")


@query(
    "score_describe",
    V.with_views(
        "epss",
        """, d as (select count(epss)::double as c, avg(epss) as m, stddev_samp(epss) as s, min(epss) as lo, max(epss) as hi,
  quantile_cont(epss, 0.25) as a, quantile_cont(epss, 0.5) as b, quantile_cont(epss, 0.75) as q from epss)
select unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) as statistic,
  round(unnest([c, m, s, lo, a, b, q, hi]), 6) as value from d""",
    ),
)
def score_describe(spark, sf_dir):
    return rounded(M.describe(V.daily_scores(spark, sf_dir), "epss_score"), "value")


@query(
    "r2_score",
    V.with_views(
        "pred",
        "select round(1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)), 6) as r2 from pred",
    ),
)
def r2_score(spark, sf_dir):
    return rounded(M.r_squared(V.predictions(spark, sf_dir), "actual", "predicted"), "r2")


@query(
    "element_losses",
    V.with_views(
        "pred",
        """, e as (select 30 * (predicted - actual) as x from pred)
select round(avg(case when abs(x) <= 1 then x * x * 0.5 else abs(x) - 0.5 end), 6) as huber,
  round(avg(x * x), 6) as mse, round(avg(abs(x)), 6) as mae from e""",
    ),
)
def element_losses(spark, sf_dir):
    a, p = F.col("actual") * 30, F.col("predicted") * 30
    return V.predictions(spark, sf_dir).agg(
        *[F.round(F.avg(M.element_loss(a, p, k)), 6).alias(k) for k in ("huber", "mse", "mae")]
    )


_BATCHED = """, indexed as (
  select *, (row_number() over (order by md5({key}), l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 128 as batch
  from pred),
per_batch as (select batch, avg({loss}) as m from indexed group by batch)
select round(avg(m), 6) as loss, count(*) as batches from per_batch"""
_HUBER = "(predicted - actual) ** 2 * 0.5"


@query(
    "batch_loss_weighted",
    V.with_views(
        "pred",
        _BATCHED.format(key=KEY_SQL.format(42), loss=_HUBER + " * (1 + 20 * (actual >= 0.02)::int)"),
    ),
)
def batch_loss_weighted(spark, sf_dir):
    weighted = V.predictions(spark, sf_dir).withColumn(
        "w", 1.0 + 20.0 * M.is_high(F.col("actual")).cast("double")
    )
    return rounded(M.batch_loss(weighted, _KEYS, "actual", "predicted", "w"), "loss")


@query(
    "batch_loss_plain",
    V.with_views("pred", _BATCHED.format(key=KEY_SQL.format(42), loss="abs(predicted - actual)")),
)
def batch_loss_plain(spark, sf_dir):
    plain = M.batch_loss(V.predictions(spark, sf_dir), _KEYS, "actual", "predicted", kind="mae")
    return rounded(plain, "loss")


# Many ties with the tax as the score, all but none with the price.
_PR = """, by_score as (select {score} as s, sum((actual >= 0.02)::int) as pos, count(*) as n from {t} group by 1),
run as (select s, pos, n, sum(pos) over w as tp, sum(n) over w as k, sum(pos) over () as p
        from by_score window w as (order by s desc))"""


@query(
    "pr_curve",
    V.with_views(
        "pred",
        _PR.format(score="predicted", t="pred")
        + """ select s as threshold, round(tp / k, 6) as precision, round(tp / p, 6) as recall from run
union all select null, 1.0, 0.0""",
    ),
)
def pr_curve(spark, sf_dir):
    points = M.pr_curve(V.predictions(spark, sf_dir), "actual", "predicted")
    return rounded(points, "precision", "recall")


_AUC = """, pts as (select tp / k as pr, tp / p as re, lag(tp / k, 1, 1.0) over (order by s desc) as pr0,
  lag(tp / p, 1, 0.0) over (order by s desc) as re0 from run)
select round(sum((re - re0) * (pr + pr0) / 2), 6) as pr_auc from pts"""


@query("pr_auc", V.with_views("pred", _PR.format(score="predicted", t="pred") + _AUC))
def pr_auc(spark, sf_dir):
    return rounded(M.pr_auc(V.predictions(spark, sf_dir), "actual", "predicted"), "pr_auc")


@query(
    "pr_auc_price",
    "with pred as (select l_discount as actual, l_extendedprice as predicted from lineitem)"
    + _PR.format(score="predicted", t="pred") + _AUC,
)
def pr_auc_price(spark, sf_dir):
    scored = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("actual"), F.col("l_extendedprice").alias("predicted")
    )
    return rounded(M.pr_auc(scored, "actual", "predicted"), "pr_auc")


@query(
    "loglog_fit",
    V.with_views(
        "pred",
        """, f as (select count(*) as pairs, regr_slope(log10(predicted), log10(actual)) as m,
  regr_intercept(log10(predicted), log10(actual)) as c, min(actual) as lo, max(actual) as hi
  from pred where actual > 0 and predicted > 0)
select pairs, round(m, 6) as slope, round(c, 6) as log10_k, round(10 ** c, 6) as k, lo as x_min, hi as x_max,
  round(10 ** c * lo ** m, 6) as y_min, round(10 ** c * hi ** m, 6) as y_max,
  printf('y ≈ %.2ex^{%.2f}', 10 ** c, m) as equation from f""",
    ),
)
def loglog_fit(spark, sf_dir):
    fit = M.loglog_fit(V.predictions(spark, sf_dir), "actual", "predicted")
    return rounded(fit, "slope", "log10_k", "k", "y_min", "y_max")


@query(
    "ideal_line",
    V.with_views(
        "pred",
        "select min(actual) as lowest, min(actual) filter (where actual > 0) as lowest_positive, "
        "max(actual) as highest from pred",
    ),
)
def ideal_line(spark, sf_dir):
    return M.ideal_line(V.predictions(spark, sf_dir), "actual")


@query(
    "sample_predictions",
    V.with_views(
        "pred",
        "select l_orderkey, l_linenumber, actual, predicted from pred "
        f"order by md5({KEY_SQL.format(42)}), l_orderkey, l_linenumber limit 10",
    ),
)
def sample_predictions(spark, sf_dir):
    picked = M.sample_rows(V.predictions(spark, sf_dir), _KEYS, 10)
    return picked.select("l_orderkey", "l_linenumber", "actual", "predicted")


_GUESS = "case when n_chars % 100 < 60 then 1 else 0 end"
_REPORT = """, m as (select a, p, count(*) as n, sum(abs(sp - sa)) as gap, count(*) filter (where a <> p and sp < sa) as lower,
  count(*) filter (where a <> p and sp > sa) as higher from cats group by all),
c as (select c, sum(hit) as hit, sum(sup) as sup, sum(cl) as cl from (
  select a as c, case when a = p then n else 0 end as hit, n as sup, 0 as cl from m
  union all select p, 0, 0, n from m) group by c),
s as (select sup, case when cl > 0 then hit / cl else 0 end as pr, case when sup > 0 then hit / sup else 0 end as re,
  2 * hit / (cl + sup) as f1 from c),
t as (select sum(gap) / sum(n) as d, sum(n) filter (where a = p) as same, sum(lower) as lo, sum(higher) as hi,
  coalesce(sum(n) filter (where a = p), 0) / sum(n) as acc from m),
v as (select avg(pr) as mp, avg(re) as mr, avg(f1) as mf, sum(pr * sup) / sum(sup) as wp, sum(re * sup) / sum(sup) as wr,
  sum(f1 * sup) / sum(sup) as wf from s)
select unnest(['average_absolute_difference', 'same', 'lower', 'higher', 'accuracy', 'macro_precision', 'macro_recall',
  'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1']) as metric,
  round(unnest([d, same, lo, hi, acc, mp, mr, mf, wp, wr, wf]::double[]), 6) as value from t, v"""


@query(
    "category_report",
    f"""with cats as (select 'q' || quality as a, 'q' || {_GUESS} as p, quality::double as sa, ({_GUESS})::double as sp
  from labels join documents using (doc_id))""" + _REPORT,
)
def category_report(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.expr(_GUESS).alias("sp"))
    pairs = V.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("sa"), "sp",
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("a"),
        F.concat(F.lit("q"), F.col("sp").cast("string")).alias("p"),
    )
    return rounded(M.category_report(pairs, "a", "p", "sa", "sp"), "value")


def _band(score: str) -> str:
    return (
        f"case when {score} >= 9 then 'CRITICAL' when {score} >= 7 then 'HIGH' when {score} >= 4 then 'MEDIUM' "
        f"when {score} >= 0.1 then 'LOW' else 'NONE' end"
    )


@query(
    "band_report",
    f"""with scores as (select l_discount * 100::double as sa, l_tax * 125::double as sp from lineitem),
cats as (select {_band('sa')} as a, {_band('sp')} as p, sa, sp from scores)""" + _REPORT,
)
def band_report(spark, sf_dir):
    scores = V.table(spark, sf_dir, "lineitem").select(
        (F.col("l_discount") * 100.0).alias("sa"), (F.col("l_tax") * 125.0).alias("sp")
    )
    banded = scores.withColumns({"a": M.cvss_band(F.col("sa")), "p": M.cvss_band(F.col("sp"))})
    return rounded(M.category_report(banded, "a", "p", "sa", "sp"), "value")
