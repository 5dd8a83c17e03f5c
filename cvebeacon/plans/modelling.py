"""Queries: features, targets, splits, batches, experiments, regression."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cvebeacon.operators import experiments as X
from cvebeacon.operators import features as Fe
from cvebeacon.operators import training as T
from cvebeacon.operators import vectors as Ve
from cvebeacon.operators.enrich import attach_cvss, cvss_details, enrich_epss
from cvebeacon.operators.metrics import is_high, r_squared
from cvebeacon.operators.vector_store import VectorStore
from cvebeacon.plans import views as V
from cvebeacon.plans.enrichment import ENRICHED_SQL, enriched
from cvebeacon.plans.evaluation import KEY_SQL, rounded
from cvebeacon.plans.registry import query
from cvebeacon.schemas import CVSS_CATEGORICALS
from cvebeacon.session import materialize, shared_folder

_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def scored_lines(spark, sf_dir):
    return V.predictions(spark, sf_dir).select(*_LINE_KEYS, F.col("actual").alias("epss_score"))


# ---- targets and weights --------------------------------------------------


@query(
    "target_transforms",
    """select l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_discount), 6) as log1p,
  round(ln(greatest(least(l_discount, 1 - 1e-6), 1e-6) / (1 - greatest(least(l_discount, 1 - 1e-6), 1e-6))), 6) as logit,
  round(l_discount, 6) as back_log1p, round(greatest(least(l_discount, 1 - 1e-6), 1e-6), 6) as back_logit
from lineitem""",
)
def target_transforms(spark, sf_dir):
    s = F.col("epss_score")
    return scored_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[F.round(T.transform_target(s, k), 6).alias(k) for k in ("log1p", "logit")],
        *[
            F.round(T.invert_target(T.transform_target(s, k), k), 6).alias(f"back_{k}")
            for k in ("log1p", "logit")
        ],
    )


@query(
    "sample_weights",
    "select l_returnflag, sum(1 + (l_discount >= 0.02)::int)::double as model_weight, "
    "sum(1 + 20 * (l_discount >= 0.02)::int)::double as prototype_weight from lineitem group by l_returnflag",
)
def sample_weights(spark, sf_dir):
    s = F.col("l_discount")
    return V.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum(T.sample_weight(s, 1)).alias("model_weight"),
        F.sum(T.sample_weight(s, 20)).alias("prototype_weight"),
    )


@query(
    "high_low",
    "select l_linenumber, sum((l_discount >= 0.02)::int)::bigint as high, sum((l_discount < 0.02)::int)::bigint as low "
    "from lineitem group by l_linenumber",
)
def high_low(spark, sf_dir):
    mark = is_high(F.col("l_discount"))
    return V.table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.sum(mark).alias("high"), F.sum(1 - mark).alias("low")
    )


# ---- splits and batches ---------------------------------------------------

_OBS_ORDER = "md5(concat_ws(':', o_orderkey, '{}')), o_orderkey"


# Test rows from those with an original score, then validation rows from the rest.
SPLIT_SQL = f"""a as (select o_orderkey, epss_status, count(*) over (partition by epss_status = 'original') as n,
  row_number() over (partition by epss_status = 'original' order by {_OBS_ORDER.format(42)}) - 1 as i from {{rows}}
  where epss_score is not null),
b as (select *, epss_status = 'original' and i < ceil(0.2::double * n) as t from a),
c as (select *, count(*) over (partition by t) as m, row_number() over (partition by t order by {_OBS_ORDER.format(43)}) - 1 as j from b),
split_rows as (select o_orderkey, epss_status,
  case when t then 'test' when j < ceil(0.1::double * m) then 'validation' else 'train' end as split from c)"""


@query(
    "split_rows",
    V.with_views("obs epss scored", ", " + SPLIT_SQL.format(rows="scored") + " select * from split_rows"),
)
def split_rows(spark, sf_dir):
    scored = T.drop_unscored(
        enriched_scores(spark, sf_dir).select("o_orderkey", "epss_score", "epss_status")
    )
    return T.split(materialize(scored, "scored"), ["o_orderkey"]).select("o_orderkey", "epss_status", "split")


def enriched_scores(spark, sf_dir):
    return enrich_epss(V.observations(spark, sf_dir), V.epss_history(spark, sf_dir))


_FOIL = """with base as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {score} as score from lineitem),
m as (select *, score >= {cut} as is_high, row_number() over (partition by score >= {cut}
        order by md5({key}), l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as i from base),
lows as (select *, i // {low} as batch from m where not is_high),
highs as (select *, count(*) over () as h from m where is_high),
slots as (select distinct batch from lows),
both_ as (select l_orderkey, l_linenumber, l_partkey, is_high, batch from lows
  union all select l_orderkey, l_linenumber, l_partkey, is_high, s.batch from slots s join highs on s.batch % h = i)
select * from both_"""


@query("foil_batches", _FOIL.format(score="l_discount / 2", cut="0.02", low=127, key=KEY_SQL.format(42)))
def foil_batches(spark, sf_dir):
    lines = scored_lines(spark, sf_dir).withColumn("score", F.col("epss_score") / 2)
    batches = T.foil_batches(lines, "score", _LINE_KEYS)
    return batches.select("l_orderkey", "l_linenumber", "l_partkey", "is_high", "batch")


@query(
    "foil_batches_cycled",
    _FOIL.format(score="l_extendedprice / 105000", cut="0.995", low=15, key=KEY_SQL.format(7)),
)
def foil_batches_cycled(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").select(
        *_LINE_KEYS, (F.col("l_extendedprice") / 105000).alias("score")
    )
    batches = T.foil_batches(lines, "score", _LINE_KEYS, 16, 0.995, 7)
    return batches.select("l_orderkey", "l_linenumber", "l_partkey", "is_high", "batch")


@query(
    "foil_batches_no_high",
    _FOIL.format(score="l_discount", cut="2.0", low=128, key=KEY_SQL.format(42)),
)
def foil_batches_no_high(spark, sf_dir):
    batches = T.foil_batches(scored_lines(spark, sf_dir), "epss_score", _LINE_KEYS, threshold=2.0)
    return batches.select("l_orderkey", "l_linenumber", "l_partkey", "is_high", "batch")


@query(
    "plain_batches",
    f"select o_orderkey, (row_number() over (order by {_OBS_ORDER.format(42)}) - 1) // 128 as batch from orders",
)
def plain_batches(spark, sf_dir):
    return T.plain_batches(V.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


# ---- encodings ------------------------------------------------------------


@query(
    "score_feature",
    V.with_views(
        "obs cvss",
        "select o_orderkey, round(coalesce(cvss_score, 0) / 10, 6) as score from obs left join cvss using (cve)",
    ),
)
def score_feature(spark, sf_dir):
    rows = attach_cvss(V.observations(spark, sf_dir).select("o_orderkey", "cve"), V.nvd_records(spark, sf_dir))
    return rows.select("o_orderkey", F.round(Fe.score_feature(F.col("cvss_score")), 6).alias("score"))


@query(
    "source_onehot",
    V.with_views(
        "obs",
        "select o_orderkey, "
        + ", ".join(f"contains(lower(source), '{s}')::int::double as source_{s}" for s in Fe.SOURCES)
        + " from obs",
    ),
)
def source_onehot(spark, sf_dir):
    return Fe.source_one_hot(V.observations(spark, sf_dir).select("o_orderkey", F.upper("source").alias("source"))).drop("source")


_PAIRS_SQL = " union all ".join(
    f"select cve, '{Fe.ONE_HOT_PREFIX[c]}_' || coalesce({c}, 'NONE') as name from cvss" for c in CVSS_CATEGORICALS
)


@query(
    "cvss_onehot",
    V.with_views("cvss", f", pairs as ({_PAIRS_SQL}) select cve, string_agg(name, ',' order by name) as on_columns, "
                 "(select count(distinct name) from pairs) as n_columns from pairs group by cve"),
)
def cvss_onehot(spark, sf_dir):
    encoded, names = Fe.cvss_one_hot(cvss_details(V.nvd_records(spark, sf_dir)))
    marked = [F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in sorted(names)]
    return encoded.select(
        "cve", F.concat_ws(",", *marked).alias("on_columns"),
        F.lit(len(names)).cast("long").alias("n_columns"),
    )


@query(
    "category_onehot",
    """with named as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'o' || l_orderkey as ord,
    case when l_suppkey = 1 then 'NONE' else 's' || l_suppkey end as sup from lineitem),
sizes as (select count(distinct ord) as a, count(distinct sup) as b from named)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, a + b as size,
  (dense_rank() over (order by ord) - 1) || ',' || (a + dense_rank() over (order by sup) - 1) as on_places
from named, sizes""",
)
def category_onehot(spark, sf_dir):
    """Sparse one-hot vectors of two columns with a value per order and per supplier."""
    lines = V.table(spark, sf_dir, "lineitem").select(
        *_LINE_KEYS, F.expr("'o' || l_orderkey").alias("ord"),
        F.expr("case when l_suppkey <> 1 then 's' || l_suppkey end").alias("sup"),
    )
    both = ["ord", "sup"]
    encoded, names = Fe.categories_one_hot(lines, Fe.category_table(lines, both), both)
    joined = Fe.joined_vectors(encoded, names, "v")
    inside = F.unwrap_udt("v")
    return joined.select(
        *_LINE_KEYS, inside["size"].cast("long").alias("size"), F.array_join(inside["indices"], ",").alias("on_places")
    )


# ---- token windows --------------------------------------------------------

_TOKENS_SQL = "list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '')"


def _windows_sql(window: int, stride: int, empty: int) -> str:
    return f"""with toks as (select doc_id, {_TOKENS_SQL} as t from documents),
starts as (select doc_id, t, unnest(range(0, greatest(len(t), {empty}), {stride})) as a from toks),
w as (select doc_id, a // {stride} as i, list_slice(t, a + 1, a + {window}) as s from starts)
select doc_id, i as window_index, len(s) as tokens, md5(array_to_string(s, ' ')) as digest from w"""


def _window_rows(df, windows):
    return df.select("doc_id", F.posexplode(windows).alias("p", "s")).select(
        "doc_id", F.col("p").cast("long").alias("window_index"),
        F.size("s").cast("long").alias("tokens"), F.md5(F.array_join("s", " ")).alias("digest"),
    )


def _documents_with_tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", Ve.whitespace_tokens(F.col("text")).alias("t"))


@query("token_windows", _windows_sql(62, 31, 1))
def token_windows(spark, sf_dir):
    return _window_rows(_documents_with_tokens(spark, sf_dir), Ve.overlapping_windows(F.col("t"), 64))


@query("token_chunks", _windows_sql(64, 64, 0))
def token_chunks(spark, sf_dir):
    return _window_rows(_documents_with_tokens(spark, sf_dir), Ve.token_chunks(F.col("t"), 64))


@query(
    "token_route",
    f"select case when len({_TOKENS_SQL}) <= 382 then 'short' else 'long' end as route, count(*) as documents "
    "from documents group by 1",
)
def token_route(spark, sf_dir):
    routed = _documents_with_tokens(spark, sf_dir).select(Ve.token_route(F.col("t"), 382).alias("route"))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("documents"))


# ---- vectors --------------------------------------------------------------


def _vectors(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", array_to_vector("embedding").alias("v"))


_DIMS = "(select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)"


def _by_dimension(df, key, vector):
    return df.select(key, F.posexplode(vector_to_array(vector)).alias("i", "x")).select(
        key, F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )


@query("mean_pool", f"select label, i, round(avg(x), 6) as x from {_DIMS} group by label, i")
def mean_pool(spark, sf_dir):
    return _by_dimension(Ve.mean_vectors(_vectors(spark, sf_dir), ["label"], "v"), "label", "vector")


@query(
    "masked_mean_pool",
    f"""select label, i, round(case when label = 3 then 0 else sum(case when vec_id % 3 <> 0 and label <> 3 then x else 0 end)
  / greatest(count(*) filter (where vec_id % 3 <> 0 and label <> 3), 1e-9) end, 6) as x from {_DIMS} group by label, i""",
)
def masked_mean_pool(spark, sf_dir):
    masked = _vectors(spark, sf_dir).withColumn("m", F.expr("int(vec_id % 3 <> 0 and label <> 3)"))
    return _by_dimension(Ve.masked_mean(masked, ["label"], "v", "m"), "label", "vector")


@query(
    "l2_normalize",
    f"""select vec_id, i, round(case when vec_id % 50 = 0 then 0 else x / n end, 6) as x
from {_DIMS} join (select vec_id, sqrt(sum(x * x)) as n from {_DIMS} group by vec_id) using (vec_id)""",
)
def l2_normalize(spark, sf_dir):
    zeros = F.expr("transform(embedding, x -> case when vec_id % 50 = 0 then 0f else x end)")
    rows = V.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(zeros).alias("v"))
    return _by_dimension(Ve.l2_normalize(rows, "v", "u"), "vec_id", "u")


@query(
    "document_vectors",
    f"""select d.doc_id, i, round(coalesce(x, 0), 6) as x from (select doc_id, i from documents, range(64) r(i)) d
left join (select vec_id // 3 as doc_id, i, avg(x) as x from {_DIMS} group by 1, 2) v using (doc_id, i)""",
)
def document_vectors(spark, sf_dir):
    chunks = _vectors(spark, sf_dir).select(F.expr("vec_id div 3").alias("doc_id"), "v")
    docs = V.table(spark, sf_dir, "documents").select("doc_id")
    return _by_dimension(Ve.document_vectors(docs, "doc_id", chunks, "v", 64), "doc_id", "vector")


@query(
    "flatten_vector",
    "select vec_id, "
    + ", ".join(f"round(embedding[{i + 1}]::double, 6) as text_emb_{i}" for i in range(64))
    + " from embeddings",
)
def flatten_vector(spark, sf_dir):
    flat = Ve.flatten_vector(_vectors(spark, sf_dir).select("vec_id", "v"), "v", 64)
    return rounded(flat, *[f"text_emb_{i}" for i in range(64)])


# ---- the feature vector ----------------------------------------------------

_PLAIN = Fe.FeatureConfig(text=False, description=False)
_DIGEST_SIZE = 8


def full_config(spark) -> Fe.FeatureConfig:
    """Every block on; texts by an encoder that SQL can repeat, through a vector store."""
    return Fe.FeatureConfig(encoder="digest", vector_size=_DIGEST_SIZE, store=shared_folder(spark, "vectors"))


def _digest_sql(text: str) -> str:
    """The digest encoder: unit-length counts of tokens by the first byte of their MD5."""
    tokens = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[\\s\\p{{Z}}]+'), lambda t: t <> '')"
    places = f"list_transform({tokens}, lambda t: ('0x' || substr(md5(t), 1, 2))::int % {_DIGEST_SIZE})"
    counts = f"list_transform(range(0, {_DIGEST_SIZE}), lambda k: len(list_filter({places}, lambda p: p = k))::double)"
    return (
        f"(select list_transform(c, lambda v: case when n = 0 then 0 else v / n end) from (select c, "
        f"sqrt(list_sum(list_transform(c, lambda v: v * v))) as n from (select {counts} as c)))"
    )


def _full_sql(base: str) -> str:
    """Rows of ``base`` with x: text, description, score and category features."""
    pairs = " union all ".join(
        f"select {i + 1} as c, coalesce({c}, 'NONE') as v from {base}" for i, c in enumerate(CVSS_CATEGORICALS)
    )
    cats = "[" + ", ".join(f"coalesce({c}, 'NONE')" for c in CVSS_CATEGORICALS) + "]"
    return f"""vectors as (select t, {_digest_sql("t")} as v from (
  select distinct text as t from {base} union select distinct description from {base})),
names as (select list({{'c': c, 'v': v}} order by c, v) as ns from (select distinct c, v from ({pairs}))),
full_rows as (select o_orderkey, source, epss_score, epss_status,
    list_concat(a.v, b.v, [coalesce(cvss_score, 0) / 10], list_transform(ns, lambda n: ({cats}[n.c] = n.v)::int::double)) as x
  from {base} join names on true join vectors a on a.t is not distinct from text
  join vectors b on b.t is not distinct from description)"""


@query(
    "assemble_features",
    V.with_views(
        "obs epss scored cvss",
        ", " + ENRICHED_SQL + ", " + _full_sql("enriched") + " select o_orderkey, array_to_string(list_transform(list_concat(x, ["
        + ", ".join(f"contains(source, '{s}')::int::double" for s in Fe.SOURCES)
        + "]), lambda v: round(v, 6)::varchar), ',') as features from full_rows",
    ),
)
def assemble_features(spark, sf_dir):
    """Text, description, score, categories and sources; texts are encoded once and stored."""
    rows = materialize(enriched(spark, sf_dir), "enriched")
    vectors = Fe.assemble_features(rows, full_config(spark))
    values = F.transform(vector_to_array("features"), lambda x: F.round(x, 6).cast("string"))
    return vectors.select("o_orderkey", F.array_join(values, ",").alias("features"))


_CLIPPED = "greatest(least({0}, 1 - 1e-6), 1e-6)"
_LOGIT = f"ln({_CLIPPED} / (1 - {_CLIPPED}))"
_ON = "({0}.bit = 0 or (g.mask & {0}.bit) <> 0)"
_RUNS_SQL = f""", known as (select * from enriched where epss_score is not null), {_full_sql("known")},
{SPLIT_SQL.format(rows="known")},
src as (select unnest([{", ".join(f"'{s}'" for s in Fe.SOURCES)}]) as s, unnest(range(0, {len(Fe.SOURCES)})) as b),
r as (select o_orderkey, split, epss_score, x, {_LOGIT.format("epss_score")} as y, 1 + (epss_score >= 0.02)::int as w,
    {" + ".join(f"contains(lower(source), '{s}')::int * {1 << i}" for i, s in enumerate(Fe.SOURCES))} as mask
  from full_rows join split_rows using (o_orderkey) where split <> 'validation'),
size as (select max(len(x)) as n from r),
place as (select unnest(generate_series(1, n + 2)) as i from size),
g as (select mask, i.i, j.i as j, sum(w * z[i.i] * z[j.i]) as v
  from (select mask, w, list_concat(x, [1.0, y]) as z from r where split = 'train'), place i, place j group by all),
runs as (select 'all_sources' as run, b from src
  union all select 'leave_out_' || a.s, o.b from src a join src o on a.b <> o.b union all select 'only_' || s, b from src),
parted as (
  select distinct run, t as part, case when c = {len(Fe.SOURCES)} then 0 else b end as b, t * {_DIGEST_SIZE} + k as i,
    case when c = {len(Fe.SOURCES)} then 0 else 1 << b end as bit
  from (select *, count(*) over (partition by run) as c from runs), (select unnest([0, 1]) as t),
    (select unnest(generate_series(1, {_DIGEST_SIZE})) as k)
  union all select distinct run, 2, 0, i, 0 from runs, place, size where i > {2 * _DIGEST_SIZE} and i <= n
  union all select run, 3, b, n + 1, 1 << b from runs, size
  union all select distinct run, 4, 0, n + 1, 0 from runs, size),
cols as (select run, i, bit, row_number() over (partition by run order by part, b, i) as k,
  count(*) over (partition by run) as m from parted),
normal as (
  select a.run, a.k, b.k as l, sum(case when {_ON.format("a")} and {_ON.format("b")} then v else 0 end)
    + case when a.k = b.k and a.k < any_value(a.m) then 1e-4 * (select sum(v) from g, size where i = n + 1 and j = n + 1) else 0 end as v
  from cols a join cols b using (run) join g on g.i = a.i and g.j = b.i group by a.run, a.k, b.k
  union all
  select a.run, a.k, a.m + 1, sum(case when {_ON.format("a")} then v else 0 end)
  from cols a, size join g on g.j = n + 2 where g.i = a.i group by a.run, a.k, a.m),
solve(run, k, m) as (
  select run, 1, list(line order by k) from (select run, k, list(v order by l) as line from normal group by run, k) group by run
  union all
  select run, k + 1, list_transform(m, lambda line, i: case when i = k then p
      else list_transform(line, lambda v, j: v - line[k] * p[j]) end)
  from (select run, k, m, list_transform(m[k], lambda v: v / m[k][k]) as p from solve where k <= len(m))),
beta as (select run, generate_subscripts(m, 1) as k, unnest(list_transform(m, lambda line: line[len(m) + 1])) as c
  from solve where k = len(m) + 1),
weights as (
  select run, mask, list(c order by i) as c from (
    select run, g.mask, i, sum(case when {_ON.format("cols")} then c else 0 end) as c
    from cols join beta using (run, k), (select distinct mask from r) g group by run, g.mask, i)
  group by run, mask),
pred as (
  select run, o_orderkey, epss_score as actual,
    round(greatest(0, least(1, 1 / (1 + exp(-list_dot_product(list_concat(x, [1.0::double]), c))))), 9) as predicted
  from r join weights using (mask) where split = 'test'),
batches as (select *, (row_number() over (partition by run order by md5(concat_ws(':', o_orderkey, '42')), o_orderkey) - 1) // 128 as batch from pred),
losses as (select run, avg(l) as test_loss, sum(n) as test_rows from (
  select run, batch, count(*) as n, avg((case when abs(e) <= 1 then e * e * 0.5 else abs(e) - 0.5 end) * (1 + (actual >= 0.02)::int)) as l
  from (select *, {_LOGIT.format("predicted")} - {_LOGIT.format("actual")} as e from batches) group by run, batch) group by run),
r2s as (select run, 1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)) as r2 from pred group by run),
ranked as (select run, predicted, sum(p) over w as tp, sum(n) over w as k, sum(p) over (partition by run) as p, p as own, n
  from (select run, predicted, sum((actual >= 0.02)::int) as p, count(*) as n from pred group by 1, 2)
  window w as (partition by run order by predicted desc)),
areas as (select run, case when max(p) between 1 and max(k) - 1 then
    sum(own / p * (tp / k + case when k = n then 1.0 else (tp - own) / (k - n) end) / 2) end as pr_auc from ranked group by run)
select run as experiment, (select max(m) from cols c where c.run = l.run) - 1 as features,
  (select count(*) from r where split = 'train') as train_rows, test_rows::bigint as test_rows,
  round(test_loss, 6) as test_loss, round(r2, 6) as r2, round(pr_auc, 6) as pr_auc
from losses l join r2s using (run) join areas using (run)"""


@query(
    "experiment_runs",
    V.with_views("obs epss scored cvss", ", " + ENRICHED_SQL + _RUNS_SQL).replace("with ", "with recursive ", 1),
)
def experiment_runs(spark, sf_dir):
    """All 13 experiments with every block on, fitted from one scan of the training rows."""
    rows = materialize(enriched(spark, sf_dir), "enriched")
    runs = X.experiment_runs(rows, ["o_orderkey"], full_config(spark))
    return rounded(runs, "test_loss", "r2", "pr_auc")


@query(
    "per_source_blocks",
    V.with_views(
        "obs",
        """select o_orderkey, 24 as size, case when contains(source, 'reddit') then 0 when contains(source, 'telegram') then 8 end as first_hot,
  case when contains(source, 'mastodon') or contains(source, 'exploitdb') or contains(source, 'bleeping') then 0 else 1 end::double as norm
from obs""",
    ),
)
def per_source_blocks(spark, sf_dir):
    """Two of six sources on, an encoder that lights its first dimension."""
    Ve.register_encoder(
        "first_dimension",
        lambda df, text, out: df.withColumn(
            out, array_to_vector(F.array(F.lit(1.0), *[F.lit(0.0)] * 7))
        ),
    )
    config = Fe.FeatureConfig(
        sources=("reddit", "telegram"), description=False, cvss_score=False, cvss_categorical=False,
        encoder="first_dimension", vector_size=8,
    )
    obs = V.observations(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    built, blocks = Fe.text_blocks(obs, "text", "b", config)
    joined = F.concat(*[vector_to_array(b) for b in blocks], F.array_repeat(F.lit(0.0), 8))
    built = built.withColumn("a", joined)
    return built.select(
        "o_orderkey", F.size("a").alias("size"),
        F.nullif(F.array_position("a", F.lit(1.0)), F.lit(0)).cast("long").alias("p"),
        F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("norm"),
    ).select("o_orderkey", "size", (F.col("p") - 1).alias("first_hot"), "norm")


@query(
    "ablation_grid",
    V.with_views(
        "obs",
        ", src as (select unnest(['mastodon', 'reddit', 'exploitdb', 'bleepingcomputer', 'telegram', 'hackernews']) as s),"
        " runs as (select 'all_sources' as experiment, s as source from src"
        " union all select 'leave_out_' || a.s, b.s from src a join src b on a.s <> b.s"
        " union all select 'only_' || s, s from src)"
        " select experiment, r.source, count(*) as rows, sum(contains(lower(o.source), r.source)::int)::bigint as active_rows"
        " from runs r, obs o group by 1, 2",
    ),
)
def ablation_grid(spark, sf_dir):
    return T.experiment_grid(V.observations(spark, sf_dir))


# ---- embedding cache and regression ----------------------------------------


@query(
    "embedding_cache_misses",
    """select distinct 'hashing' as model, sha256(text) as text_hash, text from documents
where text not in (select text from documents where doc_id % 3 = 0)""",
)
def embedding_cache_misses(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    cache = docs.filter("doc_id % 3 = 0").select(
        F.lit("hashing").alias("model"), Ve.text_key(F.col("text")).alias("text_hash")
    )
    other = docs.select(F.lit("hybrid").alias("model"), Ve.text_key(F.col("text")).alias("text_hash"))
    return Ve.cache_misses(docs, "text", cache.unionByName(other), "hashing")


def _hybrid_sql(size: int, limit: int) -> str:
    """Short texts: the digest of all tokens. Long ones: the mean of the digests of adjacent chunks."""
    return f"""parts as (select doc_id, unnest(range(0, greatest(len(t), 1), {limit})) as a, t from (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\p{{Z}}]+'), lambda x: x <> '') as t from documents)),
hits as (select doc_id, a, ('0x' || substr(md5(w), 1, 2))::int % {size} as k, count(*) as n
  from (select doc_id, a, unnest(t[a + 1:a + {limit}]) as w from parts) group by all),
units as (select doc_id, a, k, n / sqrt(sum(n * n) over (partition by doc_id, a)) as v from hits),
sums as (select doc_id, k, sum(v) as v from units group by all),
chunks as (select doc_id, count(*) as c from parts group by all)
select d.doc_id, string_agg(round(coalesce(v, 0) / c, 6)::varchar, ',' order by i) as vector
from (select doc_id, c, unnest(range(0, {size})) as i from chunks) d
left join sums s on s.doc_id = d.doc_id and s.k = i group by d.doc_id"""


@query("encoded_documents", "with " + _hybrid_sql(_DIGEST_SIZE, 382))
def encoded_documents(spark, sf_dir):
    """Every document by one of two encoders, through the store; a second call finds all texts there."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    store = VectorStore(shared_folder(spark, "vectors"), "hybrid-digest")
    store.fill(store.asked(docs, "text"))
    values = F.transform(vector_to_array("vector"), lambda x: F.round(x, 6).cast("string"))
    return store.attach(docs, "text", "vector").select("doc_id", F.array_join(values, ",").alias("vector"))


def regression_input(spark, sf_dir, sources=Fe.SOURCES):
    rows = materialize(T.drop_unscored(enriched(spark, sf_dir)), "enriched")
    config = T.experiment_config(_PLAIN, sources)
    return T.split(Fe.assemble_features(rows, config), ["o_orderkey"])


@query("epss_regression")
def epss_regression(spark, sf_dir):
    predicted = T.fit_predict(regression_input(spark, sf_dir))
    return predicted.select("o_orderkey", "split", "epss_score", "predicted")


@query("regression_quality")
def regression_quality(spark, sf_dir):
    predicted = T.fit_predict(regression_input(spark, sf_dir), config=T.RegressionConfig(target="log1p", model="trees", max_iter=10))
    test = predicted.filter(F.col("split") == "test")
    return r_squared(test, "epss_score", "predicted")
