import math
import random

import pytest
from pyspark.sql import functions as F

from cvebeacon.operators import metrics as M
from cvebeacon.operators import training as T
from cvebeacon.operators.ordering import first_fraction, running_totals, shuffled_index
from cvebeacon.operators.skew import heavy_keys, key_counts, lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some have none."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randint(0, 60)}") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id INT, k STRING")


@pytest.mark.parametrize("limit", [1, 5, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_plain_join(spark, skewed, limit, how):
    rows, facts = skewed
    values = {"hot": 1, **{f"k{n}": n + 10 for n in range(0, 60, 2)}, "unused": 5}
    dim = spark.createDataFrame(list(values.items()), "k STRING, v INT")
    got = sorted((r.id, r.v) for r in lookup_join(facts, dim, ["k"], how, limit).collect())
    want = [(i, values.get(k)) for i, k in rows if how == "left" or k in values]
    assert got == sorted(want)


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_lookup_join_with_known_weights(skewed, limit):
    rows, facts = skewed
    dim = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    got = sorted((r.id, r.v) for r in lookup_join(facts, dim, ["k"], "left", limit, "n").collect())
    last = {k: i for i, k in rows if k is not None}
    common = [(i, v) for i, v in got if dict(rows)[i] is not None]
    assert len(got) == len(rows) and common == sorted((i, last[k]) for i, k in rows if k is not None)


def test_heavy_keys_are_bounded_and_heaviest(skewed):
    _, facts = skewed
    heavy = [r.k for r in heavy_keys(key_counts(facts, ["k"]), ["k"], 2).collect()]
    assert heavy[0] == "hot" and len(heavy) == 2


def test_shuffled_index_is_a_permutation_per_group(spark, skewed):
    _, facts = skewed
    indexed = shuffled_index(facts.withColumn("g", F.col("k") == "hot"), ["id"], 1, ["g"]).collect()
    assert len(indexed) == 3000
    for group in (True, False, None):
        part = [r for r in indexed if r.g is group]
        assert sorted(r.row_index for r in part) == list(range(len(part)))
        assert {r.row_total for r in part} == {len(part)}
    again = {r.id: r.row_index for r in shuffled_index(facts.repartition(5), ["id"], 1).collect()}
    assert again == {r.id: r.row_index for r in shuffled_index(facts, ["id"], 1).collect()}
    other = {r.id: r.row_index for r in shuffled_index(facts, ["id"], 2).collect()}
    assert other != again


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.2, 0.5, 1.0])
def test_first_fraction_is_the_head_of_the_order(spark, skewed, fraction):
    _, facts = skewed
    order = {r.id: r.row_index for r in shuffled_index(facts, ["id"], 9).collect()}
    cut = first_fraction(facts, ["id"], 9, fraction)
    picked = {r.id for r in facts.filter(cut).collect()}
    assert picked == {i for i, n in order.items() if n < math.ceil(fraction * 3000)}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [2, 7, 1000])
def test_running_totals_match_a_plain_cumulative_sum(spark, descending, buckets):
    rng = random.Random(5)
    values = {rng.choice([rng.random(), rng.gauss(0, 100), 1e-9 * rng.random()]): rng.randint(1, 9) for _ in range(800)}
    frame = spark.createDataFrame(list(values.items()), "x DOUBLE, n INT")
    got = {r.x: (r.running_n, r.total_n) for r in running_totals(frame, "x", ["n"], descending, buckets).collect()}
    total = 0
    for x in sorted(values, reverse=descending):
        total += values[x]
        assert got[x] == (total, sum(values.values()))


def plain_quantile(values, q):
    values = sorted(values)
    place = q * (len(values) - 1)
    low, high = math.floor(place), math.ceil(place)
    return values[low] + (values[high] - values[low]) * (place - low)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 0.5, rng.random()]) for _ in range(n)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x DOUBLE")
    row = M.quartiles(frame, "x").first()
    assert tuple(row) == pytest.approx([plain_quantile(values, q) for q in (0.25, 0.5, 0.75)])


def plain_auc(pairs, cut=0.02):
    positives = sum(a >= cut for a, _ in pairs)
    area, before, hits, rows = 0.0, 1.0, 0, 0
    for score in sorted({p for _, p in pairs}, reverse=True):
        group = [a for a, p in pairs if p == score]
        gained = sum(a >= cut for a in group)
        hits, rows = hits + gained, rows + len(group)
        area += gained / positives * (hits / rows + before) / 2
        before = hits / rows
    return area


@pytest.mark.parametrize("seed", range(3))
def test_pr_auc(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([0.0, 0.02, 0.5]), rng.choice([0.1, 0.2, rng.random()])) for _ in range(400)]
    frame = spark.createDataFrame(pairs, "a DOUBLE, p DOUBLE")
    assert M.pr_auc(frame, "a", "p").first()[0] == pytest.approx(plain_auc(pairs))
    assert M.pr_curve(frame, "a", "p").count() == len({p for _, p in pairs}) + 1


def test_metric_edges(spark):
    def frame(*rows):
        return spark.createDataFrame(list(rows), "a DOUBLE, p DOUBLE")

    assert M.pr_auc(frame((0.5, 0.1), (0.9, 0.2)), "a", "p").first()[0] is None
    assert M.pr_auc(frame((0.0, 0.1), (0.01, 0.2)), "a", "p").first()[0] is None
    assert M.pr_auc(frame((0.0, 0.1), (0.5, 0.1)), "a", "p").first()[0] == pytest.approx(0.75)
    assert M.r_squared(frame((0.5, 0.1)), "a", "p").first()[0] is None
    assert M.r_squared(frame((0.5, 0.5), (0.5, 0.5)), "a", "p").first()[0] == 1.0
    assert M.r_squared(frame((0.5, 0.4), (0.5, 0.5)), "a", "p").first()[0] == 0.0
    assert M.loglog_fit(frame((0.5, 0.1), (0.0, 0.5)), "a", "p").first().slope is None
    fit = M.loglog_fit(frame((0.01, 0.1), (0.1, 1.0), (1.0, 10.0)), "a", "p").first()
    assert fit.slope == pytest.approx(1) and fit.k == pytest.approx(10) and fit.equation == "y ≈ 1.00e+01x^{1.00}"
    bins = M.histogram(frame((2.0, 0.0), (2.0, 0.0)), "a", 4).orderBy("bin").collect()
    assert [r.rows for r in bins] == [0, 0, 2, 0] and bins[0].bin_start == 1.5
    with pytest.raises(ValueError):
        M.element_loss(F.col("a"), F.col("p"), "hinge")


def test_batch_loss_gives_a_short_batch_full_weight(spark):
    rows = [(i, 0.0, 1.0 if i < 5 else 0.5) for i in range(10)]
    frame = spark.createDataFrame(rows, "id INT, a DOUBLE, p DOUBLE")
    order = {r.id: r.row_index for r in shuffled_index(frame, ["id"], 42).collect()}
    batches = {}
    for i, a, p in rows:
        batches.setdefault(order[i] // 4, []).append(abs(a - p))
    means = [sum(b) / len(b) for b in batches.values()]
    got = M.batch_loss(frame, ["id"], "a", "p", kind="mae", batch_size=4).first()
    assert got.loss == pytest.approx(sum(means) / 3) and got.batches == 3


# ---- splits and batches ---------------------------------------------------


def test_split_sizes_and_rules(spark):
    rows = [(i, "original" if i % 4 else "enriched", 0.1) for i in range(431)]
    frame = spark.createDataFrame(rows, "id INT, epss_status STRING, epss_score DOUBLE")
    done = T.split(frame, ["id"]).collect()
    count = lambda s: sum(r.split == s for r in done)
    originals = sum(s == "original" for _, s, _ in rows)
    assert len(done) == 431 and count("test") == math.ceil(0.2 * originals)
    assert count("validation") == math.ceil(0.1 * (431 - count("test")))
    assert all(r.epss_status == "original" for r in done if r.split == "test")


@pytest.mark.parametrize("highs,lows", [(0, 50), (1, 50), (7, 50), (40, 50), (3, 2), (5, 0)])
def test_foil_batches(spark, highs, lows):
    rows = [(i, 0.02 if i < highs else 0.019) for i in range(highs + lows)]
    frame = spark.createDataFrame(rows, "id INT, s DOUBLE")
    out = T.foil_batches(frame, "s", ["id"], batch_size=8).collect()
    batches = {}
    for r in out:
        batches.setdefault(r.batch, []).append(r)
    size = 8 if highs == 0 else 7
    assert sorted(batches) == list(range(math.ceil(lows / size)))
    assert sorted(r.id for r in out if not r.is_high) == list(range(highs, highs + lows))
    if highs:
        assert all(sum(r.is_high for r in b) == 1 for b in batches.values())
        used = [next(r.id for r in batches[i] if r.is_high) for i in sorted(batches)]
        assert len(set(used)) == min(highs, len(used))
        assert used[highs:] == used[: max(0, len(used) - highs)]
    with pytest.raises(ValueError):
        T.foil_batches(frame, "s", ["id"], batch_size=1)


def test_experiments_are_thirteen():
    runs = T.experiments()
    assert len(runs) == 13 and len(runs["leave_out_reddit"]) == 5 and runs["only_telegram"] == ("telegram",)


def test_target_round_trip(spark):
    frame = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (None,)], "s DOUBLE")
    for kind in ("identity", "log1p", "logit"):
        back = frame.select(T.invert_target(T.transform_target(F.col("s"), kind), kind).alias("b")).collect()
        assert [r.b for r in back][:3] == pytest.approx([0.0, 0.3, 1.0], abs=2e-6) and back[3].b is None


def test_lookup_join_of_a_hot_key_reads_each_side_once(spark, tmp_path):
    """Nine tenths of the rows on one key, many of them equal."""
    facts = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 3).alias("x")
    )
    dim = spark.range(0, 20_000, 20).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    dim = dim.union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    facts.repartition(6).write.parquet(str(tmp_path / "f"))
    dim.write.parquet(str(tmp_path / "d"))
    facts, dim = (spark.read.parquet(str(tmp_path / n)) for n in "fd")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(facts, dim, ["k"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        rows = joined.groupBy("k", "v").count().collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.k, r.v): r["count"] for r in rows if r.k == "hot"} == {("hot", -1): 18_000}
    assert len(rows) == 2001 and sum(r["count"] for r in rows) == 20_000
    assert all(r.v == (int(r.k) if int(r.k) % 20 == 0 else None) for r in rows if r.k != "hot")
    # One scan of whole rows of each side, and the keys alone for the sketch.
    scans = [x for x in plain_plan(plan) if "FileScan parquet" in x]
    assert sum("ReadSchema: struct<k:string,x:bigint>" in x for x in scans) == 1
    assert sum("ReadSchema: struct<k:string,v:bigint>" in x for x in scans) == 1
    assert max(r["count"] for r in sizes) < 9000


def plain_plan(plan):
    return plan.split("Initial Plan")[-1].splitlines()


def test_lookup_join_with_maps_and_null_keys(spark):
    facts = spark.createDataFrame([(None, {"a": 1})] * 50 + [("k", None)] * 50, "k string, m map<string,int>")
    dim = spark.createDataFrame([(None, 1), ("k", 2)], "k string, v int")
    got = lookup_join(facts, dim, ["k"]).groupBy("k", "v").count().collect()
    assert {(r.k, r.v): r["count"] for r in got} == {(None, None): 50, ("k", 2): 50}
    known = spark.createDataFrame([(None, 1, 50), ("k", 2, 50)], "k string, v int, n long")
    got = lookup_join(facts, known, ["k"], "inner", weight="n").groupBy("k", "v").count().collect()
    assert {(r.k, r.v): r["count"] for r in got} == {(None, 1): 50, ("k", 2): 50}
    assert lookup_join(facts.limit(0), dim, ["k"]).count() == 0
    assert lookup_join(facts, known.limit(0), ["k"], weight="n").where("v is not null").count() == 0
