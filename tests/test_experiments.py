"""Gram-matrix experiments, the vector store and versioned severity against plain Python."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cvebeacon import schemas
from cvebeacon.operators import enrich as E
from cvebeacon.operators import experiments as X
from cvebeacon.operators import features as Fe
from cvebeacon.operators import training as T
from cvebeacon.operators import vectors as Ve
from cvebeacon.operators.ordering import running_totals_by
from cvebeacon.operators.vector_store import VectorStore


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    words = ["leak", "exploit", "patch", "kernel", "browser", "zero", "day"]
    names = [*Fe.SOURCES, "Reddit and Mastodon", "elsewhere", None]
    found = []
    for i in range(1500):
        text = " ".join(draw.choice(words, draw.integers(0, 6))) if i % 11 else None
        source = names[draw.integers(0, len(names))]
        score = float(np.clip(0.01 + 0.03 * ("exploit" in (text or "")) + draw.normal() * 0.01, 0, 1))
        found.append((
            i, source, text, None if i % 7 == 0 else "described " + str(draw.choice(words)),
            None if i % 5 == 0 else float(draw.integers(0, 100)) / 10,
            *[None if draw.random() < 0.1 else str(draw.choice(["LOW", "HIGH"])) for _ in range(8)],
            None if i % 13 == 0 else score, "original" if i % 3 else "enriched",
        ))
    categories = ", ".join(f"{c} string" for c in schemas.CVSS_CATEGORICALS)
    return spark.createDataFrame(
        found, f"id long, source string, text string, description string, cvss_score double, {categories}, "
        "epss_score double, epss_status string",
    ).repartition(4)


def test_every_experiment_against_its_own_fit(spark, rows):
    """Each experiment's features built as such, fitted and measured with numpy."""
    base = Fe.FeatureConfig(encoder="digest", vector_size=8)
    config = X.GramConfig(target="log1p")
    got = {r["experiment"]: r for r in X.experiment_runs(rows, ["id"], base, config).collect()}
    assert set(got) == set(T.experiments()) and len(got) == 13
    table = T.split(T.drop_unscored(rows), ["id"]).cache()
    categories = Fe.observed_categories(table)
    for name, enabled in T.experiments().items():
        wide = Fe.assemble_features(table, T.experiment_config(base, enabled), categories)
        data = wide.select("id", "split", "epss_score", vector_to_array("features").alias("x")).toPandas()
        x, a = np.array(data.x.tolist()), data.epss_score.to_numpy()
        train, test = (data.split == "train").to_numpy(), (data.split == "test").to_numpy()
        w = 1 + (a >= 0.02)
        z = np.column_stack([x, np.ones(len(x))])
        shrink = np.full(z.shape[1], 1e-4 * w[train].sum())
        shrink[-1] = 0
        beta = np.linalg.solve((z[train] * w[train, None]).T @ z[train] + np.diag(shrink), z[train].T @ (w * np.log1p(a))[train])
        p = np.round(np.clip(np.expm1(z[test] @ beta), 0, 1), 9)
        r = got[name]
        assert (r["features"], r["train_rows"], r["test_rows"]) == (x.shape[1], train.sum(), test.sum())
        assert abs(r["r2"] - (1 - ((p - a[test]) ** 2).sum() / (a[test].var() * test.sum()))) < 1e-6
        # One batch per 128 rows in md5 order.
        import hashlib

        order = np.argsort([hashlib.md5(f"{i}:42".encode()).hexdigest() for i in data.id[test]])
        e = np.log1p(p) - np.log1p(a[test])
        loss = (np.where(np.abs(e) <= 1, e * e / 2, np.abs(e) - 0.5) * w[test])[order]
        assert abs(r["test_loss"] - np.mean([loss[k : k + 128].mean() for k in range(0, len(loss), 128)])) < 1e-8
        area, k, tp, positives = 0.0, 0, 0, (a[test] >= 0.02).sum()
        before = 1.0
        for value in sorted(set(p), reverse=True):
            hits = ((a[test] >= 0.02) & (p == value)).sum()
            k, tp = k + (p == value).sum(), tp + hits
            area += hits / positives * (tp / k + before) / 2
            before = tp / k
        assert abs(r["pr_auc"] - area) < 1e-6


def test_experiments_without_blocks_and_with_few_runs(rows):
    base = Fe.FeatureConfig(text=False, description=False, cvss_categorical=False)
    runs = {"two": ("reddit", "telegram")}
    got = X.experiment_runs(rows, ["id"], base, runs=runs).collect()
    assert [(r["experiment"], r["features"]) for r in got] == [("two", 3)]


def test_sums_are_additive(spark):
    draw = np.random.default_rng(8)
    x, y, w = draw.normal(size=(300, 5)), draw.normal(size=300), draw.integers(1, 3, 300)
    mask = draw.integers(0, 4, 300)
    df = spark.createDataFrame(
        [(int(m), a.tolist(), float(b), float(c)) for m, a, b, c in zip(mask, x, y, w, strict=True)],
        "mask int, x array<double>, y double, w double",
    )
    grams = X.gram_matrices(df.repartition(7))
    z = np.column_stack([x, np.ones(300), y])
    for m in range(4):
        part = mask == m
        assert np.abs(grams[m] - (z[part] * w[part, None]).T @ z[part]).max() < 1e-9


def test_no_rows(spark, rows):
    with pytest.raises(ValueError, match="no scored rows"):
        X.experiment_runs(rows.limit(0), ["id"], Fe.FeatureConfig(text=False, description=False))


def test_running_totals_by(spark):
    draw = np.random.default_rng(2)
    data = [(g, v, int(draw.integers(0, 9))) for g in range(3) for v in range(400 if g == 1 else 7)]
    df = spark.createDataFrame(data, "g int, v int, n long").repartition(6)
    for down in (False, True):
        got = {(r.g, r.v): r for r in running_totals_by(df, "g", "v", ["n"], down).collect()}
        assert len(got) == len(data)
        for g, v, _ in data:
            same = [(b, n) for a, b, n in data if a == g]
            assert got[g, v].total_n == sum(n for _, n in same)
            assert got[g, v].running_n == sum(n for b, n in same if (b >= v if down else b <= v))


# ---- vector store -------------------------------------------------------------


def counting(seen):
    def encode(df, text, out):
        n = spark_count(df)
        seen.append(n)
        return Ve.digest_encoder(8)(df, text, out)

    return encode


def spark_count(df):
    return df.count()


def test_second_run_encodes_nothing(spark, tmp_path):
    Ve.register_encoder("digest-other", Ve.digest_encoder(8))
    df = spark.createDataFrame([(i, f"text {i % 50}" if i % 3 else None) for i in range(900)], "id long, t string")
    store = VectorStore(str(tmp_path / "v"), "digest")
    asked = store.asked(df, "t")
    texts = asked.count()
    assert store.fill(asked) == texts
    assert store.fill(asked) == 0
    more = df.union(spark.createDataFrame([(901, "new"), (902, "new")], "id long, t string"))
    assert store.fill(store.asked(more, "t")) == 1
    assert VectorStore(store.path, "digest-other").fill(asked) == texts
    assert spark.read.parquet(store.path).groupBy("model", "text_hash").count().where("count > 1").count() == 0
    got = store.attach(more, "t", "v").collect()
    want = {r["id"]: r["v"] for r in Ve.digest_encoder(8)(more.na.fill(""), "t", "v").collect()}
    assert len(got) == 902 and all(r["v"] == want[r["id"]] for r in got)


def test_only_enabled_rows_are_encoded(spark, rows, tmp_path):
    seen = []
    Ve.register_encoder("counting", counting(seen))
    config = Fe.FeatureConfig(sources=("reddit", "telegram"), encoder="counting", vector_size=8)
    enabled = rows.filter("contains(lower(source), 'reddit') or contains(lower(source), 'telegram')")
    plain, blocks = Fe.text_blocks(rows, "text", "b", config)
    assert seen == [enabled.count()]
    stored, _ = Fe.text_blocks(rows, "text", "b", T.replace(config, store=str(tmp_path / "v")))
    assert seen[1] == enabled.select(F.coalesce("text", F.lit(""))).distinct().count()
    Fe.text_blocks(rows, "text", "b", T.replace(config, store=str(tmp_path / "v")))
    assert len(seen) == 2
    keep = ["id", *blocks]
    a, b = ({r["id"]: r for r in df.select(keep).collect()} for df in (plain, stored))
    assert len(a) == 1500 and a == b


def test_store_reads_only_asked_buckets(spark, tmp_path):
    store = VectorStore(str(tmp_path / "v"), "digest")
    store.fill(store.asked(spark.range(300).select(F.col("id").cast("string").alias("t")), "t"))
    one = store.asked(spark.createDataFrame([("7",)], "t string"), "t")
    plan = store._stored(one)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "PartitionFilters" in x and "model" in x)
    filters = scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    assert f"= {one.first()['bucket']})" in filters and "= digest)" in filters
    assert [r["text_hash"] for r in store._stored(one).collect()] == [one.first()["text_hash"]]


# ---- versions of severity records ------------------------------------------------


def record(cve, modified, score):
    data = {"baseScore": score, "attackVector": "LOCAL"}
    metrics = {"cvssMetricV31": [{"cvssData": data}], "cvssMetricV30": None, "cvssMetricV2": None}
    return ({"id": cve, "descriptions": [], "metrics": metrics, "lastModified": modified},)


def test_newest_version_and_as_of(spark):
    records = [
        record("A", "2024-01-05T10:00:00.000", 1.0), record("A", "2024-03-01T00:00:00.000", 2.0),
        record("A", "2024-03-01T09:00:00.000", 3.0), record("B", None, 4.0), record("B", "2024-02-01T00:00:00", 5.0),
        record("C", "soon", 6.0), record(None, "2024-01-01T00:00:00", 9.0),
    ]
    nvd = spark.createDataFrame(records, schemas.NVD)
    details = {r["cve"]: r["cvss_score"] for r in E.cvss_details(nvd).collect()}
    assert details == {"A": 3.0, "B": 5.0, "C": 6.0, None: 9.0}
    asked = [("A", "2024-01-04", None), ("A", "2024-01-05", 1.0), ("A", "2024-02-29", 1.0), ("A", "2024-03-01", 3.0),
             ("A", "2030-01-01", 3.0), ("B", "2023-01-01", 4.0), ("B", "2024-02-01", 5.0), ("C", "2024-01-01", 6.0),
             ("D", "2024-01-01", None), ("A", "bad", None), ("A", None, None), (None, "2024-06-01", None)]
    obs = spark.createDataFrame([(i, c, d) for i, (c, d, _) in enumerate(asked * 3)], "i long, cve string, date string")
    got = {r["i"]: r["cvss_score"] for r in E.attach_cvss_asof(obs, nvd).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(asked * 3)}
    empty = E.attach_cvss_asof(obs, nvd.limit(0))
    assert empty.count() == len(got) and empty.where("cvss_score is not null").count() == 0


def test_digest_encoder(spark):
    import hashlib

    df = spark.createDataFrame([(1, "Leak leak day"), (2, ""), (3, "  ")], "id int, t string")
    got = {r["id"]: r["v"].toArray() for r in Ve.digest_encoder(8)(df, "t", "v").collect()}
    want = np.zeros(8)
    for token in ("leak", "leak", "day"):
        want[hashlib.md5(token.encode()).digest()[0] % 8] += 1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not got[2].any() and not got[3].any()
