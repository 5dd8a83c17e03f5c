import random

import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cvebeacon import schemas
from cvebeacon.operators import features as Fe
from cvebeacon.operators import pages as P
from cvebeacon.operators import training as T
from cvebeacon.operators import vectors as V
from cvebeacon.operators.threads import top_thread

# ---- tokens and vectors ---------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 6, 7, 10, 11, 40])
def test_windows(spark, n):
    tokens = [f"t{i}" for i in range(n)]
    row = spark.createDataFrame([(tokens,)], "t ARRAY<STRING>")
    got = row.select(V.overlapping_windows(F.col("t"), 8).alias("w"), V.token_chunks(F.col("t"), 6).alias("c")).first()
    assert got.w == ([tokens[i:i + 6] for i in range(0, n, 3)] or [[]])
    assert got.c == [tokens[i:i + 6] for i in range(0, n, 6)]


def test_tokens_route_and_wrap(spark):
    row = spark.createDataFrame([(" a  b\n",), (None,)], "t STRING").select(V.whitespace_tokens(F.col("t")).alias("t"))
    assert [r.t for r in row.collect()] == [["a", "b"], []]
    assert [r[0] for r in row.select(V.token_route(F.col("t"), 1)).collect()] == ["long", "short"]
    assert row.select(V.wrap_window(F.col("t"))).first()[0] == ["<s>", "a", "b", "</s>"]


def test_pooling_and_normalising(spark):
    rows = [(1, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 0, [9.0, 9.0]), (2, 0, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "k INT, m INT, a ARRAY<DOUBLE>").withColumn("v", array_to_vector("a"))
    masked = {r.k: list(r.vector.toArray()) for r in V.masked_mean(frame, ["k"], "v", "m").collect()}
    assert masked == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    docs = spark.createDataFrame([(1,), (3,)], "k INT")
    whole = {r.k: list(r.vector.toArray()) for r in V.document_vectors(docs, "k", frame, "v", 2).collect()}
    assert whole[3] == [0.0, 0.0] and whole[1] == pytest.approx([13 / 3, 5.0])
    unit = V.l2_normalize(spark.createDataFrame([(Vectors.dense(3.0, 4.0),), (Vectors.dense(0.0, 0.0),)], ["v"]), "v", "u")
    assert [list(r.u.toArray()) for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert V.flatten_vector(frame.select("k", "v"), "v", 2).columns == ["k", "text_emb_0", "text_emb_1"]


def test_encoders_and_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encode(df, text, out):
        @F.pandas_udf("array<double>")
        def length(t: pd.Series) -> pd.Series:
            calls.add(len(t))
            return t.map(lambda x: [float(len(x)), 1.0])

        return df.withColumn(out, array_to_vector(length(F.col(text))))

    V.register_encoder("length", encode)
    frame = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None)], "id INT, t STRING")
    path = str(tmp_path / "cache")
    first = {r.id: list(r.vector.toArray()) for r in V.load_or_compute(frame, "t", "length", path).collect()}
    assert first == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0]}
    asked = calls.value
    edited = frame.withColumn("t", F.expr("case when id = 2 then 'cccc' else t end"))
    again = {r.id: list(r.vector.toArray()) for r in V.load_or_compute(edited, "t", "length", path).collect()}
    assert again[2] == [4.0, 1.0] and asked == 3 and calls.value == 4
    with pytest.raises(ValueError):
        V.get_encoder("sbert9")
    hashed = V.get_encoder("hybrid")(frame, "t", "v").select("id", V.vector_to_array("v").alias("v")).collect()
    assert len(hashed) == 4 and {round(sum(x * x for x in r.v), 6) for r in hashed} == {0.0, 1.0}
    chunked = V.chunked_encoder(encode, 4, 2, "id")(frame, "t", "v")
    assert chunked.count() == 4


# ---- features -------------------------------------------------------------


def enriched(spark, rows):
    names = ["id", "source", "text", "description", "cvss_score", *schemas.CVSS_CATEGORICALS]
    kinds = {"id": "INT", "cvss_score": "DOUBLE"}
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{n} {kinds.get(n, 'STRING')}" for n in names))


def test_one_hot_is_stable_across_subsets(spark):
    frame = enriched(spark, [{"id": 1, "scope": "U"}, {"id": 2, "scope": None}, {"id": 3, "scope": "C"}])
    categories = Fe.observed_categories(frame)
    assert categories["scope"] == ["C", "NONE", "U"] and categories["attack_vector"] == ["NONE"]
    whole, names = Fe.cvss_one_hot(frame)
    part, same = Fe.cvss_one_hot(frame.filter("id = 1"), categories)
    assert names == same and [n for n in names if n.startswith("scope")] == ["scope_C", "scope_NONE", "scope_U"]
    assert part.first().scope_U == 1.0 and part.first().scope_C == 0.0
    with pytest.raises(ValueError):
        Fe.observed_categories(frame, ["scope"], limit=2)


def test_assemble(spark):
    frame = enriched(spark, [
        {"id": 1, "source": "Reddit_22", "text": "a b", "description": "c", "cvss_score": 9.0},
        {"id": 2, "source": "mastodon", "text": "a b"},
        {"id": 3},
    ])
    V.register_encoder("tiny", V.hashing_encoder(4))
    config = Fe.FeatureConfig(encoder="tiny", vector_size=4)
    rows = {r.id: r.features for r in Fe.assemble_features(frame, config).collect()}
    assert {v.size for v in rows.values()} == {4 + 4 + 1 + 8 + 6}
    assert rows[1][8] == pytest.approx(0.9) and rows[3][8] == 0.0
    assert [rows[1][17 + i] for i in range(6)] == [0, 1, 0, 0, 0, 0] and sum(rows[3].toArray()) == 8
    two = T.experiment_config(config, ("reddit", "telegram"))
    part = {r.id: r.features for r in Fe.assemble_features(frame, two).collect()}
    assert {v.size for v in part.values()} == {16 + 1 + 8 + 2} and len(part) == 3
    assert sum(part[1].toArray()[:4]) > 0 and sum(part[1].toArray()[4:8]) == 0 and sum(part[2].toArray()[:16]) == 0
    with pytest.raises(ValueError):
        Fe.assemble_features(frame, Fe.FeatureConfig((), False, False, False, False))


def test_regression_beats_a_constant(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x = rng.random()
        rows.append((i, "original" if i % 2 else "enriched", 0.02 + 0.6 * x, Vectors.dense(x, rng.random())))
    frame = spark.createDataFrame(rows, ["id", "epss_status", "epss_score", "features"])
    for config in (T.RegressionConfig(), T.RegressionConfig("log1p", "trees", max_iter=5)):
        done = T.fit_predict(T.split(frame, ["id"]), config=config)
        got = done.filter("split = 'test'").selectExpr("avg(abs(predicted - epss_score)) e", "min(predicted) a", "max(predicted) b").first()
        assert got.e < 0.08 and got.a >= 0 and got.b <= 1


def test_run_experiments(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        source = rng.choice(["reddit_1", "mastodon_2"])
        rows.append({"id": i, "source": source, "text": "t", "cvss_score": 9.0, "scope": "U"})
    frame = enriched(spark, rows).withColumn("epss_status", F.lit("original")).withColumn(
        "epss_score", F.expr("case when source = 'reddit_1' then 0.4D else 0.004D end")
    )
    config = Fe.FeatureConfig(text=False, description=False)
    runs = {"all_sources": Fe.SOURCES, "only_hackernews": ("hackernews",)}
    got = {r.experiment: r for r in T.run_experiments(frame, ["id"], config, T.RegressionConfig(max_iter=20), runs).collect()}
    assert got["all_sources"].r2 > 0.9 and got["all_sources"].pr_auc == pytest.approx(1.0)
    assert got["only_hackernews"].r2 < 0.1 and got["only_hackernews"].test_loss > got["all_sources"].test_loss


# ---- threads --------------------------------------------------------------


def plain_thread(rows, post):
    kids = {}
    for p, c, parent, score, _, text in rows:
        if p == post:
            kids.setdefault(parent, []).append((-score, c, text))

    def walk(parent, level):
        for score, c, _ in sorted(kids.get(parent, [])):
            yield c, level
            if level < 2:
                yield from walk(c, level + 1)

    top = sorted(kids.get(None, []))[:1]
    return [(top[0][1], 0), *walk(top[0][1], 1)] if top else []


def test_top_thread(spark):
    rng = random.Random(2)
    rows = []
    for post in range(30):
        for c in range(1, rng.randint(1, 60)):
            parent = None if c < 4 else rng.choice([None, rng.randint(1, c - 1), rng.randint(1, c - 1)])
            rows.append((post, c, parent, rng.choice([-5, 0, 3, 3, 12, 105]), "u", f" t{c}\n"))
    frame = spark.createDataFrame(rows, "post LONG, comment LONG, parent LONG, score LONG, author STRING, text STRING")
    got = {}
    for r in top_thread(frame).orderBy("post", "path").collect():
        got.setdefault(r.post, []).append((r.comment, r.level))
        assert r.text == f"t{r.comment}"
    assert got == {p: plain_thread(rows, p) for p in {r[0] for r in rows}}


# ---- pages ----------------------------------------------------------------

NEWS = """<html><div class="td-post-content tagdiv-type"><p> One <b>bold</b> &amp; x </p><div><p>no</p></div>
<h2>Head<br>er</h2><!-- c --><script>s()</script><p>Two</p><p>last, dropped</p></div></html>"""
RED = """<h2 class="x wp-block-heading"><a>News</a></h2><p>no</p><h2 class="wp-block-heading"><span><a href="#">
CVE-2024-1 out</a></span></h2><div>gap</div><p> The <i>text</i> </p><p>more</p>"""


def test_extraction_rules():
    news, red = P.BodyRule(), P.HeadingRule()
    assert news.extract(P.parse(NEWS)) == "Onebold& x\n\nHeader\n\nTwo"
    assert news.extract(P.parse("<div class='tagdiv-type td-post-content'><p>a</p></div>")) == "None"
    assert news.extract(P.parse("<div class='td-post-content tagdiv-type'><p>a</p></div>")) is None
    assert red.extract(P.parse(RED)) == "Thetext"
    assert red.extract(P.parse("<h2 class='wp-block-heading'><a>CVE-1</a></h2>")) is None
    assert red.extract(P.parse("<h2><a>CVE-1</a></h2><p>a</p>")) is None


def test_extract_articles(spark):
    rows = [("https://www.cybersecuritynews.com/a", NEWS), ("https://redpacketsecurity.com/b", RED),
            ("https://other.test", NEWS), ("https://redpacketsecurity.com/cybersecuritynews.com", RED), (None, NEWS),
            ("https://cybersecuritynews.com/x", None)]
    got = P.extract_articles(spark.createDataFrame(rows, "url STRING, html STRING")).collect()
    assert [r.article_text for r in got] == ["Onebold& x\n\nHeader\n\nTwo", "Thetext", None, "Thetext", None, None]


def test_threads_of_text_ids_and_wide_scores(spark):
    """Ids longer than 19 characters, scores at the ends of a long, missing and equal ones."""
    low, high = -(2**63), 2**63 - 1
    rows = [
        ("p", "t1_00000000000000000b", None, None), ("p", "t1_00000000000000000a", None, low), ("p", "t1_x", None, None),
        ("p", "r" * 30, "t1_00000000000000000a", high), ("p", "q", "t1_00000000000000000a", None),
        ("p", "s", "t1_00000000000000000a", -10**15), ("p", "s2", "t1_00000000000000000a", -10**15), ("p", "u", "s", 1),
        ("other", "only", None, None),
    ]
    frame = spark.createDataFrame([(*r, "u", "t") for r in rows], "post STRING, comment STRING, parent STRING, score LONG, author STRING, text STRING")
    got = [(r.comment, r.level) for r in top_thread(frame.filter("post = 'p'")).orderBy("path").collect()]
    assert got == [("t1_00000000000000000a", 0), ("r" * 30, 1), ("s", 1), ("u", 2), ("s2", 1), ("q", 1)]
    assert [r.comment for r in top_thread(frame.filter("post = 'other'")).collect()] == ["only"]
    assert top_thread(frame.limit(0)).count() == 0
    doubles = frame.withColumn("score", F.col("score").cast("double"))
    assert [r.comment for r in top_thread(doubles.filter("post = 'p'")).orderBy("path").collect()] == [c for c, _ in got]
