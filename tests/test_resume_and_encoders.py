"""Sliced jobs, category tables and the two-model encoder."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cvebeacon import schemas
from cvebeacon.operators import enrich as E
from cvebeacon.operators import features as Fe
from cvebeacon.operators import vectors as Ve
from cvebeacon.operators.resume import SlicedJob, enrich_in_slices


class Killed(Exception):
    pass


@pytest.fixture(scope="module")
def inputs(spark):
    posts = [(i, None if i % 19 == 0 else f"CVE-{i % 7}", f"2024-01-{i % 28 + 1:02}") for i in range(300)]
    scores = [(f"CVE-{i % 7}", f"2024-01-{i % 25 + 1:02}", i / 100) for i in range(60)]
    data = {"baseScore": 5.0, "attackVector": "LOCAL"}
    metrics = {"cvssMetricV31": [{"cvssData": data}], "cvssMetricV30": None, "cvssMetricV2": None}
    records = [({"id": f"CVE-{i}", "descriptions": [], "metrics": metrics, "lastModified": None},) for i in range(5)]
    return (
        spark.createDataFrame(posts, "i long, cve string, date string"),
        spark.createDataFrame(scores, "cve string, date string, epss double").withColumn("date", F.col("date").cast("date")),
        spark.createDataFrame(records, schemas.NVD),
    )


def test_killed_at_every_slice(spark, inputs, tmp_path):
    want = sorted(map(repr, E.enrich(*inputs).collect()))
    job = SlicedJob(str(tmp_path / "job"), 3)
    done = []

    def written(number):
        done.append(number)
        if done.count(number) == 1:
            raise Killed

    for expected in range(3):
        with pytest.raises(Killed):
            enrich_in_slices(*inputs, job, written=written)
        assert sorted(job.finished(spark)) == list(range(expected))
    got = enrich_in_slices(*inputs, job, written=written)
    assert sorted(map(repr, got.collect())) == want
    assert done == [0, 0, 1, 1, 2, 2]
    # Another call does nothing, and reads the inputs as they were staged.
    again = enrich_in_slices(inputs[0].limit(0), inputs[1], inputs[2], job, written=written)
    assert sorted(map(repr, again.collect())) == want and len(done) == 6
    assert len(list((tmp_path / "job" / "result" / "1").iterdir())) == 2


def test_lost_rows_are_an_error(spark, inputs, tmp_path):
    job = SlicedJob(str(tmp_path / "job"), 2)
    enrich_in_slices(*inputs, job)
    job._finish(spark, "0", 0, job.finished(spark)[0][0], 1)
    with pytest.raises(ValueError, match="enriched rows for 300 posts"):
        enrich_in_slices(*inputs, job)


@pytest.mark.parametrize("limit", [1, 100_000])
def test_category_vectors_equal_named_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(Fe, "BROADCAST_VALUES", limit)
    rows = [(i, None if i % 5 == 0 else f"v{i % 3}", "x" if i % 2 else "NONE") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, attack_vector string, scope string")
    columns = ["attack_vector", "scope"]
    wide, names = Fe.cvss_one_hot(df, Fe.observed_categories(df, columns))
    sparse, vectors = Fe.categories_one_hot(df, Fe.category_table(df, columns), columns)
    got = {r.i: [*r.a, *r.b] for r in sparse.select("i", *[vector_to_array(v).alias(n) for v, n in zip(vectors, "ab", strict=True)]).collect()}
    assert got == {r["i"]: [r[n] for n in names] for r in wide.collect()} and len(got) == 60
    few = Fe.categories_one_hot(df.limit(1), Fe.category_table(df, columns), columns)[0].first()
    assert few["__attack_vector_vector"].size == 4
    assert Fe.categories_one_hot(df.limit(0), Fe.category_table(df.limit(0), columns), columns)[1] == []


def test_many_categories(spark):
    df = spark.range(6000).select(F.concat(F.lit("v"), F.col("id")).alias("c")).repartition(5)
    table = {r["value"]: r["position"] for r in Fe.category_table(df, ["c"]).collect()}
    assert [v for v, _ in sorted(table.items(), key=lambda x: x[1])] == sorted(f"v{i}" for i in range(6000))


def test_wide_category_vectors_name_no_position_in_the_driver(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id")).alias("c"), F.lit("x").alias("d"), F.col("id") / 2)
    encoded, names = Fe.categories_one_hot(df, Fe.category_table(df, ["c", "d"]), ["c", "d"])
    joined = Fe.joined_vectors(encoded, names, "v")
    assert all(joined.schema[c].metadata == {} for c in [*names, "v"])
    rows = joined.select("c", F.unwrap_udt("v").alias("v")).collect()
    places = {v: i for i, v in enumerate(sorted(r["c"] for r in rows))}
    assert all(list(r["v"]) == [0, 5001, [places[r["c"]], 5000], [1.0, 1.0]] for r in rows) and len(rows) == 5000


def test_joined_vectors_equal_the_assembler(spark):
    rows = [
        (float(i), Vectors.dense([0.0, i % 3]), Vectors.sparse(9, {i % 9: 1.0}), Vectors.sparse(2, [1], [0.0 if i % 2 else 2.0]))
        for i in range(50)
    ]
    df = spark.createDataFrame(rows, ["x", "a", "b", "c"])
    for columns in (["x", "a", "b", "c"], ["b", "c"], ["b", "x"], ["x"]):
        wanted = [r["o"].toArray().tolist() for r in VectorAssembler(inputCols=columns, outputCol="o").transform(df).collect()]
        got = Fe.joined_vectors(df, columns, "o").collect()
        assert [r["o"].toArray().tolist() for r in got] == wanted


def test_joined_vectors_send_no_struct_to_python(spark, capsys):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), Vectors.sparse(9, {3: 1.0}))], ["a", "b"])
    Fe.joined_vectors(df, ["a", "b"], "o").explain()
    sent = capsys.readouterr().out.split("ArrowEvalPython [join(")[1].split(")#")[0]
    assert "unwrap_udt(a" in sent and sent.count(".values") == 2 and "join(a#" not in sent


def unit(tokens, size=8):
    counts = np.zeros(size)
    for t in tokens:
        counts[hashlib.md5(t.encode()).digest()[0] % size] += 1
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def test_two_models_in_one_pass(spark):
    texts = [None, "", " ", "A b", "one two three", *[" ".join(f"w{i * k}" for i in range(k)) for k in (4, 5, 6, 11)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def short():
        calls.add(1)
        return Ve.digest_model(8)

    encode = Ve.hybrid_batch_encoder(short, lambda: Ve.chunk_mean_model(Ve.digest_model(8), 5), 5)
    encoded = encode(df, "t", "v")
    assert encoded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.i: r.v.toArray() for r in encoded.collect()}
    for i, text in enumerate(texts):
        tokens = (text or "").lower().split()
        parts = [tokens[k : k + 5] for k in range(0, max(len(tokens), 1), 5)] if len(tokens) > 5 else [tokens]
        assert np.allclose(got[i], np.mean([unit(p) for p in parts], axis=0)), text
    assert 1 <= calls.value <= 3
