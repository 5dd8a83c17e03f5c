import json

import pytest
from pyspark.sql import functions as F

from cvebeacon import schemas
from cvebeacon.functions import cve as C
from cvebeacon.functions import time as Ti
from cvebeacon.operators import unify as U
from cvebeacon.operators import upsert as Up
from cvebeacon.sources import files as S
from cvebeacon.streaming import ingest as I


def one(spark, value, column, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


# ---- ids and time ---------------------------------------------------------


def test_find_cves(spark):
    text = "cve-2024-123 CVE-2024-1234, Cve-2023-1234567; cve-2022-12345678 xCVE-2021-0001y CVE-2024-1234"
    assert one(spark, text, C.find_cves) == [
        "CVE-2024-1234", "CVE-2023-1234567", "CVE-2022-1234567", "CVE-2021-0001", "CVE-2024-1234",
    ]
    assert one(spark, None, C.find_cves) is None and one(spark, "", C.find_cves) == []
    assert one(spark, "x[CVE-1]; é9", C.keep_cve_characters) == "CVE-19"
    counted = one(spark, text, lambda c: C.cve_counts(C.find_cves(c)))
    assert counted["CVE-2024-1234"] == 2 and len(counted) == 4
    assert one(spark, text, lambda c: C.mention_count(C.cve_counts(C.find_cves(c)), F.lit("CVE-1"))) == 0


def test_timestamps(spark):
    rows = [("2024-03-01T20:31:28",), ("2024-03-01 07:00:00+02:00",), ("2024-03-01",), ("soon",), (None,)]
    got = Ti.split_timestamp(spark.createDataFrame(rows, "Posted_At STRING")).collect()
    assert [(r.date, r.time) for r in got] == [
        ("2024-03-01", "20:31"), ("2024-03-01", "05:00"), ("2024-03-01", "00:00"), (None, None), (None, None),
    ]
    numeric = spark.createDataFrame([(1709325088.9,), (float("nan"),), (1e30,), (None,)], "created_utc DOUBLE")
    assert [(r.date, r.time) for r in Ti.split_timestamp(numeric).collect()] == [
        ("2024-03-01", "20:31"), (None, None), (None, None), (None, None),
    ]
    first = spark.createDataFrame([("2024-01-02", "2020-01-01")], "datetime STRING, timestamp STRING")
    assert Ti.split_timestamp(first).first().date == "2024-01-02"
    assert Ti.split_timestamp(spark.range(1)).columns == ["id"]
    assert one(spark, 1709325088, Ti.epoch_to_iso, "LONG") == "2024-03-01T20:31:28"
    assert one(spark, "x", Ti.iso_date) is None
    with pytest.raises(Exception, match="not an ISO timestamp"):
        one(spark, "x", lambda c: Ti.iso_date(c, strict=True))


# ---- files ----------------------------------------------------------------


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    rows = [("CVE-2024-0001", "2024-01-01", 'a "quoted", text\nsecond line'), (None, "x", "")]
    S.write_csv(spark.createDataFrame(rows, schemas.MASTODON), str(tmp_path / "m"))
    back = S.read_csv(spark, str(tmp_path / "m"), schemas.MASTODON).collect()
    assert ("CVE-2024-0001", "2024-01-01", 'a "quoted", text\nsecond line') in [tuple(r) for r in back]
    telegram = tmp_path / "telegram_21_05.csv"
    telegram.write_text('CVE ID,CVE ID.1,Timestamp,Message\nCVE-2024-1111,x,2024-01-01T00:00:00,"say ""hi"""\n')
    read = S.with_file_stem(S.read_csv(spark, str(telegram), schemas.TELEGRAM)).first()
    assert read["Message"] == 'say "hi"' and read.source == "telegram_21_05"


def test_json_array_folder_and_source_names(spark, tmp_path):
    post = {"permalink": "/p", "title": "T", "cves": ["CVE-2024-0001"], "cve_counts": {"CVE-2024-0001": 2},
            "comments": [{"score": 1, "text": "c", "level": 0}]}
    (tmp_path / "My_Reddit.json").write_text(json.dumps([post, {**post, "permalink": "/q"}], indent=2))
    (tmp_path / "mastodon_1.json").write_text(json.dumps({**post, "permalink": "/é"}))
    (tmp_path / "notes.txt").write_text("[]")
    got = {r.permalink: r for r in S.read_json_folder(spark, str(tmp_path), schemas.REDDIT_RAW).collect()}
    assert {k: v.source for k, v in got.items()} == {"/p": "reddit", "/q": "reddit", "/é": "mastodon"}
    assert got["/p"].cve_counts == {"CVE-2024-0001": 2} and got["/p"].comments[0].level == 0
    assert S.read_json_array(spark, str(tmp_path / "My_Reddit.json"), schemas.REDDIT_RAW).count() == 2
    names = ["a/telegram_reddit.json", "x.csv", ".hidden", "dir.v2/Mastodon.tar.gz"]
    rows = spark.createDataFrame([(n,) for n in names], "n STRING").select(
        S.source_from_name(F.col("n")), S.source_from_stem(F.col("n"))
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("reddit", "telegram_reddit"), ("unknown", "x"), ("unknown", ".hidden"), ("mastodon", "Mastodon.tar"),
    ]


def test_absent_or_corrupt_store_is_empty(spark, tmp_path):
    schema = "permalink STRING"
    assert S.read_or_empty(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text('[{"permalink": "/a"}, {"perm')
    assert S.read_or_empty(spark, str(tmp_path / "bad.json"), schema).count() == 0
    (tmp_path / "good.json").write_text('[{"permalink": "/a"}]')
    assert S.read_or_empty(spark, str(tmp_path / "good.json"), schema).columns == ["permalink"]
    assert S.read_or_empty(spark, str(tmp_path / "good.json"), schema).count() == 1


def test_json_sink_keeps_text_and_nulls(spark, tmp_path):
    S.write_json(spark.createDataFrame([("é<b>", None)], "a STRING, b STRING"), str(tmp_path / "j"))
    assert "".join(f.read_text() for f in (tmp_path / "j").glob("*.json")) == '{"a":"é<b>","b":null}\n'
    S.write_predictions(spark.createDataFrame([(0.1, 0.2, 9)], "t DOUBLE, p DOUBLE, x INT"), str(tmp_path / "p"), "t", "p")
    written = [f.read_text() for f in (tmp_path / "p").glob("*.csv")]
    assert "actual,predicted\n0.1,0.2\n" in written


# ---- unification ----------------------------------------------------------


def test_rename_and_text_rules(spark):
    def frame(names):
        return spark.createDataFrame([tuple("v" for _ in names)], ", ".join(f"`{n}` STRING" for n in names))

    assert U.rename_cve_column(frame(["My CVEs", "b"])).columns == ["cve", "b"]
    for names in (["b"], ["cve", "CVE ID.1"]):
        with pytest.raises(ValueError):
            U.rename_cve_column(frame(names))
    assert "text" in U.text_column(frame(["Message", "x"]), "csv").columns
    assert U.text_column(frame(["body", "text2"]), "csv").columns == ["text", "text2"]
    with pytest.raises(ValueError):
        U.text_column(frame(["message"]), "csv")
    joined = spark.createDataFrame([("a", "", None)], "title STRING, text STRING, article_text STRING")
    assert U.text_column(joined, "json").first().text == "a"


def test_normalize_source(spark):
    rows = [("cve-2024-0001, CVE-2024-0002 cve-2024-0001", "2024-01-01T10:00:00", "t")] * 2 + [("none", "x", "t"), (None, "x", "t")]
    got = U.normalize_source(spark.createDataFrame(rows, "cve STRING, created_at STRING, body STRING"), "mastodon_1", "csv")
    assert sorted(tuple(r) for r in got.collect()) == [
        (f"CVE-2024-000{n}", "mastodon_1", "2024-01-01", "10:00", "t") for n in (1, 2)
    ]
    undated = spark.createDataFrame([("CVE-2024-0001", "2024-01-01", "t")], schemas.EXPLOITDB)
    assert tuple(U.normalize_source(undated, "exploitdb", "csv").first()) == ("CVE-2024-0001", "exploitdb", "2024-01-01", None, "t")
    # duplicates are judged over all columns of the source, not the five kept
    extra = spark.createDataFrame([("CVE-2024-0001", "t", 1), ("CVE-2024-0001", "t", 2)], "cve STRING, text STRING, likes INT")
    assert U.normalize_source(extra, "x", "csv").count() == 2


def test_loaders(spark):
    rows = [(" CVE-1, CVE-2 ", "2024-01-01 10:00:00", "t"), ("  ", "2024-01-01", "t"), (None, "2024-01-01", "t")]
    loaded = U.load_source(spark.createDataFrame(rows, schemas.EXPLOITDB), "exploitdb").collect()
    assert [tuple(r) for r in loaded] == [("CVE-1, CVE-2", "2024-01-01", "exploitdb", "t")]
    with pytest.raises(ValueError):
        U.load_source(spark.range(1), "fax")
    with pytest.raises(Exception, match="not an ISO"):
        U.load_source(spark.createDataFrame([("c", "bad", "t")], schemas.EXPLOITDB), "exploitdb").collect()


def test_clean_posts(spark):
    comments = [(1, "**a** &lt;", 0), (2, "...", 1), (3, " ", 1), (4, None, 1), (5, "plain", None)]
    rows = [([], {}, " T ", "[l](https://x) body", "/a", "ts", None, comments), ([], {}, None, "", "/b", "ts", "...", None)]
    got = {r.permalink: r for r in U.clean_posts(spark.createDataFrame(rows, schemas.REDDIT_RAW)).collect()}
    assert got["/a"].clean_text == "T l body" and got["/b"].clean_text == ""
    assert got["/a"].clean_comments == ["Level 0: a <", "plain"] and got["/b"].clean_comments == []
    assert set(got["/a"].asDict()) == {"cves", "cve_counts", "title", "permalink", "timestamp", "clean_text", "clean_comments"}


def test_urls(spark):
    row = spark.createDataFrame([(False, "https://o", "see http://a/b and https://c.d"), (True, "https://o", None)], "s BOOLEAN, u STRING, t STRING")
    got = [r[0] for r in row.select(U.outbound_urls(F.col("s"), F.col("u"), F.col("t"))).collect()]
    assert got == [["https://o", "http://a/b", "https://c.d"], []]


# ---- incremental ----------------------------------------------------------


def test_append_keeps_stored_rows_and_is_idempotent(spark):
    schema = "permalink STRING, text STRING"
    stored = spark.createDataFrame([("/a", "old"), (None, "old")], schema)
    new = spark.createDataFrame([("/a", "new"), ("/b", "new"), ("/b", "twin"), (None, "new")], schema)
    once = Up.append_posts(stored, new)
    assert sorted(once.collect(), key=str) == sorted([("/a", "old"), (None, "old"), ("/b", "new"), ("/b", "twin")], key=str)
    assert Up.append_posts(once, new).count() == 4
    assert Up.append_posts(spark.createDataFrame([], schema), new).count() == 4


def test_first_per_key_and_resume(spark):
    frame = spark.createDataFrame([("/a", "2", {"x": 1}), ("/a", "1", {"y": 2}), (None, "3", None), (None, "4", None)],
                                  "permalink STRING, title STRING, m MAP<STRING,INT>")
    got = {r.permalink: (r.title, r.m) for r in Up.first_per_key(frame).collect()}
    assert got == {"/a": ("1", {"y": 2}), None: ("3", None)}
    wanted, done = spark.range(10), spark.range(4)
    assert Up.pending(wanted, done, ["id"]).count() == 6
    Up.check_resume(wanted, done, ["id"])
    with pytest.raises(ValueError):
        Up.check_resume(done, wanted, ["id"])


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    schema = "permalink STRING, title STRING, text STRING, ts TIMESTAMP"
    source, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    rows = [(f"/p{i % 40}", f"t{i % 40}", "cve-2024-1234" if i % 3 else "nothing", None) for i in range(120)]

    def drop(part, name):
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00'"))
        frame.coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        arriving = I.posts_with_cve(spark.readStream.schema(schema).parquet(f"{source}/*"))
        I.ingest(arriving, store, schema, progress, time="ts", order=["title"]).awaitTermination()
        return I.read_store(spark, store, schema)

    drop(rows[:50], "a")
    run()
    drop(rows[30:], "b")
    stored = run()
    expected = {p for p, _, t, _ in rows if "cve" in t}
    assert sorted(r.permalink for r in stored.collect()) == sorted(expected)
    # the same batch again rewrites its own folder only
    last = max(r.ingest_batch for r in stored.collect())
    job = stored.first().ingest_job
    again = spark.createDataFrame([(p, "t", "cve", None) for p in expected], schema)
    I.store_batch(store, schema, job)(again, last + 1)
    I.store_batch(store, schema, job)(again, last + 1)
    assert I.read_store(spark, store, schema).count() == len(expected)
    fresh = spark.createDataFrame([("/new", "t", "cve", None)], schema)
    for _ in range(2):
        I.store_batch(store, schema, "another_job")(fresh, 0)
    assert I.read_store(spark, store, schema).count() == len(expected) + 1


def test_recent_only(spark):
    frame = spark.sql("select timestamp'2024-01-01 10:00:00' ts union all select timestamp'2024-01-01 08:00:00'")
    assert I.recent_only(frame, "ts", now=F.expr("timestamp'2024-01-01 10:30:00'")).count() == 1
