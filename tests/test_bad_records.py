"""Bad JSON records and the counts of unification."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from cvebeacon import schemas
from cvebeacon.operators import unify as U
from cvebeacon.sources import files as S
from cvebeacon.sources.checked import read_json_checked

SCHEMA = "p STRING, n INT, c ARRAY<STRUCT<s:INT>>"


@pytest.fixture()
def store(tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()
    mixed = [
        {"p": "/a", "n": 1, "c": [{"s": 1}]}, {"p": "/b", "n": "x"}, {"p": "/c", "c": [{"s": "y"}, {"s": 2}]},
        7, "text", None, [], {"p": "/d"}, {}, {"p": "/e\nf, [g]", "n": 2, "other": 1},
    ]
    (folder / "mastodon_mixed.json").write_text(json.dumps(mixed, indent=1))
    (folder / "reddit_good.json").write_text(json.dumps([{"p": "/g", "n": 3}, {"p": "/g", "n": 3}]))
    (folder / "one.json").write_text(json.dumps({"p": "/h", "n": 4}))
    (folder / "one_bad.json").write_text(json.dumps({"p": "/i", "n": "z"}))
    (folder / "cut.json").write_text('[{"p": "/j", "n": 5}, {"p": ')
    (folder / "cut_object.json").write_text('{"p": "/k"')
    (folder / "empty.json").write_text("")
    (folder / "none.json").write_text("[]")
    return str(folder)


def test_good_records_stay_beside_bad_ones(spark, store, tmp_path):
    quarantine = str(tmp_path / "q")
    with pytest.warns(UserWarning, match="2 file"):
        got = read_json_checked(spark, store, SCHEMA, quarantine)
    rows = sorted((r["p"] or "", r["n"], r["__file"].rsplit("/", 1)[1]) for r in got.rows.collect())
    assert rows == [
        ("", None, "mastodon_mixed.json"), ("/a", 1, "mastodon_mixed.json"), ("/d", None, "mastodon_mixed.json"),
        ("/e\nf, [g]", 2, "mastodon_mixed.json"), ("/g", 3, "reddit_good.json"), ("/g", 3, "reddit_good.json"),
        ("/h", 4, "one.json"),
    ]
    assert (got.bad_records, got.bad_files) == (6, 2)
    kept = spark.read.parquet(quarantine).collect()
    assert sorted(r["file"].rsplit("/", 1)[1] for r in kept if r["reason"] == "file") == ["cut.json", "cut_object.json"]
    texts = sorted(r["record"] for r in kept if r["reason"] == "record")
    assert texts == sorted(['{"p":"/b","n":"x"}', '{"p":"/c","c":[{"s":"y"},{"s":2}]}', "7", "text", "[]", '{"p": "/i", "n": "z"}'])
    with pytest.warns(UserWarning):
        read_json_checked(spark, store, SCHEMA, quarantine)
    assert spark.read.parquet(quarantine).count() == 2 * len(kept)


def test_json_lines_keep_repeated_lines(spark, tmp_path):
    lines = ['{"p":"/a","n":1}', '{"p":"/b","n":"x"}', '{"p":"/b","n":"x"}', "", "  ", '{"p":', "7",
             '[{"p":"/z","n":4},{"p":"/y","n":"r"}]', '{"p":"/a","n":1}', '{"p":"/d"}']
    (tmp_path / "l.json").write_text("\n".join(lines))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = read_json_checked(spark, str(tmp_path / "l.json"), SCHEMA, lines=True)
    assert sorted(r["p"] for r in got.rows.collect()) == ["/a", "/a", "/d", "/z"]
    assert (got.bad_records, got.bad_files) == (5, 0)
    assert sorted(r["record"] for r in got.bad.collect()) == sorted(
        ['{"p":"/b","n":"x"}'] * 2 + ['{"p":', "7", '{"p":"/y","n":"r"}']
    )


def test_readers_use_it(spark, store, tmp_path):
    with pytest.warns(UserWarning):
        tagged = S.read_json_folder(spark, store, SCHEMA, quarantine=str(tmp_path / "q"))
    assert sorted((r["p"] or "", r["source"]) for r in tagged.collect())[0] == ("", "mastodon")
    assert tagged.columns == ["p", "n", "c", "source"] and tagged.count() == 7
    with pytest.warns(UserWarning):
        assert S.read_or_empty(spark, store, SCHEMA).count() == 7
    one = S.read_json_array(spark, f"{store}/mastodon_mixed.json", SCHEMA, quarantine=str(tmp_path / "q2"))
    assert one.count() == 4 and one.columns == ["p", "n", "c"]
    absent = read_json_checked(spark, str(tmp_path / "nowhere"), SCHEMA, str(tmp_path / "q3"))
    assert absent.rows.count() == 0 and absent.bad.count() == 0 and not (tmp_path / "q3").exists()
    assert S.read_json_array(spark, str(tmp_path / "nowhere"), SCHEMA, quarantine=str(tmp_path / "q3")).columns == ["p", "n", "c"]


# ---- counts -------------------------------------------------------------------


def sources(spark, folder):
    mastodon = [("CVE-2024-0001, cve-2024-0002", "2024-01-01T10:00:00", "a"), ("CVE-2024-0001", "2024-01-01T10:00:00", "b"),
                ("CVE-2024-0001", "2024-01-01T10:00:00", "b"), ("nothing", None, None), (None, None, None)]
    frames = {
        "mastodon_1": spark.createDataFrame(mastodon, schemas.MASTODON),
        "exploitdb_1": spark.createDataFrame([("none", "2024-01-01", "t")] * 4, schemas.EXPLOITDB),
        "bleepingcomputer_1": spark.createDataFrame([], schemas.EXPLOITDB),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
    return [U.Source(n, spark.read.parquet(f"{folder}/{n}"), clean=n != "exploitdb_1") for n in frames]


def test_counts_of_stages(spark, tmp_path):
    given = sources(spark, str(tmp_path))
    want = [("TOTAL", None, None, 3), ("bleepingcomputer_1", 0, 0, 0), ("exploitdb_1", 4, 0, None), ("mastodon_1", 5, 3, 3)]
    stats = U.source_stats(given)
    assert sorted(map(tuple, stats.collect())) == want
    plan = stats._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan parquet") == 3
    merged, again = U.unify_with_stats(given)
    assert sorted(map(tuple, again.collect())) == want
    plain = U.merge(list(U.unify_sources(given).values()))
    assert merged.columns == plain.columns
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_counted_rows_equal_normal_ones(spark, tmp_path):
    frame = sources(spark, str(tmp_path))[0].frame
    counted = U.normalize_counted(frame, "mastodon_1", "csv")
    normal = U.normalize_source(frame, "mastodon_1", "csv")
    real = counted.filter(F.col("cve").isNotNull())
    assert real.filter("raw_rows is not null").count() == 0
    assert sorted(map(tuple, real.drop("raw_rows").collect())) == sorted(map(tuple, normal.collect()))
