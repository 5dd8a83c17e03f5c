"""Rows that formats, keys and metrics must not lose."""

import pytest

from cvebeacon.operators.metrics import r_squared
from cvebeacon.operators.ordering import running_totals
from cvebeacon.operators.upsert import unseen, unseen_unique
from cvebeacon.sources import files as S


def test_json_lines_come_back_whole(spark, tmp_path):
    folder = str(tmp_path / "store")
    S.write_json(spark.range(100).selectExpr("id", "'x' as text").repartition(2), folder)
    schema = "id long, text string"
    for back in (
        S.read_json_array(spark, folder, schema, lines=True),
        S.read_json_folder(spark, folder, schema, lines=True),
        S.read_or_empty(spark, folder, schema, lines=True),
    ):
        assert {r["id"] for r in back.collect()} == set(range(100))


def test_keys_differ_in_microseconds(spark):
    wanted, done = (
        spark.sql(f"select timestamp'2024-05-01 10:00:00.{digits}' as at") for digits in ("123456", "123789")
    )
    assert unseen(wanted, done, ["at"]).count() == 1
    assert unseen_unique(wanted, done, ["at"]).count() == 1
    assert unseen_unique(wanted, wanted, ["at"]).count() == 0


def test_r_squared_skips_unknown_targets(spark):
    rows = [(1.0, 1.1), (2.0, 1.9), (4.0, 4.2)]
    schema = "actual double, predicted double"
    known = r_squared(spark.createDataFrame(rows, schema), "actual", "predicted").first()[0]
    some = spark.createDataFrame([*rows, (None, 3.0), (3.0, None)], schema)
    assert r_squared(some, "actual", "predicted").first()[0] == pytest.approx(known)


@pytest.mark.parametrize("values", [[], [float("inf"), 1.0], [3.0]])
def test_running_totals_on_edges(spark, values):
    rows = spark.createDataFrame([(v, 2) for v in values], "x double, n long")
    found = sorted((r["x"], r["running_n"], r["total_n"]) for r in running_totals(rows, "x", ["n"]).collect())
    assert found == [(v, 2 * (i + 1), 2 * len(values)) for i, v in enumerate(sorted(values))]
