import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cvebeacon import schemas
from cvebeacon.operators import enrich as E

BASE = dt.date(2024, 3, 1)


def day(n):
    return BASE + dt.timedelta(days=n)


def history(spark, rows):
    return spark.createDataFrame([(c, day(n), e) for c, n, e in rows], schemas.EPSS_HISTORY)


def wanted(spark, rows):
    data = [(i, c, d if d is None or isinstance(d, str) else day(d).isoformat()) for i, (c, d) in enumerate(rows)]
    return spark.createDataFrame(data, "id INT, cve STRING, date STRING")


def scores(df):
    return {r.id: (r.epss_score, r.epss_status) for r in df.collect()}


def test_edge_rows(spark):
    past = history(
        spark,
        [("exact", 0, 0.3), ("exact", 0, 0.2), ("exact", 1, 0.9), ("b30", -30, 0.4), ("b31", -31, 0.4),
         ("a30", 30, 0.5), ("a31", 31, 0.5), ("both", -3, 0.1), ("both", 9, 0.3), ("both", -4, 0.8),
         ("zero_prev", -2, 0.0), ("zero_next", 2, 0.0), ("zero_both", -1, 0.0), ("zero_both", 1, 0.6),
         ("none", 0, None)],
    )
    keys = ["exact", "b30", "b31", "a30", "a31", "both", "zero_prev", "zero_next", "zero_both", "none", "unknown"]
    asked = wanted(spark, [(k, 0) for k in keys] + [("exact", None), (None, 0), ("exact", "soon"), ("exact", 0)])
    got = scores(E.enrich_epss(asked, past))
    want = [0.2, 0.4, None, 0.5, None, 0.2, None, 0.0, 0.3, 0.0, None, None, None, None, 0.2]
    assert [got[i][0] for i in range(15)] == pytest.approx(want)
    assert [i for i in range(15) if got[i][1] == "original"] == [0, 9, 14]
    kept = scores(E.enrich_epss(asked, past, zero_is_missing=False))
    assert kept[6][0] == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_matches_day_by_day_search(spark, seed):
    rng = random.Random(seed)
    past = [(rng.choice("abc"), rng.randint(-90, 90), rng.choice([0.0, 0.1, 0.25, 0.7])) for _ in range(60)]
    asked = [(rng.choice("abcd"), rng.randint(-100, 100)) for _ in range(300)]
    table = {}
    for c, n, e in past:
        table[c, n] = min(e, table.get((c, n), 9))

    def search(c, n):
        if (c, n) in table:
            return table[c, n]
        back = next((table[c, n - k] for k in range(1, 31) if (c, n - k) in table), None)
        ahead = next((table[c, n + k] for k in range(1, 31) if (c, n + k) in table), None)
        if back is not None and ahead is not None:
            return (back + ahead) / 2
        return back or ahead

    rng.shuffle(past)
    got = scores(E.enrich_epss(wanted(spark, asked), history(spark, past)))
    for i, (c, n) in enumerate(asked):
        expected = search(c, n)
        assert got[i][0] == (pytest.approx(expected) if expected is not None else None)
        assert (got[i][1] == "original") == ((c, n) in table)


def test_fill_touches_missing_scores_only(spark):
    past = history(spark, [("a", 0, 0.3), ("b", 2, 0.4)])
    rows = wanted(spark, [("a", 0), ("b", 0), ("a", "soon"), ("c", 0)]).withColumn(
        "epss_score", F.expr("case when id = 0 then 0.9D end")
    ).withColumn("epss_status", F.lit("x"))
    filled = {r.id: r for r in E.fill_missing_scores(rows, past).collect()}
    assert [filled[i].epss_score for i in range(4)] == [0.9, 0.4, None, None]
    assert {r.epss_status for r in filled.values()} == {"x"}
    assert E.fill_missing_scores(rows, past).columns == rows.columns


def test_cvss_versions_fallbacks_and_descriptions(spark):
    def metric(**kw):
        fields = [f.split(":")[0].strip() for f in
                  "baseScore:attackVector:accessVector:attackComplexity:accessComplexity:privilegesRequired:"
                  "authentication:userInteraction:scope:confidentialityImpact:integrityImpact:availabilityImpact".split(":")]
        return [((tuple(kw.get(f) for f in fields)),)]

    en, es = ("en", "first"), ("es", "uno")
    records = [
        ("all", [es, en, ("en", "second")], (metric(baseScore=9.8, attackVector="N"), metric(baseScore=5.0), metric(baseScore=4.0))),
        ("v30", [en], (None, metric(baseScore=5.0, scope="U"), metric(baseScore=4.0))),
        ("v2", [es], (None, None, metric(baseScore=4.0, accessVector="L", accessComplexity="M", authentication="S"))),
        ("bare", None, (None, None, None)),
        ("blank", [en], (metric(baseScore=1.0, attackVector="", accessVector="A"), None, None)),
    ]
    nvd = spark.createDataFrame([((*r, None),) for r in records], schemas.NVD)
    obs = spark.createDataFrame([(r[0],) for r in records] + [("unknown",), (None,)], "cve STRING")
    got = {r.cve: r for r in E.attach_cvss(obs, nvd).collect()}
    assert [got[k].cvss_version for k in ("all", "v30", "v2", "bare", "unknown", None)] == ["3.1", "3.0", "2.0", None, None, None]
    assert got["all"].cvss_score == 9.8 and got["all"].description == "first"
    assert (got["v2"].attack_vector, got["v2"].attack_complexity, got["v2"].privileges_required) == ("L", "M", "S")
    assert got["v2"].description is None and got["v2"].scope is None
    assert got["blank"].attack_vector == "A"
    assert len(got) == 7


def test_usable_needs_every_field(spark):
    fields = schemas.REQUIRED_FOR_USABLE
    full = {f: 1.0 if f.endswith("score") else "x" for f in fields}
    rows = [full] + [{**full, f: None} for f in fields]
    schema = ", ".join(f"{f} {'DOUBLE' if f.endswith('score') else 'STRING'}" for f in fields)
    flags = [r.usable for r in E.with_usable(spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], schema)).collect()]
    assert flags == [True] + [False] * len(fields)


def test_missing_columns_are_errors(spark):
    with pytest.raises(ValueError):
        E.enrich_epss(spark.createDataFrame([("a",)], "cve STRING"), history(spark, [("a", 0, 0.1)]))


def test_plan_has_no_python_and_no_pairwise_join(spark):
    frame = E.enrich(
        spark.createDataFrame([("a", "s", "2024-03-01", "00:00", "t")], schemas.OBSERVATION),
        history(spark, [("a", 0, 0.1)]),
        spark.createDataFrame([], schemas.NVD),
    )
    assert [f"{n} {t}" for n, t in frame.dtypes][5:7] == ["epss_score double", "epss_status string"]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan
