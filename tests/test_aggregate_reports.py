import pytest
from pyspark.sql import functions as F

from panelkit.functions.scalar import round_even, safe_pct
from panelkit.operators.aggregate import group_agg, joined_distinct
from panelkit.plans import reports as R

from conftest import rows

AGG = {"s": "sum", "m": "mean"}


@pytest.fixture(scope="module")
def panel(spark):
    data = [  # entity, year, region, active, s, m, name, email
        (1, 2021, "N", 1, 10.0, 1.0, "a", "a@x.hu"),
        (1, 2022, "N", 1, 30.0, None, "a", "a@x.hu"),
        (2, 2021, "N", 0, 0.0, 3.0, "b", None),
        (2, 2022, "N", 0, None, None, "b", None),
        (3, 2022, "S", 1, 5.0, 2.0, "c", "c@x.hu"),
        (4, None, None, 1, None, None, "d", "d@x.hu"),
    ]
    return spark.createDataFrame(
        data, "entity_id int, year int, region string, active int, s double, m double, "
              "entity_name string, email string")


def test_sum_of_nothing_is_zero_mean_of_nothing_is_null(spark):
    df = spark.createDataFrame([("g", None, None)], "g string, s double, m double")
    r = group_agg(df, ["g"], AGG).collect()[0]
    assert r.s == 0.0 and r.m is None


def test_safe_pct_and_half_even(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (1.0, 4.0), (0.125, 1.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_pct("n", "d")).collect()]
    assert got == [0.0, 0.0, 25.0, 12.5]
    assert df.select(round_even(F.lit(0.125), 2)).first()[0] == 0.12


def test_joined_distinct_sorted_and_empty(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, e string")
    got = {r.k: r.j for r in df.groupBy("k").agg(joined_distinct("e").alias("j")).collect()}
    assert got == {1: "a; b", 2: ""}


def test_report_totals_values(panel):
    out = {r.metric: r for r in R.report_totals(panel, {"years": [2021, 2022]}, AGG).collect()}
    s = out["s"]
    assert (s.y2021, s.y2022) == (10.0, 35.0)
    assert (s.y2021_avg, s.y2022_avg) == (5.0, 11.67)          # 10 / 2 entities, 35 / 3
    assert s.growth == 6.67 and s.growth_pct == 133.33
    m = out["m"]
    assert (m.y2021, m.y2022) == (2.0, 2.0) and m.growth == 0.0


def test_report_growth_divisor_is_all_years(panel):
    cfg = {"group_col": "region", "metric": "s", "years": [2021, 2022]}
    r = {x.region: x for x in R.report_regional_growth(panel, cfg, AGG).collect()}
    n = r["N"]
    assert (n.s_2021, n.s_2022) == (10.0, 30.0)
    assert (n.s_2021_per_entity, n.s_2022_per_entity) == (5.0, 15.0)   # 2 entities over both years
    assert n.s_change_per_entity == 10.0 and n.s_change_pct_per_entity == 200.0
    sth = r["S"]
    assert sth.s_2021 == 0.0 and sth.s_change_pct_per_entity == 0.0    # zero base -> 0


def test_single_metric_steps(panel):
    r = R.report_single_metric(panel, {"group_col": "region", "metric": "s", "years": [2021, 2022]}, AGG)
    n = [x for x in r.collect() if x.region == "N"][0]
    assert (n.diff_2022, n.pct_2022, n.total_diff) == (20.0, 200.0, 20.0)


def test_entity_report_unknown_raises(panel):
    with pytest.raises(ValueError, match="no data"):
        R.report_entity(panel, {"group_col": "region", "entity": "nowhere"}, AGG)


def test_missing_report(panel, spark):
    joined = spark.createDataFrame([(1, "m1@x.hu; m2@x.hu")], "entity_id int, management_email string")
    out = {r.entity_id: r for r in R.report_missing(panel, {"year": 2022}, joined).collect()}
    # entity 4 has no year at all, entity 2 is inactive, 1 and 3 reported 2022
    assert set(out) == {4} and out[4].email == "d@x.hu" and out[4].management_email == ""


def test_present_years(spark):
    from panelkit.operators.aggregate import present_years
    df = spark.range(0, 40).select((F.col("id") % 12 + 2000).cast("int").alias("year"))
    assert present_years(df) == list(range(2000, 2012))


def test_sums_keep_all_places(spark):
    from panelkit.operators.aggregate import exact, group_agg
    df = spark.createDataFrame([("a", v) for v in (0.004, 0.004, 12.3456)] + [("b", 1e17), ("b", None)], "g string, v double")
    got = {r.g: r.v for r in group_agg(df, ["g"], {"v": "sum"}).collect()}
    assert got["a"] == pytest.approx(12.3536) and got["b"] == 1e17
    mean = {r.g: r.v for r in group_agg(df, ["g"], {"v": "mean"}).collect()}
    assert mean["a"] == pytest.approx(4.117866666) and mean["b"] == 1e17
    fits = df.where("g = 'a'")
    assert group_agg(fits, ["g"], {"v": exact("sum", 4)}).first().v == 12.3536
    with pytest.raises(Exception, match="does not fit 2 decimal places"):
        group_agg(fits, ["g"], {"v": exact("sum", 2)}).collect()


def test_rounding_is_that_of_numpy(spark):
    import numpy as np
    values = [8.345, 10.075, 2.345, 2.675, 1.005, -0.004, 0.125, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(round_even("v")).collect()] == [float(np.round(v, 2)) + 0.0 for v in values]


def test_change_runs_between_years_present(spark):
    panel = spark.createDataFrame([(1, 2020, "N", 10.0), (1, 2021, "N", 15.0), (2, 2021, "S", 4.0)],
                                  "entity_id int, year int, region string, s double")
    cfg = {"group_col": "region", "metric": "s", "years": [2019, 2020, 2021, 2030]}
    got = {r.region: r for r in R.report_single_metric(panel, cfg, {"s": "sum"}).collect()}
    assert got["N"].total_diff == 5.0 and got["N"].total_pct == 50.0 and got["N"].y2030 == 0.0
    assert got["S"].total_diff == 4.0 and got["S"].total_pct == 0.0
    one = R.report_totals(panel, {"years": [2021, 2030]}, {"s": "sum"}).first()
    assert one.growth is None and one.growth_pct is None


def test_years_of_cells(spark):
    from panelkit.functions.dates import integral_year
    cells = ["2021", "2021.0", "2021.5", " 2020-05-06 ", "2020-05-06 00:00:00", "2020-13-01", "x", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(integral_year("c")).collect()] == [
        2021, 2021, None, 2020, 2020, None, None, None]


def test_compare_years_difference_row_and_missing_year(spark):
    summary = spark.createDataFrame([(2020, 3, 10.0), (2021, 5, None), (2022, 4, 7.5)],
                                    "year int, n int, s double")
    got = rows(R.compare_years(summary, 2020, 2022, ["n", "s"]), "label", "n", "s")
    assert got == [("2020", 3, 10.0), ("2022", 4, 7.5), ("difference", 1, -2.5)]
    nulls = rows(R.compare_years(summary, 2021, 2022, ["n", "s"]), "label", "n", "s")
    assert ("difference", -1, None) in nulls and len(nulls) == 3
    assert R.compare_years(summary, 2020, 2030, ["n", "s"]).count() == 0
    assert R.compare_years(summary, 2020, 2020, ["n", "s"]).count() == 0
