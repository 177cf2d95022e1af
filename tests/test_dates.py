"""The date grammar: formats in order, days that don't exist, years of cells."""
import datetime as dt

from panelkit.functions.dates import integral_year, is_date, parse_date
from panelkit.operators import quality as Q

CELLS = {
    "2024-05-06": (dt.datetime(2024, 5, 6), "iso"), "2024-5-6": (dt.datetime(2024, 5, 6), "iso"),
    "2024-05-06T07:08:09Z": (dt.datetime(2024, 5, 6, 7, 8, 9), "iso_time"),
    "2024-05-06 07:08": (dt.datetime(2024, 5, 6, 7, 8), "iso_time"),
    "2024-05-06T07:08:09.25+02:00": (dt.datetime(2024, 5, 6, 7, 8, 9, 250000), "iso_time"),
    "2024.05.06.": (dt.datetime(2024, 5, 6), "dots"), " 2024. 05. 06. ": (dt.datetime(2024, 5, 6), "dots"),
    "2024. 05. 06. 7:08": (dt.datetime(2024, 5, 6, 7, 8), "dots_time"),
    "2024/02/29": (dt.datetime(2024, 2, 29), "slashes"), "02/29/2024": (dt.datetime(2024, 2, 29), "month_first"),
    "2023-02-29": None, "29/02/2024": None, "2024-05-06T25:00": None, "2024-05-06x": None, "45000": None, "": None,
    "tomorrow": None, None: None,
}


def test_formats(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string")
    got = {r.i: r for r in df.select("i", parse_date("c").alias("p"), is_date("c").alias("d")).collect()}
    for i, (c, want) in enumerate(CELLS.items()):
        p = got[i].p
        assert ((p.value, p.format) if p.value else None) == want, c
        assert p.year == (want[0].year if want else None) and bool(got[i].d) == bool(want), c


def test_serial_numbers_only_where_asked(spark):
    df = spark.createDataFrame([("1",), ("45000",), ("45000.75",), ("0",), ("2958466",), ("2024-05-06",)], "c string")
    got = [r.p.value for r in df.select(parse_date("c", serial=True).alias("p")).collect()]
    assert got == [dt.datetime(1899, 12, 31), dt.datetime(2023, 3, 15), dt.datetime(2023, 3, 15), None, None,
                   dt.datetime(2024, 5, 6)]


def test_years_and_rules(spark):
    df = spark.createDataFrame([("2021",), ("2021.5",), ("2021. 03. 04.",), ("03/04/1975",), ("x",), (None,), ("3e9",)], "c string")
    assert [r[0] for r in df.select(integral_year("c")).collect()] == [2021, None, 2021, 1975, None, None, None]
    rows = df.selectExpr("monotonically_increasing_id() AS i", "c")
    rules = [Q.year_range(["c"], 1980, 2024), Q.not_date(["c"])]
    got = {(r.value, r.rule) for r in Q.violations(rows, rules, ["i"], "s").collect()}
    assert got == {("2021.5", "year_range"), ("03/04/1975", "year_range"), ("x", "year_range"), ("3e9", "year_range"),
                   ("2021", "not_date"), ("2021.5", "not_date"), ("x", "not_date"), ("3e9", "not_date")}
