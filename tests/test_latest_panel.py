import datetime as dt

from pyspark.sql import functions as F

from panelkit.operators.aggregate import first_non_null
from panelkit.operators.latest import latest_by, latest_max_by
from panelkit.operators.panel import assemble_panel, entity_base


D1, D2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_latest_ties_on_timestamp_use_sequence(spark):
    df = spark.createDataFrame(
        [(1, 2023, D1, 1, 10.0), (1, 2023, D2, 2, 20.0), (1, 2023, D2, 3, 30.0),
         (2, 2023, D1, 4, 40.0), (None, 2023, D1, 5, 50.0), (None, 2023, D2, 6, 60.0)],
        "id int, year int, datum timestamp, seq int, v double")
    out = latest_by(df, ["id", "year"], [F.col("datum").desc(), F.col("seq").desc()])
    # equal datum -> larger sequence wins; NULL keys form their own partition
    got = {r.id: r.v for r in out.collect()}
    assert got == {1: 30.0, 2: 40.0, None: 60.0}


def test_latest_row_number_equals_max_by(spark):
    import random
    rnd = random.Random(7)
    data = [(rnd.randint(0, 20), rnd.randint(2019, 2023), D1 + dt.timedelta(days=rnd.randint(0, 5)), i,
             float(rnd.randint(0, 100))) for i in range(400)]
    df = spark.createDataFrame(data, "id int, year int, datum timestamp, seq int, v double")
    a = latest_by(df, ["id", "year"], [F.col("datum").desc(), F.col("seq").desc()])
    b = latest_max_by(df, ["id", "year"], ["datum", "seq"])
    assert a.exceptAll(b.select(*a.columns)).count() == 0
    assert b.select(*a.columns).exceptAll(a).count() == 0


def test_first_non_null_per_column(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (1, "b", 2.0, None), (1, "c", 3.0, "z")],
                               "id int, o string, v double, s string")
    out = first_non_null(df, ["id"], ["o"], ["v", "s"]).collect()[0]
    assert (out.v, out.s) == (2.0, "x")


def test_panel_left_joins_keep_entities_without_data(spark):
    reg = spark.createDataFrame([(1, "A"), (2, "B")], "entity_id int, entity_name string")
    master = spark.createDataFrame([(1, 2022), (1, 2023)], "entity_id int, year int")
    base = entity_base(reg, master)
    fact = spark.createDataFrame([(1, 2023, "5.5"), (1, 2021, "1")], "entity_id int, year int, m string")
    p = assemble_panel(base, [fact], numeric=["m"])
    got = sorted((r.entity_id, r.year, r.m) for r in p.collect())
    assert got == sorted([(1, 2022, None), (1, 2023, 5.5), (2, None, None)], key=str)
