"""The union form of the exact join against plain joins."""
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from panelkit.operators.panel import bucketed, exact_join


def test_equals_the_chain_of_joins(spark):
    rnd = random.Random(1)
    tables = {}
    for i in range(4):
        keys = {(rnd.randrange(6), rnd.randrange(4)) for _ in range(18)}
        rows = [(a, b, rnd.choice([None, i * 10 + a])) for a, b in keys] + [(None, 1, 5)]
        tables[f"t{i}"] = spark.createDataFrame(rows, f"k int, ts int, v{i} int")
    tables["many"] = spark.createDataFrame([(a, b) for a in range(5) for b in range(3) for _ in range(3)], "k int, ts int")
    got = {tuple(r) for r in exact_join(tables, ["k", "ts"], ["many"]).collect()}
    plain = reduce(lambda x, y: x.join(y, ["k", "ts"]), tables.values()).distinct()
    assert got == {tuple(r) for r in plain.collect()} and got


def test_repeated_keys_and_clashing_columns_are_refused(spark):
    a = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "k int, ts int, x int")
    b = spark.createDataFrame([(1, 1, 2)], "k int, ts int, y int")
    with pytest.raises(Exception, match="two rows"):
        exact_join({"a": a, "b": b}, ["k", "ts"]).collect()
    with pytest.raises(ValueError, match="two tables"):
        exact_join({"a": a, "b": b.withColumnRenamed("y", "x")}, ["k", "ts"])


def test_bucketed_rows_are_the_rows(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 7 AS k", "id")
    got = bucketed(df, ["k"], 3, str(tmp_path / "b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("panelkit_")]


def test_submissions_are_summed_once_and_few_units_as_longs(spark):
    """The seven tables come from one frame, and both ways of summing agree."""
    from types import SimpleNamespace

    import panelkit.plans.bindings as B
    rnd = random.Random(4)

    def tables(factor):
        orders = [(k, k % 5, k % 3, "1-URGENT" if k % 2 else "5-LOW", round(rnd.uniform(1, 9e5), 2) * factor) for k in range(40)]
        lines = [(k % 40, k, float(rnd.randrange(1, 50)), rnd.choice([None, round(rnd.uniform(1, 9e4), 2)]),
                  rnd.randrange(10) / 100, rnd.randrange(8) / 100, rnd.choice("RAN"), rnd.choice("OF")) for k in range(300)]
        o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d int, o_orderpriority string, o_totalprice double")
        return SimpleNamespace(
            orders=o.withColumn("o_orderdate", F.expr("timestamp_ntz'1997-01-01 00:00:00' + d * interval 1 day")).drop("d"),
            lineitem=spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                           "l_discount double, l_tax double, l_returnflag string, l_linestatus string"))
    t = tables(1)
    few = B.submission_rows(t)
    assert "decimal(28" not in few["wide"]._jdf.queryExecution().optimizedPlan().toString()
    old, B.few_units = B.few_units, lambda *a: False
    try:
        exact = B.submission_rows(t)
    finally:
        B.few_units = old
    assert few["wide"].schema == exact["wide"].schema
    key = lambda r: (r.entity_id, r.ts)
    assert sorted(few["wide"].collect(), key=key) == sorted(exact["wide"].collect(), key=key)
    assert not B.few_units(tables(100.0).orders, ["o_totalprice"], 2)
    out = B.submission_tables(few)
    assert len(out) == 7 and exact_join(out, ["entity_id", "ts"], [B.ROWS_TABLE]).count() == 15


def test_units_refuse_more_places(spark):
    from panelkit.functions.scalar import few_units, of_units, units
    df = spark.createDataFrame([(0.07,), (-0.0,), (None,), (21474836.45,)], "x double")
    assert few_units(df, ["x"], 2)
    got = df.select("x", of_units(units("x", 2), 2).alias("y")).collect()
    assert all(r.x == r.y for r in got)
    with pytest.raises(Exception, match="decimal places"):
        spark.createDataFrame([(0.071,)], "x double").select(units("x", 2)).collect()
    assert not few_units(spark.createDataFrame([(float("nan"),)], "x double"), ["x"], 2)
