"""Plan-shape guards: the scale properties the design relies on, read from
the physical plans Spark chooses (AQE off, so the whole plan is fixed before
execution)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001

from panelkit.operators.latest import latest_by
from panelkit.plans import bindings as B
from panelkit.plans import reports as R
from panelkit.plans.catalog import QUERIES
from panelkit.sources.tables import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_aqe(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_no_registered_query_plans_all_pairs_or_row_udfs(spark):
    bad = {}
    for name, q in QUERIES.items():
        p = plan(q(spark, SF001))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
                if op in p]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_latest_cuts_each_key_map_side_before_the_shuffle(no_aqe):
    df = no_aqe.range(0, 1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    lines = plan(latest_by(df, ["k"], [F.col("seq").desc()])).splitlines()
    exch = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(k" in x)
    partial = [i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x]
    assert partial and min(partial) > exch   # below the exchange = before it runs


def test_panel_scans_read_only_needed_columns(no_aqe):
    p = plan(B.fact_lines(Tables(no_aqe, SF001)))
    schemas = [x for x in p.split("ReadSchema: ")[1:] if "l_orderkey" in x]
    assert schemas and all("l_comment" not in s.split("\n")[0] for s in schemas)


def test_compare_years_plans_no_window(no_aqe):
    summary = no_aqe.createDataFrame([(2020, 1.0), (2021, 2.0)], "year int, v double")
    assert "Window" not in plan(R.compare_years(summary, 2020, 2021, ["v"]))


def test_exact_ts_join_sums_lines_before_joining_orders(no_aqe):
    p = plan(B.exact_ts_join(Tables(no_aqe, SF001)))
    assert "keys=[l_orderkey" in p and "functions=[partial_sum" in p
    assert "CartesianProduct" not in p


def scans(df, table: str) -> int:
    return plan(df).count(f"{table}.parquet")


def test_reports_scan_no_more_than_they_need(no_aqe):
    assert scans(QUERIES["missing_panel"](no_aqe, SF001), "lineitem") == 0
    assert scans(QUERIES["yearly_summary"](no_aqe, SF001), "lineitem") == 1
    assert scans(QUERIES["panel_wide"](no_aqe, SF001), "lineitem") == 1


def test_orphan_audit_joins_distinct_keys(no_aqe):
    from panelkit.operators import quality as Q
    child = no_aqe.range(100).select((F.col("id") % 5).alias("k"))
    old = no_aqe.conf.get("spark.sql.autoBroadcastJoinThreshold")
    no_aqe.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables that are no longer tiny
    try:
        p = plan(Q.audit_fk(child, "k", no_aqe.range(3), "id", "fk"))
    finally:
        no_aqe.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert p.index("LeftAnti") < p.index("HashAggregate")  # the aggregate runs below the join


@pytest.fixture()
def no_broadcast(no_aqe):
    old = no_aqe.conf.get("spark.sql.autoBroadcastJoinThreshold")
    no_aqe.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield no_aqe
    no_aqe.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_panel_of_bucketed_facts_joins_without_an_exchange(no_broadcast, tmp_path):
    p = plan(B.panel_five(Tables(no_broadcast, SF001), str(tmp_path), buckets=4))
    assert p.count("SortMergeJoin") == 5 and "Exchange" not in p


def test_exact_join_of_seven_tables_is_one_exchange(no_broadcast):
    from panelkit.operators.panel import exact_join
    tables = {f"t{i}": no_broadcast.range(50).select((F.col("id") % 9).alias("k"), F.col("id").alias("ts"),
                                                     F.col("id").alias(f"v{i}")) for i in range(7)}
    p = plan(exact_join(tables, ["k", "ts"], ["t6"]))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_growth_reads_each_table_once_per_fact_and_counts_in_the_same_aggregate(no_aqe):
    t = Tables(no_aqe, SF001)
    df = R.apply_filters(B.panel(t), [1996, 1997]).where("year is not null and region is not null")
    p = plan(R.growth_cells(df, "region", B.AGG_SMALL))
    assert p.count("customer.parquet") == 1
    assert "partial_sum(_first" in p and "count(distinct" not in p


def test_reports_have_no_window_over_all_cells(spark):
    panel = spark.createDataFrame([(i, 2020 + i % 3, i % 500, float(i)) for i in range(1500)],
                                  "entity_id int, year int, g int, s double")
    for df in (R.report_single_metric(panel, {"group_col": "g", "metric": "s"}, {"s": "sum"}),
               R.report_regional_growth(panel, {"group_col": "g"}, {"s": "sum"}),
               R.report_totals(panel, {}, {"s": "sum"})):
        p = plan(df)
        assert "SinglePartition" not in p
        for line in p.splitlines():
            if "Window [" in line:
                assert "[g#" in line.split("],")[1]
