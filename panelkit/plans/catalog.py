"""Registered queries: every inventory operator bound to the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables. The matching DuckDB SQL lives in ``oracle.py`` under the same
name; computed columns carry the same aliases on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_by_kind, round_even, safe_pct, safe_ratio, sum_or_zero
from ..operators.aggregate import distinct_list, exact, first_non_null, group_agg, joined_distinct, to_long
from ..operators.latest import latest_by
from ..operators.latest import latest_max_by as max_row_by
from ..operators.panel import duplicate_keys, exact_join
from ..sources.tables import Tables
from . import bindings as B
from . import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def T(spark: SparkSession, d: str) -> Tables:
    return Tables(spark, d)


# Report configurations used by the registered queries.
GROWTH_CFG = {"type": "growth", "group_col": "region",
              "metrics": ["total_price", "quantity", "discount"], "years": [1996, 1997, 1998]}
TOTALS_CFG = {"type": "totals", "years": [1996, 1997, 1998], "filter_col": "region",
              "filter_values": ["EUROPE", "ASIA"]}
SINGLE_CFG = {"type": "single_metric", "group_col": "county", "metric": "total_price",
              "years": [1995, 1996, 1997, 1998]}
MULTI_CFG = {"type": "multi_metric", "group_col": "region", "years": [1997, 1998]}
ENTITY_CFG = {"type": "entity", "group_col": "region", "entity": "AMERICA",
              "years": [1996, 1997, 1998, 1999]}
REINDEX_CFG = {"type": "entity", "group_col": "county", "entity": "NATION_3",
               "years": [1994, 1996, 1998], "reindex": True}
ALL_ENT_CFG = {"type": "all_entities", "group_col": "county", "years": [1997, 1998, 1999]}
TOTALS_PLAIN_CFG = {"type": "totals_plain", "years": [1997, 1998, 1999]}
EMAIL_CFG = {"type": "emails", "filter_col": "region", "filter_values": ["AFRICA"]}
MISSING_CFG = {"type": "missing", "year": 1998, "filter_col": "region",
               "filter_values": ["AFRICA", "EUROPE"]}


# ======================================================= step 1: latest views
@query
def latest_orders(spark, d):
    return B.orders_latest(T(spark, d)).select(
        "entity_id", "year", "o_orderkey", "o_orderdate", "o_totalprice")


@query
def latest_by_status(spark, d):
    return B.status_latest(T(spark, d)).select(
        "entity_id", "year", "o_orderstatus", "o_orderkey", "o_totalprice")


@query
def latest_events_daily(spark, d):
    e = T(spark, d).events.withColumn("day", F.date_trunc("day", "ts"))
    return latest_by(e, ["user_id", "day"], [F.col("ts").desc(), F.col("event_id").desc()]) \
        .select("user_id", "day", "event_id", "event_type", "value")


@query
def latest_events_kind(spark, d):
    return B.management_latest(T(spark, d)).select(
        "entity_id", "event_type", "event_id", "ts", "management_email")


@query
def latest_max_by(spark, d):
    o = B.orders_versions(T(spark, d)).select("entity_id", "year", "o_orderdate", "o_orderkey",
                                              "o_totalprice")
    return max_row_by(o, ["entity_id", "year"], ["o_orderdate", "o_orderkey"])


@query
def entity_base(spark, d):
    return B.base(T(spark, d))


# ================================================ step 2: grouped aggregation
@query
def group_year_agg(spark, d):
    p = R.apply_filters(B.panel(T(spark, d)), [1996, 1997, 1998])
    return group_agg(p, ["region", "year"], B.AGG_SMALL, "entity_id")


@query
def sum_null_zero(spark, d):
    li = T(spark, d).lineitem.withColumn("zero_discount", (F.col("l_discount") == 0).cast("int"))
    return (li.groupBy("l_returnflag", "l_linestatus", "zero_discount")
              .agg(sum_or_zero(F.expr("nullif(l_discount, 0)"), B.PLACES).alias("sum_discount"),
                   F.count(F.lit(1)).alias("n_rows")))


@query
def distinct_entities_year(spark, d):
    p = B.panel(T(spark, d)).filter(F.col("year").isNotNull())
    return p.groupBy("year").agg(F.count_distinct("entity_id").alias("n_entities"))


@query
def distinct_entities_window(spark, d):
    p = R.apply_filters(B.panel(T(spark, d)), [1996, 1997, 1998])
    return p.groupBy("region").agg(F.count_distinct("entity_id").alias("n_entities"))


@query
def entity_list(spark, d):
    return distinct_list(B.panel(T(spark, d)), "county")


@query
def safe_pct_query(spark, d):
    li = T(spark, d).lineitem
    def dec(c):
        return F.col(c).cast("decimal(18,2)")
    g = li.groupBy("l_discount").agg(
        F.sum(dec("l_extendedprice") * dec("l_tax")).cast("double").alias("tax_amount"),
        F.sum(dec("l_extendedprice") * dec("l_discount")).cast("double").alias("discount_amount"))
    return g.select("l_discount", round_even(safe_pct("tax_amount", "discount_amount"), 2).alias("pct"))


@query
def round_by_kind_query(spark, d):
    p = R.apply_filters(B.panel(T(spark, d)), [1997, 1998])
    long = to_long(group_agg(p, ["region", "year"], B.AGG_FULL), ["region", "year"], B.AGG_FULL)
    return long.select("region", "year", "metric", round_by_kind("value", "kind").alias("value"))


@query
def per_entity_avg(spark, d):
    p = R.apply_filters(B.panel(T(spark, d)), [1996, 1997, 1998])
    long = to_long(group_agg(p, ["region", "year"], B.AGG_SMALL, "entity_id"),
                   ["region", "year", "n_entities"], B.AGG_SMALL)
    v = F.when(F.col("kind") == "sum", safe_ratio("value", "n_entities")).otherwise(F.col("value"))
    return long.select("region", "year", "metric", round_even(v, 2).alias("per_entity"))


# ======================================================= step 3: the panel
@query
def panel_first_nonnull(spark, d):
    return B.fact_status(T(spark, d))


@query
def panel_wide(spark, d):
    return B.panel(T(spark, d))


@query
def panel_five(spark, d):
    """Base LEFT JOIN five facts, all in buckets of (entity, year)."""
    import uuid

    from ..session import shared_path
    return B.panel_five(T(spark, d), shared_path(spark, "buckets", uuid.uuid4().hex))


@query
def panel_cardinality(spark, d):
    t = T(spark, d)
    keys = ["entity_id", "year"]
    sides = [("base", B.base(t).filter(F.col("year").isNotNull())), ("orders", B.fact_orders(t)),
             ("lines", B.fact_lines(t)), ("status", B.fact_status(t)),
             ("status_versions", B.status_latest(t))]
    out = None
    for name, df in sides:
        dup = duplicate_keys(df, keys, name).groupBy("side").agg(F.count(F.lit(1)).alias("dup_keys"))
        out = dup if out is None else out.unionByName(dup)
    return out


# ==================================================== step 4: pivots/transposes
@query
def pivot_metric_year(spark, d):
    return R.report_multi_metric(B.panel(T(spark, d)), MULTI_CFG, B.AGG_SMALL)


@query
def transpose_totals(spark, d):
    return R.report_totals_plain(B.panel(T(spark, d)), TOTALS_PLAIN_CFG, B.AGG_SMALL)


@query
def reindex_years(spark, d):
    return R.report_entity(B.panel(T(spark, d)), REINDEX_CFG, B.AGG_SMALL)


# ===================================================== step 5: change
@query
def yoy_diff(spark, d):
    return R.report_single_metric(B.panel(T(spark, d)), SINGLE_CFG, B.AGG_FULL)


@query
def first_last_change(spark, d):
    return R.report_entity(B.panel(T(spark, d)), ENTITY_CFG, B.AGG_FULL)


@query
def yoy_per_entity(spark, d):
    return R.report_totals_change(B.panel(T(spark, d)), TOTALS_PLAIN_CFG, B.AGG_FULL)


# ===================================================== step 6: reports
@query
def report_regional_growth(spark, d):
    return R.report_regional_growth(B.panel(T(spark, d)), GROWTH_CFG, B.AGG_SMALL)


@query
def report_totals(spark, d):
    return R.report_totals(B.panel(T(spark, d)), TOTALS_CFG, B.AGG_FULL)


ABSENT = 2031  # no order has this year


@query
def report_growth_absent_year(spark, d):
    """Change runs between the first and last year present, not requested."""
    return R.report_regional_growth(B.panel(T(spark, d)), dict(GROWTH_CFG, years=[1996, 1998, ABSENT]), B.AGG_SMALL)


@query
def report_totals_absent_year(spark, d):
    return R.report_totals(B.panel(T(spark, d)), dict(TOTALS_CFG, years=[1996, 1997, ABSENT]), B.AGG_FULL)


@query
def report_single_absent_year(spark, d):
    return R.report_single_metric(B.panel(T(spark, d)), dict(SINGLE_CFG, years=[1995, 1997, ABSENT]), B.AGG_FULL)


@query
def event_value_totals(spark, d):
    """A1-A3 on values with more than two places, summed as they are."""
    spec = {"value": exact("sum", 6)}
    e = T(spark, d).events.withColumn("value", F.col("value") / 8)
    total = group_agg(e, ["event_type"], spec).withColumnRenamed("value", "total")
    avg = group_agg(e, ["event_type"], {"value": exact("mean", 6)}).withColumnRenamed("value", "average")
    return total.join(avg, "event_type")


@query
def report_all_entities(spark, d):
    return R.report_all_entities(B.panel(T(spark, d)), ALL_ENT_CFG, B.AGG_SMALL)


@query
def report_entity_sections(spark, d):
    """R8 with a section (a folder) for every entity of the group column, written
    in one job; the sections are read back."""
    import uuid

    from ..session import shared_path
    from ..sources.sinks import read_each, write_each
    path = shared_path(spark, "sections", uuid.uuid4().hex)
    write_each(R.report_all_entities(B.panel(T(spark, d)), ALL_ENT_CFG, B.AGG_SMALL), "county", path)
    return read_each(spark, path)


@query
def report_multi_metric(spark, d):
    return R.report_multi_metric(B.panel(T(spark, d)), MULTI_CFG, B.AGG_FULL)


@query
def report_single_metric(spark, d):
    cfg = {"type": "single_metric", "group_col": "region", "metric": "quantity",
           "years": [1998, 1999, 2000], "filter_values": ["ASIA", "AMERICA", "EUROPE"]}
    return R.report_single_metric(B.panel(T(spark, d)), cfg, B.AGG_FULL)


@query
def report_entity(spark, d):
    cfg = {"type": "entity", "group_col": "county", "entity": "NATION_5", "years": [1995, 1997, 2000]}
    return R.report_entity(B.panel(T(spark, d)), cfg, B.AGG_SMALL)


@query
def report_totals_plain(spark, d):
    return R.report_totals_plain(B.panel(T(spark, d)), {"years": [1995, 1996]}, B.AGG_FULL)


@query
def report_totals_change(spark, d):
    return R.report_totals_change(B.panel(T(spark, d)), {"years": [1998, 1999, 2000, 2001]}, B.AGG_SMALL)


@query
def yoy_pct(spark, d):
    """W2/W3 in long form: pivot gives the dense (region x year) grid filled
    with 0, unpivot brings it back long, ``lag`` per region does the rest."""
    from ..operators.change import yoy_long
    from ..operators.pivot import pivot_labels
    years = [1995, 1996, 1997, 1998, 1999]
    p = R.apply_filters(B.panel(T(spark, d)), years)
    cells = group_agg(p, ["region", "year"], {"total_price": B.AGG_SMALL["total_price"]}).select(
        "region", F.concat(F.lit("y"), F.col("year").cast("string")).alias("label"),
        F.col("total_price").alias("value"))
    wide = pivot_labels(cells, ["region"], "label", [f"y{y}" for y in years], fill=0.0)
    long = wide.unpivot(["region"], [f"y{y}" for y in years], "label", "value") \
        .withColumn("year", F.substring("label", 2, 4).cast("int")).drop("label")
    out = yoy_long(long, ["region"])
    return out.select("region", "year", round_even("value", 2).alias("value"),
                      round_even("diff", 2).alias("diff"), round_even("pct", 2).alias("pct"))


def _yearly_rows(t):
    j = B.exact_ts_join(t)
    return latest_by(j, ["year", "entity_id"], [F.col("ts").desc()])


@query
def exact_ts_join(spark, d):
    return B.exact_ts_join(T(spark, d))


def _summary(t):
    s = R.yearly_summary(_yearly_rows(t), ["total_price", "quantity", "extended_price"], ["discount"], B.PLACES)
    return s.withColumn("avg_discount", round_even("avg_discount", 6))


@query
def yearly_summary(spark, d):
    return _summary(T(spark, d))


@query
def compare_years(spark, d):
    return R.compare_years(_summary(T(spark, d)), 1997, 1998,
                           ["n_entities", "sum_total_price", "sum_quantity", "sum_extended_price",
                            "avg_discount"])


def _stored(spark, tables):
    """The tables, written once and read back."""
    import uuid

    from ..session import shared_path
    root = shared_path(spark, "tables", uuid.uuid4().hex)
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in tables.items()}


def _seven(spark, d):
    """The measures are summed once, and the tables that share them written from there."""
    rows = B.submission_rows(T(spark, d))
    rows |= _stored(spark, {"wide": rows["wide"]})
    return exact_join(_stored(spark, B.submission_tables(rows)), ["entity_id", "ts"], [B.ROWS_TABLE])


@query
def exact_ts_join_seven(spark, d):
    """J11 over seven tables, by one union and one exchange."""
    out = _seven(spark, d)
    return out.select("entity_id", "ts", *B.SUMMED, *[round_even(c, 6).alias(c) for c in B.RATED])


@query
def yearly_summary_seven(spark, d):
    """J11 + A15 + A14: the newest complete submission per entity and year, then
    23 sums and 5 means by year."""
    rows = _seven(spark, d).withColumn("year", F.year("ts").cast("int"))
    rows = latest_by(rows, ["year", "entity_id"], [F.col("ts").desc()])
    s = R.yearly_summary(rows, B.SUMMED, B.RATED, B.PLACES)
    return s.withColumns({f"avg_{c}": round_even(f"avg_{c}", 6) for c in B.RATED})


@query
def year_pair_diff(spark, d):
    from ..operators.change import pair_diff
    g = group_agg(B.panel(T(spark, d)), ["year"], B.AGG_SMALL, "entity_id")
    return pair_diff(g, "year", 1999, 2000, ["total_price", "quantity", "discount", "n_entities"])


# ===================================================== step 7: contacts
def _contacts(spark, d):
    t = T(spark, d)
    return R.report_emails(B.panel(t), EMAIL_CFG, B.management_latest(t), B.management_emails(t))


@query
def contact_list(spark, d):
    return _contacts(spark, d)["email_list"]


@query
def contact_details(spark, d):
    return _contacts(spark, d)["details"]


@query
def contacts_all(spark, d):
    """Every registered entity (not only active) with its contacts."""
    t = T(spark, d)
    return R.contact_lists(B.base(t), B.management_latest(t), B.management_emails(t))["details"]


@query
def missing_panel(spark, d):
    t = T(spark, d)
    return R.report_missing(B.base(t), MISSING_CFG, B.management_emails(t))


def _missing_sub(t):
    return R.missing_submissions(B.registry(t), B.orders_versions(t), 1998, B.management_emails(t))


@query
def missing_submission(spark, d):
    return _missing_sub(T(spark, d))


@query
def missing_semi(spark, d):
    """Contact rows of the entities that did not submit (semi-join)."""
    t = T(spark, d)
    miss = _missing_sub(t).select("entity_id")
    return (B.management_latest(t).join(miss, "entity_id", "left_semi")
            .select("entity_id", "event_type", "management_email").dropna(subset=["management_email"]))


@query
def joined_strings(spark, d):
    return B.management_emails(T(spark, d))


# ===================================================== step 8: quality rules
from ..operators import quality as Q  # noqa: E402
from . import sheets as S  # noqa: E402

IDS = ["submission_id", "row_id"]
SEGMENTS4 = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]


def _v(df, rules, sheet):
    return Q.violations(df, rules, IDS, sheet)


CUSTOMER_RULES = [Q.pattern(["email"], Q.EMAIL_PATTERN, "email"),
                  Q.pattern(["phone"], Q.PHONE_PATTERN, "phone"),
                  Q.nonneg_real(["balance"]), Q.nonneg_int(["balance"]),
                  Q.one_of(["segment"], SEGMENTS4, name="one_of"),
                  Q.one_of(["segment_ci"], SEGMENTS4, normalize=True, name="one_of_ci"),
                  Q.max_length(["name"], 255)]
ORDER_RULES = [Q.not_date(["order_date"]),
               Q.year_range(["report_year"], S.FIRST_YEAR, S.AS_OF_YEAR),
               Q.year_not_before(["planned_year"], S.AS_OF_YEAR),
               Q.yes_no(["flag"])]
LINE_RULES = [Q.percent(["discount_pct", "tax_pct"]),
              Q.sum_equals(["discount", "tax"], 0.1),
              Q.sum_at_most(["discount_pct", "tax_pct"], 100.0),
              Q.at_most("discount", "tax")]


@query
def rule_text_length(spark, d):
    return _v(S.documents(T(spark, d)), [Q.max_length(["text"], 255), Q.max_length(["text"], 500)],
              "documents")


@query
def rule_date(spark, d):
    return _v(S.orders(T(spark, d)), [Q.not_date(["order_date"])], "orders")


@query
def rule_year_range(spark, d):
    return _v(S.orders(T(spark, d)), [Q.year_range(["report_year"], S.FIRST_YEAR, S.AS_OF_YEAR)], "orders")


@query
def rule_year_min(spark, d):
    return _v(S.orders(T(spark, d)), [Q.year_not_before(["planned_year"], S.AS_OF_YEAR)], "orders")


@query
def rule_email(spark, d):
    return _v(S.customers(T(spark, d)), [Q.pattern(["email"], Q.EMAIL_PATTERN, "email")], "customers")


@query
def rule_percent(spark, d):
    return _v(S.lines(T(spark, d)), [Q.percent(["discount_pct", "tax_pct"])], "lines")


@query
def rule_nonneg_real(spark, d):
    return _v(S.customers(T(spark, d)), [Q.nonneg_real(["balance"])], "customers")


@query
def rule_nonneg_int(spark, d):
    t = T(spark, d)
    return _v(S.parts(t), [Q.nonneg_int(["size"])], "parts").unionByName(
        _v(S.customers(t), [Q.nonneg_int(["balance"])], "customers"))


@query
def rule_yes_no(spark, d):
    return _v(S.orders(T(spark, d)), [Q.yes_no(["flag"])], "orders")


@query
def rule_enum(spark, d):
    return _v(S.customers(T(spark, d)), [Q.one_of(["segment"], SEGMENTS4)], "customers")


@query
def rule_enum_ci(spark, d):
    return _v(S.customers(T(spark, d)),
              [Q.one_of(["segment_ci"], SEGMENTS4, normalize=True, name="one_of_ci")], "customers")


@query
def rule_phone(spark, d):
    return _v(S.customers(T(spark, d)), [Q.pattern(["phone"], Q.PHONE_PATTERN, "phone")], "customers")


@query
def rule_sum_equals(spark, d):
    return _v(S.lines(T(spark, d)), [Q.sum_equals(["discount", "tax"], 0.1)], "lines")


@query
def rule_sum_at_most(spark, d):
    return _v(S.lines(T(spark, d)), [Q.sum_at_most(["discount_pct", "tax_pct"], 100.0)], "lines")


@query
def rule_le(spark, d):
    return _v(S.lines(T(spark, d)), [Q.at_most("discount", "tax")], "lines")


@query
def parse_dates(spark, d):
    """text of a date in many formats: the moment, its year, the format."""
    from ..functions.dates import integral_year, parse_date
    rows = S.order_dates(T(spark, d)).withColumn("p", parse_date("started"))
    return rows.select("submission_id", "started", F.col("p.value").alias("value"), F.col("p.format").alias("format"),
                       integral_year("started").alias("year"))


@query
def rule_dates(spark, d):
    """C3, C4 on cells of many formats."""
    return _v(S.order_dates(T(spark, d)), [Q.not_date(["started"]), Q.year_range(["started"], 1996, 2000)], "orders")


@query
def rule_fixed_lists(spark, d):
    """C11-C14: the county, region, provider and condition lists."""
    return _v(S.places(T(spark, d)), [Q.county(["county"]), Q.region(["region"]),
                                      Q.provider_kind(["provider_kind"]), Q.condition(["condition"])], "places")


@query
def rule_sum_columns(spark, d):
    """Sums held against another column."""
    return _v(S.areas(T(spark, d)), [Q.sum_at_most(["built", "free"], "usable", name="built_free"),
                                     Q.sum_equals(["own", "state"], "total", name="sources")], "areas")


@query
def violations_all(spark, d):
    t = T(spark, d)
    return (_v(S.customers(t), CUSTOMER_RULES, "customers")
            .unionByName(_v(S.orders(t), ORDER_RULES, "orders"))
            .unionByName(_v(S.lines(t), LINE_RULES, "lines")))


@query
def gate_clean_rows(spark, d):
    """C22 per submission: an order whose lines break any rule is held back
    whole; lines of the other orders go on."""
    t = T(spark, d)
    bad = _v(S.lines(t), [Q.percent(["tax_pct"]), Q.sum_at_most(["discount_pct", "tax_pct"], 100.0)], "lines")
    li = t.lineitem.select(F.col("l_orderkey").alias("submission_id"), "l_linenumber", "l_partkey",
                           "l_quantity", "l_extendedprice")
    return Q.gate(li, bad, ["submission_id"])


@query
def audit_pk(spark, d):
    return Q.audit_pk(T(spark, d).lineitem, ["l_orderkey", "l_linenumber"])


@query
def audit_dictionary(spark, d):
    """Natural keys that a dictionary of (type, brand, size) holds twice: the
    known one, and the one that a second batch numbered without looking."""
    t = T(spark, d)
    known = B.known_dictionary(t)
    careless = RS.dense_ids(t.part.where("p_size > 25").select(*B.DICT_KEYS).distinct(), B.DICT_KEYS, 0, "dict_id")
    return Q.audit_pk(known.unionByName(careless), B.DICT_KEYS)


@query
def audit_fk(spark, d):
    t = T(spark, d)
    pairs = [(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem.l_orderkey"),
             (t.lineitem, "l_partkey", t.part, "p_partkey", "lineitem.l_partkey"),
             (t.lineitem, "l_suppkey", t.supplier, "s_suppkey", "lineitem.l_suppkey"),
             (t.orders, "o_custkey", t.customer, "c_custkey", "orders.o_custkey"),
             (t.labels, "doc_id", t.documents, "doc_id", "labels.doc_id"),
             (t.events, "user_id", t.customer, "c_custkey", "events.user_id"),
             (t.customer, "c_custkey", t.orders, "o_custkey", "customer.c_custkey"),
             (t.documents, "doc_id", t.labels, "doc_id", "documents.doc_id")]
    out = None
    for c, ck, p, pk, name in pairs:
        a = Q.audit_fk(c, ck, p, pk, name).withColumn("key", F.col("key").cast("long"))
        out = a if out is None else out.unionByName(a)
    return out


@query
def audit_not_null(spark, d):
    return Q.audit_not_null(B.panel(T(spark, d)),
                            ["year", "total_price", "priority", "quantity", "tax", "status_priority"])


@query
def drop_missing_subset(spark, d):
    return B.panel(T(spark, d)).dropna("any", subset=["tax", "priority"]).select(
        "entity_id", "year", "tax", "priority")


# ===================================================== step 9-10: resolve, dictionaries
from ..operators import resolve as RS  # noqa: E402


@query
def fuzzy_best(spark, d):
    t = T(spark, d)
    return RS.best_match(B.name_queries(t), B.name_registry(t), threshold=85)


@query
def fuzzy_active(spark, d):
    """S5 + J1: names matched against the active part of the registry only."""
    t = T(spark, d)
    return RS.best_match(B.name_queries(t), B.active_names(t), threshold=85)


@query
def fuzzy_topk_review(spark, d):
    t = T(spark, d)
    out = RS.top_k_review(B.name_queries(t), B.name_registry(t), threshold=70, k=3)
    return out.withColumn("rank", F.col("rank").cast("int"))


@query
def review_decisions(spark, d):
    """J2 answers: of the reviewed names, every third is accepted as the first
    candidate, every third is declared new, the others stay open."""
    review = fuzzy_topk_review(spark, d)
    answers = review.where("decision = 'review' and rank = 1 and query_id % 3 < 2").select(
        "query_id", F.when(F.col("query_id") % 3 == 0, F.col("candidate_id")).alias("candidate_id"))
    return RS.apply_decisions(review, answers)


@query
def resolve_or_register(spark, d):
    t = T(spark, d)
    res, _new = RS.resolve_or_register(B.name_queries(t), B.name_registry(t), threshold=90)
    return res


@query
def new_dictionary_rows(spark, d):
    t = T(spark, d)
    return RS.new_dictionary_rows(t.part.select(*B.DICT_KEYS), B.known_dictionary(t), B.DICT_KEYS, "dict_id")


@query
def dictionary_lookup(spark, d):
    """Detail rows keyed by the natural key get the dictionary id; rows
    without a dictionary entry are dropped (inner join + dropna)."""
    t = T(spark, d)
    known = B.known_dictionary(t)
    return (t.part.select("p_partkey", *B.DICT_KEYS).join(known, B.DICT_KEYS, "inner")
            .dropna(subset=["dict_id"]).select("p_partkey", "dict_id"))


# ===================================================== step 9: reshape
from ..operators import reshape as RP  # noqa: E402

# Header map and table split of the bound order sheet.
ORDER_HEADERS = {"o_orderkey": "submission_id", "o_custkey": "entity_id", "o_orderdate": "datum",
                 "o_totalprice": "total_price", "o_orderstatus": "status",
                 "o_orderpriority": "priority", "o_missing_header": "ignored"}
ORDER_TABLES = {"header": ["entity_id", "datum"], "money": ["total_price"],
                "flags": ["status", "priority"]}
PRIORITY_MAP = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}


@query
def rename_split(spark, d):
    wide = RP.rename(T(spark, d).orders, ORDER_HEADERS)
    return RP.split(wide, ORDER_TABLES, keep=["submission_id"])["flags"]


@query
def rename_split_header(spark, d):
    wide = RP.rename(T(spark, d).orders, ORDER_HEADERS)
    return RP.split(wide, ORDER_TABLES, keep=["submission_id"])["header"]


@query
def rename_split_money(spark, d):
    wide = RP.rename(T(spark, d).orders, ORDER_HEADERS)
    return RP.split(wide, ORDER_TABLES, keep=["submission_id"])["money"]


@query
def recode_yes_no(spark, d):
    o = S.orders(T(spark, d))
    return o.select("submission_id", "flag", RP.recode_yes_no("flag").alias("flag_code"))


@query
def recode_map(spark, d):
    o = T(spark, d).orders
    return o.select("o_orderkey", RP.recode_map("o_orderpriority", PRIORITY_MAP).alias("priority_code"))


@query
def explode_list(spark, d):
    return RP.explode_list(T(spark, d).documents, "text", ["doc_id"])


@query
def defaults(spark, d):
    o = S.orders(T(spark, d)).select("submission_id", "flag")
    return RP.with_defaults(o, {"year": F.lit(S.AS_OF_YEAR - 1),
                                "datum": F.lit("2024-06-30 00:00:00").cast("timestamp_ntz"),
                                "active": F.lit(1), "flag": F.lit("ignored")})


# ===================================================== step 11: ingest, runner
LINE_SHEET = dict(tables={"line_money": ["quantity", "discount"], "line_rates": ["tax"]},
                  types={"quantity": "double", "discount": "double", "tax": "double"})
LINE_WHITELIST = {"line_money": ["submission_id", "row_id", "ingest_seq", "quantity", "discount"],
                  "line_rates": ["submission_id", "row_id", "ingest_seq", "tax"]}


def _ingested(spark, sheets, plan, whitelist=None):
    import uuid

    from ..session import shared_path
    from .ingest import ingest
    return ingest(sheets, plan, shared_path(spark, "ingest", uuid.uuid4().hex), whitelist)


def _ingest_lines(spark, d, table):
    """R17 + S6: validate the staged lines, hold back offending orders, cast,
    split and append to a fresh folder; the result is one table read back."""
    from .ingest import Sheet
    out = _ingested(spark, {"lines": S.lines(T(spark, d))},
                    {"lines": Sheet(rules=[Q.percent(["tax_pct"])], **LINE_SHEET)}, LINE_WHITELIST)
    return spark.read.parquet(out["written"][table]).drop("ingest_seq")


@query
def ingest_append_roundtrip(spark, d):
    return _ingest_lines(spark, d, "line_money")


@query
def ingest_line_rates(spark, d):
    return _ingest_lines(spark, d, "line_rates")


# Headers of the bound part questionnaire.
PART_HEADERS = {"Park neve": "name", "Jogcim": "holder", "Tipus": "p_type", "Marka": "p_brand",
                "Meret": "p_size", "Cimkek": "tags", "Aktiv": "flag"}


def _ingest_parts(spark, d):
    """R17 with every step: two sheets under one gate (a part is held back for
    a bad size of its own or a bad share in any of its lines), headers renamed,
    flags recoded, a default year, part and holder names resolved, dictionary
    ids, and the tags exploded."""
    from .ingest import Dictionary, Names, Sheet
    t = T(spark, d)
    holders = t.nation.select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("entity_name"))
    plan = {
        "parts": Sheet(rename=PART_HEADERS, rules=[Q.nonneg_int(["p_size"]), Q.yes_no(["flag"])],
                       yes_no=["flag"], defaults={"year": F.lit(S.AS_OF_YEAR - 1)},
                       types={"p_size": "int", "flag": "int"},
                       names=[Names("name", B.known_names(t)),
                              Names("holder", holders, "holder_id", "holder_new")],
                       dictionaries=[Dictionary(B.DICT_KEYS, B.known_dictionary(t), "dict_id", "dictionary_new")],
                       tables={"part": ["year", "flag", "dict_id"]}, lists={"part_tag": "tags"}),
        "shares": Sheet(rules=[Q.percent(["share"])], types={"share": "double"}, tables={"part_share": ["share"]})}
    return _ingested(spark, {"parts": S.part_forms(t), "shares": S.part_shares(t)}, plan)


def _ingest_table(table):
    def run(spark, d):
        out = _ingest_parts(spark, d)
        return out["violations"] if table == "violations" else spark.read.parquet(out["written"][table]).drop("ingest_seq")
    QUERIES[f"ingest_{table}"] = run


for _table in ("part", "part_tag", "part_share", "registry_new", "holder_new", "dictionary_new", "violations"):
    _ingest_table(_table)


@query
def ingest_required_details(spark, d):
    """J5 in the load: rows whose details are empty are not appended."""
    from .ingest import Dictionary, Sheet
    t = T(spark, d)
    forms = t.part.select(F.col("p_partkey").alias("submission_id"), F.col("p_partkey").alias("row_id"), *B.DICT_KEYS,
                          F.expr("CASE WHEN p_size > 20 THEN CAST(p_size AS STRING) END").alias("area"),
                          F.expr("nullif(p_brand, 'Brand#11')").alias("state"))
    sheet = Sheet(types={"area": "int"}, tables={"detail": ["dict_id", "area", "state"]},
                  dictionaries=[Dictionary(B.DICT_KEYS, B.known_dictionary(t), "dict_id", "dictionary_new")],
                  required={"detail": ["area", "state"]})
    out = _ingested(spark, {"parts": forms}, {"parts": sheet})
    return spark.read.parquet(out["written"]["detail"])


# ------------------------------------------------ staged files, columns by header
def _staged_orders(spark, d):
    """The orders as CSV files of three makes: columns in one order, in another,
    and without the priority but with a note."""
    import uuid

    from ..session import shared_path
    from ..sources.staged import read_drop
    drop = shared_path(spark, "drops", uuid.uuid4().hex)
    o = T(spark, d).orders.select(F.col("o_orderkey").alias("key"), S.dec_text("o_totalprice").alias("price"),
                                  F.col("o_orderpriority").alias("priority"), F.lit("-").alias("note"), "o_orderstatus")
    for status, cols in (("F", ["key", "price", "priority"]), ("O", ["priority", "key", "price"]),
                         ("P", ["note", "price", "key"])):
        o.where(F.col("o_orderstatus") == status).select(*cols).write.mode("append").option("header", True).csv(f"{drop}/orders")
    return read_drop(spark, drop, {"orders": ["key", "price", "priority"]})


@query
def staged_by_header(spark, d):
    return _staged_orders(spark, d)[0]["orders"].select("key", "price", "priority")


@query
def staged_header_violations(spark, d):
    return _staged_orders(spark, d)[1].select("sheet", "field", "rule").distinct()


# ------------------------------------------------ several drops, one after the other
def _order_drops(t):
    """Order sheets as two deliveries: finished and pending orders, then open ones."""
    o = t.orders.select(F.col("o_orderkey").alias("submission_id"), F.col("o_orderkey").alias("row_id"),
                        F.col("o_custkey").cast("string").alias("entity_id"),
                        F.col("o_orderdate").cast("string").alias("datum"),
                        S.dec_text("o_totalprice").alias("total_price"), "o_orderstatus")
    return {"first": o.where("o_orderstatus <> 'O'").drop("o_orderstatus"),
            "second": o.where("o_orderstatus = 'O'").drop("o_orderstatus")}


ORDER_SHEET = dict(types={"entity_id": "long", "datum": "timestamp_ntz", "total_price": "double"},
                   tables={"master": ["entity_id", "datum", "total_price"]})


def _order_store(spark, d):
    import uuid

    from ..session import shared_path
    from ..sources.drops import DropStore
    from .ingest import Sheet, ingest
    root = shared_path(spark, "ingest", uuid.uuid4().hex)
    for name, sheet in _order_drops(T(spark, d)).items():
        yield DropStore(spark, root), ingest({"orders": sheet}, {"orders": Sheet(**ORDER_SHEET)}, root, drop=name)


@query
def ingest_sequence(spark, d):
    """Every appended row with its place in the order of ingest, over two drops."""
    store = [s for s, _ in _order_store(spark, d)][-1]
    return store.read("master").select("submission_id", "ingest_seq", "entity_id", "total_price")


@query
def ingest_latest(spark, d):
    """S6 + W1: the newest row per entity and day over what two drops appended,
    kept up to date drop by drop (only the parts that a drop touches)."""
    from ..sources.drops import LatestTable
    for store, _ in _order_store(spark, d):
        latest = LatestTable(store, "master", ["entity_id"], ["datum", "ingest_seq"], parts=16)
        latest.fold()
    return latest.read().select("entity_id", "datum", "ingest_seq", "submission_id", "total_price")


@query
def ingest_drops_dictionary(spark, d):
    """J4 over two drops: what the first one added is known to the second, and
    its ids go on where the first one's ended."""
    import uuid

    from ..session import shared_path
    from ..sources.drops import DropStore
    from .ingest import Dictionary, Sheet, ingest
    t = T(spark, d)
    root = shared_path(spark, "ingest", uuid.uuid4().hex)
    sheet = Sheet(rename=PART_HEADERS, types={"p_size": "int"}, tables={"part": ["dict_id"]},
                  dictionaries=[Dictionary(B.DICT_KEYS, B.known_dictionary(t), "dict_id", "dictionary_new")])
    forms = S.part_forms(t)
    for name, some in (("small", "cast(Meret as int) <= 25"), ("large", "cast(Meret as int) > 25"),
                       ("again", "cast(Meret as int) > 10")):
        ingest({"parts": forms.where(some)}, {"parts": sheet}, root, drop=name)
    return DropStore(spark, root).read("part").groupBy("submission_id").agg(
        F.max("dict_id").alias("dict_id"), F.count_distinct("dict_id").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"))


BATCH = [dict(TOTALS_CFG, name="totals", agg="full"), dict(GROWTH_CFG, name="growth", agg="small"),
         dict(EMAIL_CFG, name="emails"), dict(MISSING_CFG, name="missing"),
         {"type": "no_such_report", "name": "broken"}]


@query
def run_batch(spark, d):
    """One written panel, several reports, failures isolated; the result
    holds every cell of every section, and a row for each failed report."""
    from .runner import Context, cells, run_batch as _run
    t = T(spark, d)
    ctx = Context(B.AGG, B.management_latest(t), B.management_emails(t))
    sections, failures = _run(B.panel(t), BATCH, ctx)
    out = spark.createDataFrame([(name, "failed", name, "error", None, None) for name, _ in failures],
                                "report string, section string, row_key string, column_name string, "
                                "number double, text string")
    for (report, section), df in sections.items():
        out = out.unionByName(cells(report, section, df))
    return out


# Names used by the build plan for two of the queries above.
QUERIES["safe_pct"] = safe_pct_query
QUERIES["round_by_kind"] = round_by_kind_query
