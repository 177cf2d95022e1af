"""Binding of the generic roles (registry, master data, yearly facts,
management contacts) to the driver's TPC-H-like tables.

entity = customer, region/county = region/nation of the customer, active =
non-negative balance, yearly master data and the two-key fact = orders
(newest order per customer and order year), the three-key fact (a grant-like
table with a third key) = orders per customer, year and status, a second
two-key fact = order lines per customer and ship year, the non-year-key table
(management contacts) = events per user and event type.

Every function returns a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exact_sum, few_units, of_units, units
from ..operators.aggregate import exact
from ..operators.latest import latest_by
from ..operators.panel import assemble_panel, bucketed, entity_base, reduce_fact
from ..sources.tables import Tables

# Aggregation config of the bound panel (metric -> kind), in the
# shape of the reference's "small" and "full" sets. The bound tables hold money,
# quantities and rates with two places; a value with more fails the report.
PLACES = 2
_SUM, _MEAN = exact("sum", PLACES), exact("mean", PLACES)
AGG_SMALL = {"total_price": _SUM, "quantity": _SUM, "discount": _MEAN}
AGG_FULL = {"total_price": _SUM, "quantity": _SUM, "discount": _MEAN,
            "extended_price": _SUM, "status_price": _SUM, "tax": _MEAN}
AGG = {"small": AGG_SMALL, "full": AGG_FULL}

EMAIL_SQL = ("concat(lower(replace(c_name, '#', CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE '.' END)),"
             " '@', lower(c_mktsegment), CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '.com' END)")
PHONE_SQL = "concat('+36 ', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE '' END)"
MGMT_EMAIL_SQL = ("CASE WHEN event_type = 'error' THEN NULL "
                  "ELSE concat(event_type, '.', CAST(user_id AS STRING), '@mgmt.example') END")

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def registry(t: Tables) -> DataFrame:
    """Entity registry with its dimension attributes (nation/region are
    fixed-size dimensions; Spark broadcasts them by its size estimate)."""
    c = t.customer
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = (c.join(n, c.c_nationkey == n.n_nationkey, "left")
          .join(r, F.col("n_regionkey") == r.r_regionkey, "left"))
    return j.select(F.col("c_custkey").alias("entity_id"),
                    F.col("c_name").alias("entity_name"),
                    F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("active"),
                    F.col("r_name").alias("region"),
                    F.col("n_name").alias("county"),
                    F.expr(EMAIL_SQL).alias("email"))


def orders_versions(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(F.col("o_custkey").alias("entity_id"),
                    F.year("o_orderdate").cast("int").alias("year"),
                    "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice",
                    "o_orderpriority")


def orders_latest(t: Tables) -> DataFrame:
    """W1 on the yearly master data: newest order per (customer, year). No
    pre-partitioning: the partial WindowGroupLimit before the shuffle keeps one
    row per key and map task, so a hot customer never ships its raw rows to a
    single task."""
    return latest_by(orders_versions(t), ["entity_id", "year"],
                     [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


def base(t: Tables) -> DataFrame:
    """Registry LEFT JOIN latest master data."""
    return entity_base(registry(t), orders_latest(t))


def fact_orders(t: Tables) -> DataFrame:
    return orders_latest(t).select(
        "entity_id", "year", F.col("o_totalprice").alias("total_price"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))


def fact_lines(t: Tables) -> DataFrame:
    """Newest line per (customer, ship year). Lines are first reduced to the
    newest per (order, ship year) -- map-side, by the partial WindowGroupLimit
    -- so only those rows cross the join with orders; a hot order key is cut
    to one row per map task before any shuffle."""
    li = t.lineitem.withColumn("year", F.year("l_shipdate").cast("int"))
    order = [F.col(c).desc() for c in LINE_ORDER]
    per_order = latest_by(li, ["l_orderkey", "year"], order)
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"),
                        F.col("o_custkey").alias("entity_id"))
    joined = per_order.join(o, "l_orderkey")
    newest = latest_by(joined, ["entity_id", "year"], order)
    return newest.select("entity_id", "year",
                         F.col("l_quantity").alias("quantity"),
                         F.col("l_extendedprice").alias("extended_price"),
                         F.col("l_discount").alias("discount"),
                         F.expr("nullif(l_tax, 0)").alias("tax"))


def status_latest(t: Tables) -> DataFrame:
    """W1 with a three-column key (map-side partial limit, then the
    first-non-null reduction to (entity, year) with partial aggregation)."""
    return latest_by(orders_versions(t), ["entity_id", "year", "o_orderstatus"],
                     [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


def fact_status(t: Tables) -> DataFrame:
    s = status_latest(t).select(
        "entity_id", "year", "o_orderstatus",
        F.col("o_totalprice").alias("status_price"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("status_priority"))
    return reduce_fact(s, ["entity_id", "year"], ["o_orderstatus"],
                       ["status_price", "status_priority"])


def panel(t: Tables) -> DataFrame:
    """The (entity, year) panel all reports read.

    The yearly master data and the orders fact are the same newest-order
    rows here, so the base view takes the fact's columns in its own join
    (one window and one join less than joining that fact again)."""
    b = entity_base(registry(t), fact_orders(t), master_cols=("year", "total_price", "priority"))
    return assemble_panel(b, [fact_lines(t), fact_status(t)], numeric=list(AGG_FULL))


def event_versions(t: Tables) -> DataFrame:
    """Events as yearly facts: all of them are of one month, so the day of the
    month stands for one of the years that orders have."""
    return t.events.select(F.col("user_id").alias("entity_id"), F.expr("1995 + day(ts) % 7").alias("year"),
                           "event_type", "ts", "event_id", "value")


def fact_events(t: Tables) -> DataFrame:
    """A two-key fact: the newest event per (entity, year)."""
    e = latest_by(event_versions(t), ["entity_id", "year"], [F.col("ts").desc(), F.col("event_id").desc()])
    return e.select("entity_id", "year", F.col("value").alias("event_value"), F.col("event_type").alias("event_kind"))


def fact_event_kinds(t: Tables) -> DataFrame:
    """A three-key fact (entity, year, kind), reduced to the first non-null."""
    e = latest_by(event_versions(t), ["entity_id", "year", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    e = e.select("entity_id", "year", "event_type", F.expr("CASE WHEN value >= 50 THEN value END").alias("large_value"),
                 F.expr("CASE WHEN value < 50 THEN value END").alias("small_value"))
    return reduce_fact(e, ["entity_id", "year"], ["event_type"], ["large_value", "small_value"])


PANEL_KEYS = ("entity_id", "year")


def panel_five(t: Tables, root: str, buckets: int = 16) -> DataFrame:
    """J6 with base and five facts of both key shapes, kept under ``root`` in
    buckets of (entity, year): the panel joins them without an exchange. On a
    cluster choose the buckets by the size of the largest (128 MB each)."""
    sides = {"base": base(t), "orders": fact_orders(t), "lines": fact_lines(t), "status": fact_status(t),
             "events": fact_events(t), "kinds": fact_event_kinds(t)}
    kept = {n: bucketed(df, PANEL_KEYS, buckets, f"{root}/{n}") for n, df in sides.items()}
    return assemble_panel(kept.pop("base"), list(kept.values()), numeric=[*AGG_FULL, "event_value", "large_value", "small_value"])


def management_latest(t: Tables) -> DataFrame:
    """W1 with a non-year key: newest contact row per (entity, contact)."""
    e = t.events.select(F.col("user_id").alias("entity_id"), "event_type", "ts",
                        "event_id", F.expr(MGMT_EMAIL_SQL).alias("management_email"))
    return latest_by(e, ["entity_id", "event_type"],
                     [F.col("ts").desc(), F.col("event_id").desc()])


def management_emails(t: Tables) -> DataFrame:
    """One row per entity, its contact e-mails sorted and '; '-joined."""
    from ..operators.aggregate import joined_distinct
    # distinct (entity, address) first: duplicates are removed across tasks,
    # so a hot entity only brings its distinct addresses to its group
    pairs = management_latest(t).select("entity_id", "management_email").distinct()
    return pairs.groupBy("entity_id").agg(joined_distinct("management_email").alias("management_email"))


def submissions(t: Tables) -> dict[str, DataFrame]:
    """Tables written by one submission share (entity, timestamp): order
    headers and line totals per (customer, order date), with a flag for those
    with returned lines. Used by the exact-timestamp join (J11)."""
    o = t.orders
    header = (o.groupBy(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("ts"))
               .agg(F.count(F.lit(1)).alias("n_orders"),
                    exact_sum("o_totalprice", PLACES).alias("total_price")))
    # Lines are summed per order first (partial aggregation cuts a hot order to
    # one row per map task), so the join with orders is one-to-one and raw
    # lines never cross it.
    per_order = (t.lineitem.groupBy("l_orderkey")
                 .agg(exact_sum("l_quantity", PLACES).alias("q"),
                      exact_sum("l_extendedprice", PLACES).alias("x"),
                      exact_sum("l_discount", PLACES).alias("d"),
                      F.count("l_discount").alias("nd"),
                      F.max(F.col("l_returnflag") == "R").alias("has_return")))
    lines = per_order.join(o.select(F.col("o_orderkey").alias("l_orderkey"),
                                    F.col("o_custkey").alias("entity_id"),
                                    F.col("o_orderdate").alias("ts")), "l_orderkey")
    line_tot = (lines.groupBy("entity_id", "ts")
                .agg(exact_sum("q", PLACES).alias("quantity"),
                     exact_sum("x", PLACES).alias("extended_price"),
                     F.try_divide(exact_sum("d", PLACES), F.sum("nd").cast("double")).alias("discount"),
                     F.max("has_return").alias("has_return")))
    return {"header": header, "lines": line_tot}


# What a submission says, by the measures of its lines (SQL over one
# row a line, good for Spark and DuckDB) and of its orders, and the seven tables
# that share a submission's timestamp. Amounts and rates have two places.
LINE_SUMS = {"quantity": "l_quantity", "price": "l_extendedprice", "n_lines": "1",
             "n_big": "CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END",
             "discounts": "l_discount", "taxes": "l_tax",
             **{f"qty_{f}": f"CASE WHEN l_returnflag = '{f.upper()}' THEN l_quantity ELSE 0 END" for f in "arn"},
             **{f"price_{f}": f"CASE WHEN l_returnflag = '{f.upper()}' THEN l_extendedprice ELSE 0 END" for f in "arn"},
             **{f"price_{f}": f"CASE WHEN l_linestatus = '{f.upper()}' THEN l_extendedprice ELSE 0 END" for f in "fo"}}
LINE_FLAGS = {"has_returned": "l_returnflag = 'R'", "has_accepted": "l_returnflag = 'A'",
              "has_open": "l_linestatus = 'O'", "has_big": "l_quantity >= 45"}
ORDER_SUMS = {"total_price": "o_totalprice", "n_orders": "1",
              **{f"n_{w}": f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END"
                 for w, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"), ("low", "5-LOW"))}}
RATES = {"urgent_rate": ("n_urgent", "n_orders"), "high_rate": ("n_high", "n_orders"),
         "discount_rate": ("discounts", "n_lines"), "tax_rate": ("taxes", "n_lines"),
         "returned_rate": ("qty_r", "quantity")}
SUBMISSION_TABLES = {
    "header": ["total_price", "n_orders", "urgent_rate", "high_rate"],
    "cost": ["price"],
    "links": ["has_returned", "has_accepted", "has_open", "has_big"],
    "area": ["quantity", "n_big", "discount_rate", "tax_rate"],
    "firms": ["n_lines", "qty_a", "qty_r", "qty_n", "returned_rate"],
    "sources": ["price_a", "price_r", "price_n", "price_f", "price_o", "n_urgent", "n_high", "n_low", "discounts", "taxes"],
}
ROWS_TABLE = "lines_returned"  # one row a returned line
SUMMED = [c for cols in SUBMISSION_TABLES.values() for c in cols if c not in RATES]
RATED = list(RATES)


AMOUNTS = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "orders": ["o_totalprice"]}


def submission_rows(t: Tables) -> dict[str, DataFrame]:
    """What the seven tables of all submissions are written from, (entity, timestamp)
    being customer and order date: ``wide``, one row a submission with every measure,
    and the returned lines. Lines are summed per order first, so raw lines never
    cross a join. Amounts of few units, as a first pass finds them, are summed as
    longs, others as decimals."""
    few = all(few_units(getattr(t, name), cols, PLACES) for name, cols in AMOUNTS.items())

    def total(x: str) -> Column:
        return F.sum(units(F.expr(x), PLACES)) if few else exact_sum(F.expr(x), PLACES)

    per_order = t.lineitem.groupBy("l_orderkey").agg(
        *[total(x).alias(m) for m, x in LINE_SUMS.items()],
        *[F.max(F.expr(x).cast("int")).alias(m) for m, x in LINE_FLAGS.items()])
    keys = [F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("ts")]
    o = t.orders
    lines = per_order.join(o.select(F.col("o_orderkey").alias("l_orderkey"), *keys), "l_orderkey")
    lines = lines.groupBy("entity_id", "ts").agg(
        *[(F.sum(m) if few else exact_sum(m, PLACES)).alias(m) for m in LINE_SUMS], *[F.max(m).alias(m) for m in LINE_FLAGS])
    head = o.groupBy(*keys).agg(*[total(x).alias(m) for m, x in ORDER_SUMS.items()])
    wide = head.join(lines, ["entity_id", "ts"])
    if few:
        wide = wide.withColumns({m: of_units(m, PLACES) for m in [*ORDER_SUMS, *LINE_SUMS]})
    wide = wide.withColumns({r: F.col(a) / F.col(b) * 100 for r, (a, b) in RATES.items()})
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").join(
        o.select(F.col("o_orderkey").alias("l_orderkey"), *keys), "l_orderkey").drop("l_orderkey")
    return {"wide": wide, ROWS_TABLE: returned}


def submission_tables(rows: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The seven tables of all submissions: six with one row a submission, cut from
    ``rows["wide"]``, and one with a row for each returned line."""
    wide = rows["wide"]
    return {**{name: wide.select("entity_id", "ts", *cols) for name, cols in SUBMISSION_TABLES.items()},
            ROWS_TABLE: rows[ROWS_TABLE]}


def exact_ts_join(t: Tables) -> DataFrame:
    """Inner join on (entity, exact timestamp), restricted to submissions
    with a returned line."""
    s = submissions(t)
    j = s["header"].join(s["lines"], ["entity_id", "ts"], "inner")
    j = j.filter("has_return").drop("has_return")
    return j.withColumn("year", F.year("ts").cast("int"))


# Query names for the fuzzy matcher: the part name with its tokens swapped and
# the first one upper-cased, a comma added, the last character dropped, or all
# of these, chosen by part key.
PERTURB_SQL = """CASE p_partkey % 4
  WHEN 0 THEN concat(upper(substr(p_name, length(split_part(p_name, ' ', 1)) + 2)), ' ', split_part(p_name, ' ', 1))
  WHEN 1 THEN concat(split_part(p_name, ' ', 1), ', ', substr(p_name, length(split_part(p_name, ' ', 1)) + 2))
  WHEN 2 THEN substr(p_name, 1, length(p_name) - 1)
  ELSE substr(concat(upper(substr(p_name, length(split_part(p_name, ' ', 1)) + 2)), ', ', split_part(p_name, ' ', 1)),
              1, length(p_name) + 1)
END"""


def name_registry(t: Tables) -> DataFrame:
    """Registry for name resolution: one id (smallest part key) per part name."""
    return t.part.groupBy(F.col("p_name").alias("entity_name")).agg(F.min("p_partkey").alias("entity_id"))


#: The first days of shipping: what had been shipped by then is known already.
FIRST_DAYS = "1995-01-03"


def known_names(t: Tables) -> DataFrame:
    """Registry built by earlier batches: the names of parts shipped in the
    first days."""
    early = (t.lineitem.filter(F.col("l_shipdate") < F.lit(FIRST_DAYS).cast("timestamp_ntz"))
             .select(F.col("l_partkey").alias("p_partkey")).distinct())
    return (t.part.join(early, "p_partkey", "left_semi").groupBy(F.col("p_name").alias("entity_name"))
            .agg(F.min("p_partkey").alias("entity_id")))


def active_names(t: Tables) -> DataFrame:
    """The registry of parts that are still shipped (one of their lines is
    open); names of others are not matched."""
    live = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return (t.part.join(live, "p_partkey", "left_semi").groupBy(F.col("p_name").alias("entity_name"))
            .agg(F.min("p_partkey").alias("entity_id")))


def name_queries(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("query_id"), F.expr(PERTURB_SQL).alias("name"))


DICT_KEYS = ["p_type", "p_brand", "p_size"]


def known_dictionary(t: Tables) -> DataFrame:
    """Dictionary built by earlier batches: the (type, brand, size) of parts
    shipped before 1995-04-01, numbered in key order."""
    from ..operators.resolve import dense_ids
    early = (t.lineitem.filter(F.col("l_shipdate") < F.lit("1995-04-01").cast("timestamp_ntz"))
             .select(F.col("l_partkey").alias("p_partkey")).distinct())
    keys = t.part.join(early, "p_partkey", "left_semi").select(*DICT_KEYS).distinct()
    return dense_ids(keys, DICT_KEYS, 0, "dict_id")
