"""Questionnaire-like input sheets derived from the driver tables.

Ingest reads every field as text (S1) and validates before casting; these
sheets give the rules realistic text over the whole tables: e-mails and
phones with some invalid values, numbers rendered as decimal text, dates
with impossible days, yes/no flags with a third answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.tables import Tables
from .bindings import EMAIL_SQL, PERTURB_SQL, PHONE_SQL

# The reference-year bounds of the rule bindings (as_of is a
# parameter, never read from the clock).
AS_OF_YEAR = 2024
FIRST_YEAR = 1980


def dec_text(expr: str, scale: int = 2) -> F.Column:
    return F.expr(f"CAST(CAST({expr} AS DECIMAL(18,{scale})) AS STRING)")


def customers(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("submission_id"), F.col("c_custkey").alias("row_id"),
        F.col("c_name").alias("name"), F.expr(EMAIL_SQL).alias("email"),
        F.expr(PHONE_SQL).alias("phone"), dec_text("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("segment_ci"))


def orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("submission_id"), F.col("o_orderkey").alias("row_id"),
        F.expr("concat(CAST(year(o_orderdate) AS STRING), '-', "
               "lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', "
               "lpad(CAST(day(o_orderdate) + 10 * (o_orderkey % 3) AS STRING), 2, '0'))").alias("order_date"),
        F.expr("CAST(year(o_orderdate) - 20 + o_custkey % 50 AS STRING)").alias("report_year"),
        F.expr("CAST(year(o_orderdate) + 25 + o_custkey % 5 AS STRING)").alias("planned_year"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'igen' WHEN 'O' THEN 'NEM' ELSE 'talan' END").alias("flag"),
        F.col("o_orderpriority").alias("priority"))


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").cast("long").alias("row_id"),
        dec_text("l_discount * 100").alias("discount_pct"), dec_text("l_tax * 1500").alias("tax_pct"),
        dec_text("l_discount").alias("discount"), dec_text("l_tax").alias("tax"),
        dec_text("l_quantity").alias("quantity"))


def parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("submission_id"), F.col("p_partkey").alias("row_id"),
                         F.col("p_size").cast("string").alias("size"), "p_name", "p_type", "p_brand")


def documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("submission_id"), F.col("doc_id").alias("row_id"),
                              "text")


def part_forms(t: Tables) -> DataFrame:
    """One form per part under the questionnaire's own headers: a part name as
    someone might type it, a holder, natural dictionary keys, a list of tags and
    a yes/no flag; every 97th flag is a third answer."""
    return t.part.select(
        F.col("p_partkey").alias("submission_id"), F.col("p_partkey").alias("row_id"),
        F.expr(PERTURB_SQL).alias("Park neve"),
        F.expr("concat(IF(p_partkey % 12 < 10, 'nation ', 'land '), CAST(p_partkey % 12 AS STRING))").alias("Jogcim"),
        F.col("p_type").alias("Tipus"), F.col("p_brand").alias("Marka"),
        F.col("p_size").cast("string").alias("Meret"),
        F.expr("concat(p_type, ' , ', replace(p_name, ' ', ' ,'), ',')").alias("Cimkek"),
        F.expr("CASE WHEN p_partkey % 97 = 0 THEN 'talan' WHEN p_partkey % 2 = 0 THEN 'Igen' "
               "ELSE 'nem' END").alias("Aktiv"))


def part_shares(t: Tables) -> DataFrame:
    """Shares reported with each part's order lines; a few exceed 100."""
    return t.lineitem.select(
        F.col("l_partkey").alias("submission_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_id"),
        dec_text("l_quantity * CASE WHEN l_linenumber >= 7 THEN 2.02 ELSE 2 END").alias("share"))


# Text of a date as different submitters write it, by order priority; every third
# order has a day that may not exist. SQL good for Spark and DuckDB.
_Y, _M, _D = ("CAST(year(o_orderdate) AS {s})", "lpad(CAST(month(o_orderdate) AS {s}), 2, '0')",
              "lpad(CAST(day(o_orderdate) + 10 * (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS {s}), 2, '0')")
DATE_TEXT_SQL = (f"CASE o_orderpriority WHEN '1-URGENT' THEN concat({_Y}, '-', {_M}, '-', {_D})"
                 f" WHEN '2-HIGH' THEN concat({_Y}, '. ', {_M}, '. ', {_D}, '.')"
                 f" WHEN '3-MEDIUM' THEN concat({_M}, '/', {_D}, '/', {_Y})"
                 f" WHEN '4-NOT SPECIFIED' THEN concat({_Y}, '-', {_M}, '-', {_D}, 'T08:05:30Z')"
                 f" WHEN '5-LOW' THEN {_Y} ELSE concat(' ', {_Y}, '/', {_M}, '/', {_D}) END")


def order_dates(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("submission_id"), F.col("o_orderkey").alias("row_id"),
                           F.expr(DATE_TEXT_SQL.replace("{s}", "STRING")).alias("started"))


# Places and kinds as submitters write them, by key; some are in no list.
def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


COUNTY_SQL = _case("c_nationkey", [*Q.COUNTIES, "Pest megye", "baranya", " Zala", "Csongrád", ""])
REGION_SQL = _case("c_custkey % 9", [*Q.REGIONS, "Dunántúl", "ÉSZAK-ALFÖLD"])
KIND_SQL = _case("c_custkey % 5", [Q.PROVIDER_KINDS[0], " egyéb ", "BETELEPÜLT VÁLLALKOZÁS", "más", "Egyéb"])
CONDITION_SQL = _case("c_custkey % 4", [Q.CONDITIONS[0], "bővítendő ", "romos", "FELÚJÍTANDÓ"])


def places(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("submission_id"), F.col("c_custkey").alias("row_id"),
        F.expr(COUNTY_SQL).alias("county"), F.expr(REGION_SQL).alias("region"),
        F.expr(KIND_SQL).alias("provider_kind"), F.expr(CONDITION_SQL).alias("condition"))


def areas(t: Tables) -> DataFrame:
    """Areas and sources of each order line: parts, and the total they are held
    against (a cent too much where the line number is 6 or 7)."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").cast("long").alias("row_id"),
        dec_text("l_quantity").alias("built"), dec_text("l_discount * 100").alias("free"),
        dec_text("l_quantity + l_tax * 100").alias("usable"),
        dec_text("l_extendedprice").alias("own"), dec_text("l_tax").alias("state"),
        dec_text("l_extendedprice + l_tax + CASE WHEN l_linenumber >= 6 THEN 0.01 ELSE 0 END").alias("total"))
