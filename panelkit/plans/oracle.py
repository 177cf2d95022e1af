"""DuckDB SQL for every registered query (the independent oracle).

Written as plain ANSI SQL over the driver's tables (pre-registered views);
pivots are conditional aggregates, latest rows are ``QUALIFY row_number()``,
first non-null is ``arg_min ... FILTER``. The small Python helpers only
expand per-metric / per-year column lists.
"""

from __future__ import annotations

from ..operators import quality as Q
from . import bindings as B
from . import catalog as C
from . import sheets as S

ORACLE: dict[str, str] = {}


def sql_sum(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE), 0)"


def sql_mean(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE) / count({x})"


def sql_metric(m: str, kind: str, src: str | None = None) -> str:
    src = src or m
    return (sql_sum(src) if kind == "sum" else sql_mean(src)) + f" AS {m}"


def sql_pct(n: str, d: str) -> str:
    return f"coalesce(({n}) / nullif(({d}), 0) * 100, 0)"


def sql_ratio(n: str, d: str) -> str:
    return f"coalesce(({n}) / nullif(({d}), 0), 0)"


def re2(x: str) -> str:
    # numpy's rounding: scale, nearest whole number, scale back; -0.0 -> 0.0
    return f"(round_even(({x}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE + 0.0::DOUBLE)"


def rk(x: str) -> str:
    return f"(CASE WHEN kind = 'sum' THEN round_even({x}, 0) + 0.0::DOUBLE ELSE {re2(x)} END)"


def metrics_sql(spec: dict) -> str:
    return ", ".join(sql_metric(m, k) for m, k in spec.items())


def long_sql(src: str, ids: list[str], spec: dict) -> str:
    """Wide metric columns of ``src`` -> (ids..., metric, kind, value)."""
    idl = ", ".join(ids)
    parts = [f"SELECT {idl}, '{m}' AS metric, '{k}' AS kind, CAST({m} AS DOUBLE) AS value FROM {src}"
             for m, k in spec.items()]
    return " UNION ALL ".join(parts)


EMAIL = ("concat(lower(replace(c.c_name, '#', CASE WHEN c.c_custkey % 7 = 0 THEN ' ' ELSE '.' END)),"
         " '@', lower(c.c_mktsegment), CASE WHEN c.c_custkey % 11 = 0 THEN '' ELSE '.com' END)")
MGMT_EMAIL = ("CASE WHEN event_type = 'error' THEN NULL "
              "ELSE concat(event_type, '.', CAST(user_id AS VARCHAR), '@mgmt.example') END")
LINE_ORDER = ", ".join(f"l.{c} DESC" for c in B.LINE_ORDER)

CTE_REG = f"""reg AS (
  SELECT c.c_custkey AS entity_id, c.c_name AS entity_name,
         CASE WHEN c.c_acctbal >= 0 THEN 1 ELSE 0 END AS active,
         r.r_name AS region, n.n_name AS county, {EMAIL} AS email
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

CTE_ORD = """ord_latest AS (
  SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey,
         o_orderdate, o_orderstatus, o_totalprice, o_orderpriority
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate)
                             ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""

CTE_BASE = """base AS (SELECT reg.*, ol.year FROM reg LEFT JOIN ord_latest ol ON reg.entity_id = ol.entity_id)"""

CTE_LINES = f"""lines_latest AS (
  SELECT o.o_custkey AS entity_id, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         l.l_quantity AS quantity, l.l_extendedprice AS extended_price,
         l.l_discount AS discount, nullif(l.l_tax, 0) AS tax
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  QUALIFY row_number() OVER (PARTITION BY o.o_custkey, year(l.l_shipdate) ORDER BY {LINE_ORDER}) = 1)"""

CTE_STATUS = """status_v AS (
  SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus,
         o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS pr
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderstatus
                             ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
status_first AS (
  SELECT entity_id, year,
         arg_min(o_totalprice, o_orderstatus) FILTER (WHERE o_totalprice IS NOT NULL) AS status_price,
         arg_min(pr, o_orderstatus) FILTER (WHERE pr IS NOT NULL) AS status_priority
  FROM status_v GROUP BY entity_id, year)"""

CTE_PANEL = f"""{CTE_REG},
{CTE_ORD},
{CTE_BASE},
{CTE_LINES},
{CTE_STATUS},
panel AS MATERIALIZED (
  SELECT b.*, f.total_price, f.priority, li.quantity, li.extended_price, li.discount, li.tax,
         s.status_price, s.status_priority
  FROM base b
  LEFT JOIN (SELECT entity_id, year, o_totalprice AS total_price,
                    nullif(o_orderpriority, '5-LOW') AS priority FROM ord_latest) f
         ON b.entity_id = f.entity_id AND b.year = f.year
  LEFT JOIN lines_latest li ON b.entity_id = li.entity_id AND b.year = li.year
  LEFT JOIN status_first s ON b.entity_id = s.entity_id AND b.year = s.year)"""

CTE_MGMT = f"""mgmt AS (
  SELECT user_id AS entity_id, event_type, event_id, ts, {MGMT_EMAIL} AS management_email
  FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
mgmt_joined AS (
  SELECT entity_id, coalesce(string_agg(DISTINCT management_email, '; ' ORDER BY management_email), '')
         AS management_email
  FROM mgmt GROUP BY entity_id)"""


def yin(years) -> str:
    return ", ".join(str(int(y)) for y in years)


def o(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# ======================================================= step 1
ORACLE["latest_orders"] = f"""WITH {CTE_ORD}
SELECT entity_id, year, o_orderkey, o_orderdate, o_totalprice FROM ord_latest"""

ORACLE["latest_by_status"] = f"""WITH {CTE_STATUS}
SELECT entity_id, year, o_orderstatus, o_orderkey, o_totalprice FROM status_v"""

ORACLE["latest_events_daily"] = """SELECT user_id, date_trunc('day', ts) AS day, event_id, event_type, value
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1"""

ORACLE["latest_events_kind"] = f"""WITH {CTE_MGMT}
SELECT entity_id, event_type, event_id, ts, management_email FROM mgmt"""

ORACLE["latest_max_by"] = """SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year,
       max(o_orderdate) AS o_orderdate,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
       arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders GROUP BY o_custkey, year(o_orderdate)"""

ORACLE["entity_base"] = f"""WITH {CTE_REG}, {CTE_ORD}, {CTE_BASE} SELECT * FROM base"""


# ======================================================= step 2
ORACLE["group_year_agg"] = f"""WITH {CTE_PANEL}
SELECT region, year, {metrics_sql(B.AGG_SMALL)}, count(DISTINCT entity_id) AS n_entities
FROM panel WHERE year IN (1996, 1997, 1998) AND region IS NOT NULL
GROUP BY region, year"""

ORACLE["sum_null_zero"] = f"""SELECT l_returnflag, l_linestatus, CAST(l_discount = 0 AS INTEGER) AS zero_discount,
       {sql_sum('nullif(l_discount, 0)')} AS sum_discount, count(*) AS n_rows
FROM lineitem GROUP BY l_returnflag, l_linestatus, CAST(l_discount = 0 AS INTEGER)"""

ORACLE["distinct_entities_year"] = f"""WITH {CTE_PANEL}
SELECT year, count(DISTINCT entity_id) AS n_entities FROM panel WHERE year IS NOT NULL GROUP BY year"""

ORACLE["distinct_entities_window"] = f"""WITH {CTE_PANEL}
SELECT region, count(DISTINCT entity_id) AS n_entities FROM panel
WHERE year IN (1996, 1997, 1998) GROUP BY region"""

ORACLE["entity_list"] = f"""WITH {CTE_PANEL}
SELECT DISTINCT county FROM panel WHERE county IS NOT NULL"""

ORACLE["safe_pct_query"] = f"""SELECT l_discount, {re2(sql_pct('tax_amount', 'discount_amount'))} AS pct
FROM (SELECT l_discount,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax_amount,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount_amount
      FROM lineitem GROUP BY l_discount)"""


def _region_year(years, spec, extra_ids=(), where=""):
    ids = ["region", "year", *extra_ids]
    return f"""WITH {CTE_PANEL},
g AS (SELECT region, year, count(DISTINCT entity_id) AS n_entities, {metrics_sql(spec)}
      FROM panel WHERE year IN ({yin(years)}) AND region IS NOT NULL {where} GROUP BY region, year),
long AS ({long_sql('g', ids, spec)})"""


ORACLE["round_by_kind_query"] = _region_year([1997, 1998], B.AGG_FULL) + f"""
SELECT region, year, metric, {rk('value')} AS value FROM long"""

ORACLE["per_entity_avg"] = _region_year([1996, 1997, 1998], B.AGG_SMALL, ["n_entities"]) + f"""
SELECT region, year, metric,
       {re2(f"CASE WHEN kind = 'sum' THEN {sql_ratio('value', 'n_entities')} ELSE value END")} AS per_entity
FROM long"""


# ======================================================= step 3
ORACLE["panel_first_nonnull"] = f"""WITH {CTE_STATUS} SELECT * FROM status_first"""

ORACLE["panel_wide"] = f"""WITH {CTE_PANEL} SELECT * FROM panel"""

ORACLE["panel_five"] = f"""WITH {CTE_PANEL},
ev AS (SELECT user_id AS entity_id, 1995 + day(ts) % 7 AS year, event_type, ts, event_id, value FROM events),
e2 AS (SELECT entity_id, year, value AS event_value, event_type AS event_kind FROM ev
       QUALIFY row_number() OVER (PARTITION BY entity_id, year ORDER BY ts DESC, event_id DESC) = 1),
e3 AS (SELECT entity_id, year,
              arg_min(value, event_type) FILTER (WHERE value >= 50) AS large_value,
              arg_min(value, event_type) FILTER (WHERE value < 50) AS small_value
       FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY entity_id, year, event_type
                                                         ORDER BY ts DESC, event_id DESC) = 1)
       GROUP BY entity_id, year)
SELECT p.*, e2.event_value, e2.event_kind, e3.large_value, e3.small_value FROM panel p
LEFT JOIN e2 ON p.entity_id = e2.entity_id AND p.year = e2.year
LEFT JOIN e3 ON p.entity_id = e3.entity_id AND p.year = e3.year"""


def _dups(side, src):
    return (f"SELECT '{side}' AS side, count(*) AS dup_keys FROM (SELECT entity_id, year FROM {src} "
            f"GROUP BY entity_id, year HAVING count(*) > 1) HAVING count(*) > 0")


ORACLE["panel_cardinality"] = f"""WITH {CTE_PANEL}
{_dups('base', '(SELECT * FROM base WHERE year IS NOT NULL)')}
UNION ALL {_dups('orders', 'ord_latest')}
UNION ALL {_dups('lines', 'lines_latest')}
UNION ALL {_dups('status', 'status_first')}
UNION ALL {_dups('status_versions', 'status_v')}"""


# ======================================================= step 4-6 helpers
def _pivot_sql(group, years, spec, src_where):
    """Group x <m>_<y>, filled with 0, rounded."""
    cols = ", ".join(
        f"coalesce(max(CASE WHEN year = {y} THEN {m} END), 0) AS {m}_{y}"
        for m in sorted(spec) for y in years)
    return f"""WITH {CTE_PANEL},
cells AS (SELECT {group}, year, {metrics_sql(spec)} FROM panel
          WHERE year IN ({yin(years)}) AND {group} IS NOT NULL {src_where} GROUP BY {group}, year)
SELECT {group}, {cols} FROM cells GROUP BY {group}"""


ORACLE["pivot_metric_year"] = _pivot_sql("region", C.MULTI_CFG["years"], B.AGG_SMALL, "")
ORACLE["report_multi_metric"] = _pivot_sql("region", C.MULTI_CFG["years"], B.AGG_FULL, "")


def _year_totals_sql(years, spec, where=""):
    return f"""WITH {CTE_PANEL},
g AS (SELECT year, count(DISTINCT entity_id) AS n, {metrics_sql(spec)}
      FROM panel WHERE year IN ({yin(years)}) {where} GROUP BY year),
long AS (SELECT *, value / nullif(n, 0) AS pe FROM ({long_sql('g', ['year', 'n'], spec)}))"""


def _transpose_totals():
    ys = C.TOTALS_PLAIN_CFG["years"]
    cols = ", ".join(
        f"max(CASE WHEN year = {y} THEN value END) AS y{y}_total, "
        f"max(CASE WHEN year = {y} THEN pe END) AS y{y}_per_entity" for y in ys)
    return _year_totals_sql(ys, B.AGG_SMALL) + f"\nSELECT metric, {cols} FROM long GROUP BY metric"


ORACLE["transpose_totals"] = _transpose_totals()


def _totals_change():
    ys = C.TOTALS_PLAIN_CFG["years"]
    w = ", ".join(f"max(CASE WHEN year = {y} THEN value END) AS t{y}, "
                  f"max(CASE WHEN year = {y} THEN pe END) AS p{y}" for y in ys)
    cols = [f"{rk(f't{y}')} AS y{y}_total, {rk(f'p{y}')} AS y{y}_per_entity" for y in ys]
    cols += [f"{rk(sql_pct(f'p{y} - p{py}', f'p{py}'))} AS y{y}_pct" for py, y in zip(ys, ys[1:])]
    f_, l_ = ys[0], ys[-1]
    cols += [f"{rk(f'p{l_} - p{f_}')} AS period_diff",
             f"{rk(sql_pct(f'p{l_} - p{f_}', f'p{f_}'))} AS period_pct"]
    return (_year_totals_sql(ys, B.AGG_FULL)
            + f",\nw AS (SELECT metric, kind, {w} FROM long GROUP BY metric, kind)\n"
            + f"SELECT metric, {', '.join(cols)} FROM w")


ORACLE["yoy_per_entity"] = _totals_change()


def _entity_sql(cfg, spec, fill: bool, keys=()):
    ys = sorted(cfg["years"])
    g = cfg["group_col"]
    kl = "".join(f"{k}, " for k in keys)
    where = f"{g} = '{cfg['entity']}'" if "entity" in cfg else f"{g} IS NOT NULL"
    cell = (lambda y: f"coalesce(max(CASE WHEN year = {y} THEN value END), 0)") if fill else \
        (lambda y: f"max(CASE WHEN year = {y} THEN value END)")
    w = ", ".join(f"{cell(y)} AS y{y}" for y in ys)
    f_, l_ = ys[0], ys[-1]
    cols = [f"{rk(f'y{y}')} AS y{y}" for y in ys]
    cols += [f"{rk(f'y{l_} - y{f_}')} AS diff", f"{rk(sql_pct(f'y{l_} - y{f_}', f'y{f_}'))} AS pct"]
    return f"""WITH {CTE_PANEL},
g AS (SELECT {kl}year, {metrics_sql(spec)} FROM panel
      WHERE {where} AND year IN ({yin(ys)}) AND year IS NOT NULL GROUP BY {kl}year),
long AS ({long_sql('g', [*keys, 'year'], spec)}),
w AS (SELECT {kl}metric, kind, {w} FROM long GROUP BY {kl}metric, kind)
SELECT {kl}metric, {', '.join(cols)} FROM w"""


ORACLE["reindex_years"] = _entity_sql(C.REINDEX_CFG, B.AGG_SMALL, fill=True)
ORACLE["first_last_change"] = _entity_sql(C.ENTITY_CFG, B.AGG_FULL, fill=False)
ORACLE["report_all_entities"] = _entity_sql(C.ALL_ENT_CFG, B.AGG_SMALL, fill=True, keys=["county"])


ORACLE["report_entity_sections"] = f"SELECT * RENAME (county AS section) FROM ({ORACLE['report_all_entities']})"


def _at(col, ys, which):
    """The column of the first or last year present."""
    return "CASE " + " ".join(f"WHEN {which} = {y} THEN {col(y)}" for y in ys) + " END"


def _present_change(col, ys, diff, pct, finish=lambda x: x):
    f_, l_ = _at(col, ys, "first_year"), _at(col, ys, "last_year")
    d = f"({l_}) - ({f_})"
    return [f"CASE WHEN first_year < last_year THEN {finish(d)} END AS {diff}",
            f"CASE WHEN first_year < last_year THEN {finish(sql_pct(d, f_))} END AS {pct}"]


SPAN = "(SELECT min(year) AS first_year, max(year) AS last_year FROM {}) span"


def _single(cfg=C.SINGLE_CFG, where=""):
    ys, g, m = sorted(cfg["years"]), cfg["group_col"], cfg["metric"]
    w = ", ".join(f"coalesce(max(CASE WHEN year = {y} THEN v END), 0) AS y{y}" for y in ys)
    cols = [f"y{y}" for y in ys]
    for py, y in zip(ys, ys[1:]):
        cols += [f"y{y} - y{py} AS diff_{y}", f"{sql_pct(f'y{y} - y{py}', f'y{py}')} AS pct_{y}"]
    cols += _present_change(lambda y: f"y{y}", ys, "total_diff", "total_pct")
    return f"""WITH {CTE_PANEL},
cells AS (SELECT {g}, year, {sql_metric('v', B.AGG_FULL[m], m)} FROM panel
          WHERE year IN ({yin(ys)}) AND {g} IS NOT NULL {where} GROUP BY {g}, year),
w AS (SELECT {g}, {w} FROM cells GROUP BY {g})
SELECT {g}, {', '.join(cols)} FROM w, {SPAN.format('cells')}"""


ORACLE["report_single_absent_year"] = _single(dict(C.SINGLE_CFG, years=[1995, 1997, C.ABSENT]))
ORACLE["yoy_diff"] = _single()


def _growth(cfg=C.GROWTH_CFG):
    ys, g = sorted(cfg["years"]), cfg["group_col"]
    spec = {m: B.AGG_SMALL[m] for m in cfg["metrics"]}
    w = []
    for m, k in spec.items():
        for y in ys:
            w.append(f"coalesce(max(CASE WHEN year = {y} THEN {m} END), 0) AS {m}_{y}")
            pe = sql_ratio(m, "n") if k == "sum" else m
            w.append(f"coalesce(max(CASE WHEN year = {y} THEN {pe} END), 0) AS {m}_{y}_pe")
    cols = [f"{re2(f'{m}_{y}')} AS {m}_{y}, {re2(f'{m}_{y}_pe')} AS {m}_{y}_per_entity"
            for m in spec for y in ys]
    for m in spec:
        cols += _present_change(lambda y, m=m: f"{m}_{y}_pe", ys, f"{m}_change_per_entity",
                                f"{m}_change_pct_per_entity", re2)
    return f"""WITH {CTE_PANEL},
f AS (SELECT * FROM panel WHERE year IN ({yin(ys)}) AND {g} IS NOT NULL),
cells AS (SELECT {g}, year, {metrics_sql(spec)} FROM f GROUP BY {g}, year),
cnt AS (SELECT {g}, count(DISTINCT entity_id) AS n FROM f GROUP BY {g}),
w AS (SELECT c.{g}, {', '.join(w)} FROM cells c JOIN cnt ON c.{g} = cnt.{g} GROUP BY c.{g})
SELECT {g}, {', '.join(cols)} FROM w, {SPAN.format('cells')}"""


ORACLE["report_regional_growth"] = _growth()
ORACLE["report_growth_absent_year"] = _growth(dict(C.GROWTH_CFG, years=[1996, 1998, C.ABSENT]))


def _totals(cfg=C.TOTALS_CFG):
    ys = sorted(cfg["years"])
    vals = ", ".join(f"'{v}'" for v in cfg["filter_values"])
    w = []
    for y in ys:
        w.append(f"max(CASE WHEN year = {y} THEN value END) AS y{y}")
        w.append(f"max(CASE WHEN year = {y} THEN CASE WHEN kind = 'sum' THEN "
                 f"{sql_ratio('value', 'n')} ELSE value END END) AS a{y}")
    cols = [f"{re2(f'y{y}')} AS y{y}, {re2(f'a{y}')} AS y{y}_avg" for y in ys]
    cols += _present_change(lambda y: f"a{y}", ys, "growth", "growth_pct", re2)
    return (_year_totals_sql(ys, B.AGG_FULL, f"AND {cfg['filter_col']} IN ({vals})")
            + f",\nw AS (SELECT metric, {', '.join(w)} FROM long GROUP BY metric)\n"
            + f"SELECT metric, {', '.join(cols)} FROM w, {SPAN.format('long')}")


ORACLE["report_totals"] = _totals()
ORACLE["report_totals_absent_year"] = _totals(dict(C.TOTALS_CFG, years=[1996, 1997, C.ABSENT]))

ORACLE["event_value_totals"] = """SELECT event_type,
       coalesce(CAST(sum(CAST(value / 8 AS DECIMAL(28,6))) AS DOUBLE), 0) AS total,
       CAST(sum(CAST(value / 8 AS DECIMAL(28,6))) AS DOUBLE) / count(value) AS average
FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""





ORACLE["report_single_metric"] = _single(
    {"group_col": "region", "metric": "quantity", "years": [1998, 1999, 2000]},
    "AND region IN ('ASIA', 'AMERICA', 'EUROPE')")

ORACLE["report_entity"] = _entity_sql(
    {"group_col": "county", "entity": "NATION_5", "years": [1995, 1997, 2000]}, B.AGG_SMALL, fill=False)


def _plain(ys, spec):
    cols = ", ".join(
        f"max(CASE WHEN year = {y} THEN value END) AS y{y}_total, "
        f"max(CASE WHEN year = {y} THEN pe END) AS y{y}_per_entity" for y in ys)
    return _year_totals_sql(ys, spec) + f"\nSELECT metric, {cols} FROM long GROUP BY metric"


ORACLE["report_totals_plain"] = _plain([1995, 1996], B.AGG_FULL)


def _totals_change_cfg(ys, spec):
    w = ", ".join(f"max(CASE WHEN year = {y} THEN value END) AS t{y}, "
                  f"max(CASE WHEN year = {y} THEN pe END) AS p{y}" for y in ys)
    cols = [f"{rk(f't{y}')} AS y{y}_total, {rk(f'p{y}')} AS y{y}_per_entity" for y in ys]
    cols += [f"{rk(sql_pct(f'p{y} - p{py}', f'p{py}'))} AS y{y}_pct" for py, y in zip(ys, ys[1:])]
    f_, l_ = ys[0], ys[-1]
    cols += [f"{rk(f'p{l_} - p{f_}')} AS period_diff",
             f"{rk(sql_pct(f'p{l_} - p{f_}', f'p{f_}'))} AS period_pct"]
    return (_year_totals_sql(ys, spec)
            + f",\nw AS (SELECT metric, kind, {w} FROM long GROUP BY metric, kind)\n"
            + f"SELECT metric, {', '.join(cols)} FROM w")


ORACLE["report_totals_change"] = _totals_change_cfg([1998, 1999, 2000, 2001], B.AGG_SMALL)


def _yoy_pct():
    ys = [1995, 1996, 1997, 1998, 1999]
    return f"""WITH {CTE_PANEL},
cells AS (SELECT region, year, {sql_sum('total_price')} AS v FROM panel
          WHERE year IN ({yin(ys)}) AND region IS NOT NULL GROUP BY region, year),
grid AS (SELECT r.region, y.year FROM (SELECT DISTINCT region FROM cells) r,
         (SELECT unnest([{yin(ys)}]) AS year) y),
dense AS (SELECT g.region, g.year, coalesce(c.v, 0) AS value FROM grid g
          LEFT JOIN cells c ON g.region = c.region AND g.year = c.year),
l AS (SELECT *, lag(value) OVER (PARTITION BY region ORDER BY year) AS prev FROM dense)
SELECT region, CAST(year AS INTEGER) AS year, {re2('value')} AS value, {re2('value - prev')} AS diff,
       CASE WHEN prev IS NOT NULL THEN {re2(sql_pct('value - prev', 'prev'))} END AS pct
FROM l"""


ORACLE["yoy_pct"] = _yoy_pct()

CTE_SUB = """header AS (SELECT o_custkey AS entity_id, o_orderdate AS ts, count(*) AS n_orders,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
           FROM orders GROUP BY o_custkey, o_orderdate),
lines AS (SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
line_tot AS (SELECT o_custkey AS entity_id, o_orderdate AS ts,
                    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
                    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS extended_price,
                    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS discount
             FROM lines GROUP BY o_custkey, o_orderdate),
j AS (SELECT h.entity_id, h.ts, h.n_orders, h.total_price, t.quantity, t.extended_price, t.discount,
             CAST(year(h.ts) AS INTEGER) AS year
      FROM header h JOIN line_tot t ON h.entity_id = t.entity_id AND h.ts = t.ts
      WHERE EXISTS (SELECT 1 FROM lines x WHERE x.l_returnflag = 'R'
                    AND x.o_custkey = h.entity_id AND x.o_orderdate = h.ts)),
yr AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY year, entity_id ORDER BY ts DESC) = 1),
summary AS (SELECT year, count(entity_id) AS n_entities,
                   CAST(sum(CAST(total_price AS DECIMAL(18,2))) AS DOUBLE) AS sum_total_price,
                   CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_quantity,
                   CAST(sum(CAST(extended_price AS DECIMAL(18,2))) AS DOUBLE) AS sum_extended_price,
                   round_even(avg(discount) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0::DOUBLE AS avg_discount
            FROM yr GROUP BY year)"""

ORACLE["exact_ts_join"] = f"WITH {CTE_SUB} SELECT * FROM j"
ORACLE["yearly_summary"] = f"WITH {CTE_SUB} SELECT * FROM summary"

def _sub_sql():
    def total(x):
        return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
    line = ", ".join([f"{total(x)} AS {m}" for m, x in B.LINE_SUMS.items()]
                     + [f"max(CAST({x} AS INTEGER)) AS {m}" for m, x in B.LINE_FLAGS.items()])
    head = ", ".join(f"{total(x)} AS {m}" for m, x in B.ORDER_SUMS.items())
    rates = ", ".join(f"{a} / {b} * 100 AS {r}" for r, (a, b) in B.RATES.items())
    return f"""l AS (SELECT o_custkey AS entity_id, o_orderdate AS ts, {line}
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderdate),
h AS (SELECT o_custkey AS entity_id, o_orderdate AS ts, {head} FROM orders GROUP BY o_custkey, o_orderdate),
seven AS (SELECT h.*, l.* EXCLUDE (entity_id, ts), {rates} FROM h JOIN l ON h.entity_id = l.entity_id AND h.ts = l.ts
          WHERE has_returned = 1)"""


_R6 = {c: f"round_even({c} * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0::DOUBLE" for c in B.RATED}
ORACLE["exact_ts_join_seven"] = f"""WITH {_sub_sql()}
SELECT entity_id, ts, {', '.join(B.SUMMED)}, {', '.join(f'{x} AS {c}' for c, x in _R6.items())} FROM seven"""
ORACLE["yearly_summary_seven"] = f"""WITH {_sub_sql()},
yr AS (SELECT *, CAST(year(ts) AS INTEGER) AS year FROM seven
       QUALIFY row_number() OVER (PARTITION BY year(ts), entity_id ORDER BY ts DESC) = 1)
SELECT year, count(entity_id) AS n_entities,
       {', '.join(f'CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS sum_{c}' for c in B.SUMMED)},
       {', '.join(f'round_even(avg({c}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0::DOUBLE AS avg_{c}' for c in B.RATED)}
FROM yr GROUP BY year"""

_CMP = ["n_entities", "sum_total_price", "sum_quantity", "sum_extended_price", "avg_discount"]
ORACLE["compare_years"] = f"""WITH {CTE_SUB},
two AS (SELECT * FROM summary WHERE year IN (1997, 1998))
SELECT * FROM (
  SELECT CAST(year AS VARCHAR) AS label, {', '.join(_CMP)} FROM two
  UNION ALL
  SELECT 'difference' AS label, {', '.join(f'max(CASE WHEN year = 1998 THEN {c} END) - max(CASE WHEN year = 1997 THEN {c} END) AS {c}' for c in _CMP)} FROM two)
WHERE (SELECT count(*) FROM two) = 2"""

_PD = ["total_price", "quantity", "discount", "n_entities"]
ORACLE["year_pair_diff"] = f"""WITH {CTE_PANEL},
g AS (SELECT year, {metrics_sql(B.AGG_SMALL)}, count(DISTINCT entity_id) AS n_entities
      FROM panel WHERE year IS NOT NULL GROUP BY year),
two AS (SELECT * FROM g WHERE year IN (1999, 2000))
SELECT CAST(year AS VARCHAR) AS label, {', '.join(_PD)} FROM two
UNION ALL
SELECT 'difference', {', '.join(f'max(CASE WHEN year = 2000 THEN {c} END) - max(CASE WHEN year = 1999 THEN {c} END) AS {c}' for c in _PD)} FROM two"""

# ======================================================= step 7: contacts
_ENTS = f"""{CTE_PANEL},
{CTE_MGMT},
ents AS (SELECT DISTINCT entity_id, entity_name, email FROM panel WHERE active = 1 AND region IN ('AFRICA'))"""

ORACLE["contact_list"] = f"""WITH {_ENTS}
SELECT DISTINCT email FROM (
  SELECT email FROM ents
  UNION ALL
  SELECT m.management_email AS email FROM mgmt m WHERE m.entity_id IN (SELECT entity_id FROM ents))
WHERE email IS NOT NULL"""

ORACLE["contact_details"] = f"""WITH {_ENTS}
SELECT e.entity_id, e.entity_name, e.email, j.management_email
FROM ents e LEFT JOIN mgmt_joined j ON e.entity_id = j.entity_id"""

ORACLE["contacts_all"] = f"""WITH {CTE_REG}, {CTE_ORD}, {CTE_BASE}, {CTE_MGMT},
ents AS (SELECT DISTINCT entity_id, entity_name, email FROM base)
SELECT e.entity_id, e.entity_name, e.email, j.management_email
FROM ents e LEFT JOIN mgmt_joined j ON e.entity_id = j.entity_id"""

ORACLE["missing_panel"] = f"""WITH {CTE_PANEL}, {CTE_MGMT},
f AS (SELECT * FROM panel WHERE active = 1 AND region IN ('AFRICA', 'EUROPE')),
miss AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f h WHERE h.year = 1998 AND h.entity_id = f.entity_id))
SELECT m.entity_id, m.entity_name,
       arg_min(m.email, coalesce(m.year, -1)) FILTER (WHERE m.email IS NOT NULL) AS email,
       coalesce(string_agg(DISTINCT j.management_email, '; ' ORDER BY j.management_email), '') AS management_email
FROM miss m LEFT JOIN mgmt_joined j ON m.entity_id = j.entity_id
WHERE m.entity_id IS NOT NULL AND m.entity_name IS NOT NULL
GROUP BY m.entity_id, m.entity_name"""

_MISS_SUB = f"""{CTE_REG}, {CTE_MGMT},
miss AS (SELECT r.entity_id, r.entity_name, r.email FROM reg r
         WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = r.entity_id
                           AND year(o.o_orderdate) = 1998))"""

ORACLE["missing_submission"] = f"""WITH {_MISS_SUB}
SELECT m.entity_id, m.entity_name, m.email, j.management_email
FROM miss m LEFT JOIN mgmt_joined j ON m.entity_id = j.entity_id"""

ORACLE["missing_semi"] = f"""WITH {_MISS_SUB}
SELECT g.entity_id, g.event_type, g.management_email FROM mgmt g
WHERE g.management_email IS NOT NULL AND g.entity_id IN (SELECT entity_id FROM miss)"""

ORACLE["joined_strings"] = f"WITH {CTE_MGMT} SELECT * FROM mgmt_joined"


# ======================================================= step 8: rules
_EMAIL_NC = EMAIL.replace("c.", "")
CTE_SHEETS = f"""cs AS (SELECT c_custkey AS submission_id, c_custkey AS row_id, c_name AS name, {_EMAIL_NC} AS email,
              concat('+36 ', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE '' END) AS phone,
              CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance, c_mktsegment AS segment,
              concat(' ', lower(c_mktsegment)) AS segment_ci FROM customer),
os AS (SELECT o_orderkey AS submission_id, o_orderkey AS row_id,
              concat(CAST(year(o_orderdate) AS VARCHAR), '-', lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0'), '-',
                     lpad(CAST(day(o_orderdate) + 10 * (o_orderkey % 3) AS VARCHAR), 2, '0')) AS order_date,
              CAST(year(o_orderdate) - 20 + o_custkey % 50 AS VARCHAR) AS report_year,
              CAST(year(o_orderdate) + 25 + o_custkey % 5 AS VARCHAR) AS planned_year,
              CASE o_orderstatus WHEN 'F' THEN 'igen' WHEN 'O' THEN 'NEM' ELSE 'talan' END AS flag,
              o_orderpriority AS priority FROM orders),
ls AS (SELECT l_orderkey AS submission_id, CAST(l_linenumber AS BIGINT) AS row_id,
              CAST(CAST(l_discount * 100 AS DECIMAL(18,2)) AS VARCHAR) AS discount_pct,
              CAST(CAST(l_tax * 1500 AS DECIMAL(18,2)) AS VARCHAR) AS tax_pct,
              CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS discount,
              CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS tax,
              CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity FROM lineitem),
ps AS (SELECT p_partkey AS submission_id, p_partkey AS row_id, CAST(p_size AS VARCHAR) AS size FROM part),
ds AS (SELECT doc_id AS submission_id, doc_id AS row_id, text FROM documents)"""

WS_RE2 = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def _d(x):
    return f"TRY_CAST({x} AS DOUBLE)"


RULE_PRED = {
    "max_length_255": lambda x: f"length({x}) > 255",
    "max_length_500": lambda x: f"length({x}) > 500",
    "not_date": lambda x: f"try_strptime({x}, '%Y-%m-%d') IS NULL",
    "year_range": lambda x: (f"{_d(x)} IS NULL OR {_d(x)} <> floor({_d(x)}) OR {_d(x)} < 1980 "
                             f"OR {_d(x)} > 2024"),
    "year_not_before": lambda x: f"{_d(x)} IS NULL OR {_d(x)} <> floor({_d(x)}) OR {_d(x)} < 2024",
    "email": lambda x: f"NOT regexp_full_match({x}, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$')",
    "phone": lambda x: f"NOT regexp_full_match({x}, '^\\+?[\\d\\s\\-\\(\\)/]+$')",
    "percent": lambda x: f"{_d(x)} IS NULL OR {_d(x)} < 0 OR {_d(x)} > 100",
    "nonneg_real": lambda x: f"{_d(x)} IS NULL OR {_d(x)} < 0",
    "nonneg_int": lambda x: f"{_d(x)} IS NULL OR {_d(x)} < 0 OR {_d(x)} <> floor({_d(x)})",
    "yes_no": lambda x: f"lower({x}) NOT IN ('igen', 'nem')",
    "one_of": lambda x: f"{x} NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')",
    "one_of_ci": lambda x: (f"lower(regexp_replace({x}, '\\A{WS_RE2}+|{WS_RE2}+\\z', '', 'g')) "
                            f"NOT IN ('automobile', 'building', 'furniture', 'machinery')"),
}

MULTI_PRED = {
    "sum_equals": (["discount", "tax"], f"abs({_d('discount')} + {_d('tax')} - 0.1) > 1e-6"),
    "sum_at_most": (["discount_pct", "tax_pct"], f"{_d('discount_pct')} + {_d('tax_pct')} > 100.0 + 1e-6"),
    "at_most": (["discount", "tax"], f"{_d('discount')} > {_d('tax')}"),
}


def vsql(cte, sheet, field, rule):
    if rule in MULTI_PRED:
        cols, pred = MULTI_PRED[rule]
        return (f"SELECT '{sheet}' AS sheet, submission_id, row_id, '{'+'.join(cols)}' AS field, "
                f"'{rule}' AS rule, concat_ws(';', {', '.join(cols)}) AS value FROM {cte} WHERE ({pred})")
    return (f"SELECT '{sheet}' AS sheet, submission_id, row_id, '{field}' AS field, '{rule}' AS rule, "
            f"CAST({field} AS VARCHAR) AS value FROM {cte} WHERE {field} IS NOT NULL AND ({RULE_PRED[rule](field)})")


def rules_sql(*items):
    return f"WITH {CTE_SHEETS}\n" + "\nUNION ALL ".join(vsql(*i) for i in items)


ORACLE["rule_text_length"] = rules_sql(("ds", "documents", "text", "max_length_255"),
                                       ("ds", "documents", "text", "max_length_500"))
ORACLE["rule_date"] = rules_sql(("os", "orders", "order_date", "not_date"))
ORACLE["rule_year_range"] = rules_sql(("os", "orders", "report_year", "year_range"))
ORACLE["rule_year_min"] = rules_sql(("os", "orders", "planned_year", "year_not_before"))
ORACLE["rule_email"] = rules_sql(("cs", "customers", "email", "email"))
ORACLE["rule_percent"] = rules_sql(("ls", "lines", "discount_pct", "percent"), ("ls", "lines", "tax_pct", "percent"))
ORACLE["rule_nonneg_real"] = rules_sql(("cs", "customers", "balance", "nonneg_real"))
ORACLE["rule_nonneg_int"] = rules_sql(("ps", "parts", "size", "nonneg_int"),
                                      ("cs", "customers", "balance", "nonneg_int"))
ORACLE["rule_yes_no"] = rules_sql(("os", "orders", "flag", "yes_no"))
ORACLE["rule_enum"] = rules_sql(("cs", "customers", "segment", "one_of"))
ORACLE["rule_enum_ci"] = rules_sql(("cs", "customers", "segment_ci", "one_of_ci"))
ORACLE["rule_phone"] = rules_sql(("cs", "customers", "phone", "phone"))
ORACLE["rule_sum_equals"] = rules_sql(("ls", "lines", None, "sum_equals"))
ORACLE["rule_sum_at_most"] = rules_sql(("ls", "lines", None, "sum_at_most"))
ORACLE["rule_le"] = rules_sql(("ls", "lines", None, "at_most"))
ORACLE["violations_all"] = rules_sql(
    ("cs", "customers", "email", "email"), ("cs", "customers", "phone", "phone"),
    ("cs", "customers", "balance", "nonneg_real"), ("cs", "customers", "balance", "nonneg_int"),
    ("cs", "customers", "segment", "one_of"), ("cs", "customers", "segment_ci", "one_of_ci"),
    ("cs", "customers", "name", "max_length_255"),
    ("os", "orders", "order_date", "not_date"), ("os", "orders", "report_year", "year_range"),
    ("os", "orders", "planned_year", "year_not_before"), ("os", "orders", "flag", "yes_no"),
    ("ls", "lines", "discount_pct", "percent"), ("ls", "lines", "tax_pct", "percent"),
    ("ls", "lines", None, "sum_equals"), ("ls", "lines", None, "sum_at_most"), ("ls", "lines", None, "at_most"))

_DATES = f"""od AS (SELECT o_orderkey AS submission_id, o_orderkey AS row_id,
              {S.DATE_TEXT_SQL.replace('{s}', 'VARCHAR')} AS started FROM orders),
dt AS (SELECT submission_id, row_id, started,
  CASE WHEN regexp_full_match(trim(started), '\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime(trim(started), '%Y-%m-%d')
       WHEN contains(started, 'T') THEN try_strptime(started, '%Y-%m-%dT%H:%M:%SZ')
       WHEN contains(started, '. ') THEN try_strptime(started, '%Y. %m. %d.')
       WHEN regexp_full_match(trim(started), '\\d{{4}}/\\d\\d/\\d\\d') THEN try_strptime(trim(started), '%Y/%m/%d')
       WHEN contains(started, '/') THEN try_strptime(started, '%m/%d/%Y') END AS value,
  CASE WHEN regexp_full_match(trim(started), '\\d{{4}}-\\d\\d-\\d\\d') THEN 'iso' WHEN contains(started, 'T') THEN 'iso_time'
       WHEN contains(started, '. ') THEN 'dots' WHEN regexp_full_match(trim(started), '\\d{{4}}/\\d\\d/\\d\\d') THEN 'slashes'
       WHEN contains(started, '/') THEN 'month_first' END AS format,
  TRY_CAST(started AS INTEGER) AS number FROM od),
dates AS (SELECT submission_id, row_id, started, value, CASE WHEN value IS NOT NULL THEN format END AS format,
                 CAST(coalesce(number, year(value)) AS INTEGER) AS year FROM dt)"""
ORACLE["parse_dates"] = f"WITH {_DATES} SELECT submission_id, started, value, format, year FROM dates"
ORACLE["rule_dates"] = f"""WITH {_DATES}
SELECT 'orders' AS sheet, submission_id, row_id, 'started' AS field, 'not_date' AS rule, started AS value FROM dates
WHERE started IS NOT NULL AND value IS NULL
UNION ALL
SELECT 'orders', submission_id, row_id, 'started', 'year_range', started FROM dates
WHERE started IS NOT NULL AND (year IS NULL OR year < 1996 OR year > 2000)"""


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


_PLACES = f"""pl AS (SELECT c_custkey AS submission_id, c_custkey AS row_id, {S.COUNTY_SQL} AS county, {S.REGION_SQL} AS region,
  {S.KIND_SQL} AS provider_kind, {S.CONDITION_SQL} AS condition FROM customer)"""
ORACLE["rule_fixed_lists"] = f"WITH {_PLACES}" + "\nUNION ALL ".join(
    f"\nSELECT 'places' AS sheet, submission_id, row_id, '{c}' AS field, '{c}' AS rule, {c} AS value FROM pl "
    f"WHERE {x} NOT IN ({_in(v)})" for c, x, v in (
        ("county", "county", Q.COUNTIES), ("region", "region", Q.REGIONS),
        ("provider_kind", "lower(trim(provider_kind))", [v.lower() for v in Q.PROVIDER_KINDS]),
        ("condition", "lower(trim(condition))", [v.lower() for v in Q.CONDITIONS])))


def _dec2(x):
    return f"CAST({x} AS DECIMAL(18,2))"


ORACLE["rule_sum_columns"] = f"""WITH ar AS (SELECT l_orderkey AS submission_id, CAST(l_linenumber AS BIGINT) AS row_id,
  {_dec2('l_quantity')} AS built, {_dec2('l_discount * 100')} AS free, {_dec2('l_quantity + l_tax * 100')} AS usable,
  {_dec2('l_extendedprice')} AS own, {_dec2('l_tax')} AS state,
  {_dec2('l_extendedprice + l_tax + CASE WHEN l_linenumber >= 6 THEN 0.01::DOUBLE ELSE 0 END')} AS total FROM lineitem)
SELECT 'areas' AS sheet, submission_id, row_id, 'built+free+usable' AS field, 'built_free' AS rule,
       concat_ws(';', CAST(built AS VARCHAR), CAST(free AS VARCHAR), CAST(usable AS VARCHAR)) AS value FROM ar WHERE built + free > usable
UNION ALL
SELECT 'areas', submission_id, row_id, 'own+state+total', 'sources',
       concat_ws(';', CAST(own AS VARCHAR), CAST(state AS VARCHAR), CAST(total AS VARCHAR)) FROM ar WHERE own + state <> total"""

ORACLE["gate_clean_rows"] = f"""WITH {CTE_SHEETS},
bad AS (SELECT submission_id FROM ls WHERE (tax_pct IS NOT NULL AND ({RULE_PRED['percent']('tax_pct')}))
        OR ({MULTI_PRED['sum_at_most'][1]}))
SELECT l_orderkey AS submission_id, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.submission_id = l.l_orderkey)"""

ORACLE["audit_pk"] = """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

_FK = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
       ("customer", "c_custkey", "orders", "o_custkey"), ("documents", "doc_id", "labels", "doc_id")]
ORACLE["audit_fk"] = "\nUNION ALL ".join(
    f"SELECT '{c}.{ck}' AS fk, CAST(x.{ck} AS BIGINT) AS key, count(*) AS n_rows FROM {c} x "
    f"WHERE x.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{ck}) GROUP BY x.{ck}"
    for c, ck, p, pk in _FK)

_NN = ["year", "total_price", "priority", "quantity", "tax", "status_priority"]
ORACLE["audit_not_null"] = f"""WITH {CTE_PANEL},
c AS (SELECT {', '.join(f'count(*) FILTER (WHERE {x} IS NULL) AS {x}' for x in _NN)} FROM panel)
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{x}' AS field, {x} AS n_null FROM c" for x in _NN)})
WHERE n_null > 0"""

ORACLE["drop_missing_subset"] = f"""WITH {CTE_PANEL}
SELECT entity_id, year, tax, priority FROM panel
WHERE (CASE WHEN tax IS NULL OR priority IS NULL THEN 0 ELSE 1 END) = 1"""


# ======================================================= step 9-10: names
def clean_sql(x):
    return ("array_to_string(list_sort(list_filter(string_split(trim(lower(regexp_replace("
            f"{x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' '), lambda t: t <> '')), ' ')")


def _mask(ch):
    return ("CAST(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, i + 1, 1) = "
            f"{ch} THEN (1::BIGINT << i) ELSE 0::BIGINT END)) AS BIGINT)")


LCS_SQL = ("bit_count(((1::BIGINT << length(a)) - 1) & ~list_reduce(list_prepend((1::BIGINT << length(a)) - 1, "
           f"list_transform(string_split(b, ''), lambda ch: {_mask('ch')})), "
           "lambda v, m: ((v + (v & m)) | (v & ~m)) & ((1::BIGINT << length(a)) - 1)))")

CTE_NAMES = f"""reg AS (SELECT min(p_partkey) AS entity_id, p_name AS entity_name FROM part GROUP BY p_name),
q AS (SELECT p_partkey AS query_id, {B.PERTURB_SQL} AS name FROM part),
qc AS (SELECT query_id, name AS query_name, {clean_sql('name')} AS qs FROM q),
rc AS (SELECT entity_id AS candidate_id, entity_name AS candidate_name, {clean_sql('entity_name')} AS rs FROM reg),
uq AS (SELECT DISTINCT qs FROM qc WHERE length(qs) > 0),
ur AS (SELECT DISTINCT rs FROM rc WHERE length(rs) > 0),
pairs AS (SELECT qs, rs, CASE WHEN length(qs) <= length(rs) THEN qs ELSE rs END AS a,
                 CASE WHEN length(qs) <= length(rs) THEN rs ELSE qs END AS b FROM uq, ur),
lcs AS (SELECT qs, rs, CAST(length(qs) + length(rs) AS DOUBLE) AS lsum, CAST({LCS_SQL} AS DOUBLE) AS l FROM pairs),
sc AS (SELECT qs, rs, CAST(round_even((1.0::DOUBLE - (lsum - 2.0::DOUBLE * l) / lsum) * 100.0::DOUBLE, 0) AS INTEGER)
              AS score FROM lcs),
first_id AS (SELECT rs, min(candidate_id) AS candidate_id FROM rc GROUP BY rs)"""


def _best(t):
    return f"""best AS (SELECT sc.qs, f.candidate_id, sc.score FROM sc JOIN first_id f ON sc.rs = f.rs
          WHERE sc.score >= {t}
          QUALIFY row_number() OVER (PARTITION BY sc.qs ORDER BY sc.score DESC, f.candidate_id) = 1)"""


ORACLE["fuzzy_best"] = f"""WITH {CTE_NAMES}, {_best(85)}
SELECT qc.query_id, qc.query_name, b.candidate_id AS matched_id, b.score FROM qc LEFT JOIN best b ON qc.qs = b.qs"""

ORACLE["fuzzy_active"] = ORACLE["fuzzy_best"].replace(CTE_NAMES, CTE_NAMES.replace(
    "FROM part GROUP BY p_name", "FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY p_name"))
ORACLE["fuzzy_topk_review"] = f"""WITH {CTE_NAMES},
rk_ids AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY rs ORDER BY candidate_id) <= 3),
top AS (SELECT sc.qs, r.candidate_id, r.candidate_name, sc.score,
               CAST(row_number() OVER (PARTITION BY sc.qs ORDER BY sc.score DESC, r.candidate_id) AS INTEGER) AS rank
        FROM sc JOIN rk_ids r ON sc.rs = r.rs WHERE sc.score >= 70 QUALIFY rank <= 3),
top2 AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY qs) = 100 THEN 'exact' ELSE 'review' END AS decision FROM top
         QUALIFY rank = 1 OR max(score) OVER (PARTITION BY qs) < 100)
SELECT qc.query_id, qc.query_name, t.candidate_id, t.candidate_name, t.score, t.rank,
       coalesce(t.decision, 'new') AS decision
FROM qc LEFT JOIN top2 t ON qc.qs = t.qs"""

ORACLE["review_decisions"] = f"""WITH review AS ({ORACLE['fuzzy_topk_review']})
SELECT query_id, any_value(query_name) AS query_name,
       max(CASE WHEN decision = 'exact' OR (decision = 'review' AND query_id % 3 = 0 AND rank = 1)
                THEN candidate_id END) AS candidate_id,
       CASE WHEN max(decision) = 'new' OR (max(decision) = 'review' AND query_id % 3 = 1) THEN 'new'
            WHEN max(decision) = 'exact' OR query_id % 3 = 0 THEN 'matched' ELSE 'open' END AS state
FROM review GROUP BY query_id"""

# New names one after the other, in order: each joins the best leader so far or
# becomes one.
ORACLE["resolve_or_register"] = f"""WITH RECURSIVE {CTE_NAMES}, {_best(90)},
res AS (SELECT qc.query_id, qc.query_name, qc.qs, b.candidate_id AS matched_id FROM qc LEFT JOIN best b ON qc.qs = b.qs),
newn AS (SELECT qs, row_number() OVER (ORDER BY qs) AS i
         FROM (SELECT DISTINCT qs FROM res WHERE matched_id IS NULL AND length(qs) > 0)),
npairs AS (SELECT x.qs, y.qs AS rs, CASE WHEN length(x.qs) <= length(y.qs) THEN x.qs ELSE y.qs END AS a,
                  CASE WHEN length(x.qs) <= length(y.qs) THEN y.qs ELSE x.qs END AS b FROM newn x, newn y WHERE y.qs < x.qs),
nlcs AS (SELECT qs, rs, CAST(length(qs) + length(rs) AS DOUBLE) AS lsum, CAST({LCS_SQL} AS DOUBLE) AS l FROM npairs),
nsc AS (SELECT qs, rs, CAST(round_even((1.0::DOUBLE - (lsum - 2.0::DOUBLE * l) / lsum) * 100.0::DOUBLE, 0) AS INTEGER)
               AS score FROM nlcs),
near AS (SELECT qs, list(rs) AS before FROM nsc WHERE score >= 90 GROUP BY qs),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS leaders
         UNION ALL
         SELECT w.i + 1, CASE WHEN n.before IS NOT NULL AND list_has_any(n.before, w.leaders) THEN w.leaders
                              ELSE list_append(w.leaders, m.qs) END
         FROM walk w JOIN newn m ON m.i = w.i + 1 LEFT JOIN near n ON n.qs = m.qs),
lead AS (SELECT unnest(leaders) AS leader FROM walk WHERE i = (SELECT max(i) FROM walk)),
ids AS (SELECT leader, (SELECT coalesce(max(entity_id), 0) FROM reg) + row_number() OVER (ORDER BY leader) AS new_id
        FROM lead),
follow AS (SELECT leader AS qs, leader FROM lead
           UNION ALL
           SELECT s.qs, arg_min(s.rs, (-s.score, s.rs)) AS leader FROM nsc s
           WHERE s.score >= 90 AND s.rs IN (SELECT leader FROM lead) AND s.qs NOT IN (SELECT leader FROM lead)
           GROUP BY s.qs)
SELECT r.query_id, r.query_name, coalesce(r.matched_id, n.new_id) AS resolved_id, r.matched_id IS NULL AS is_new
FROM res r LEFT JOIN follow f ON r.qs = f.qs LEFT JOIN ids n ON f.leader = n.leader"""

CTE_DICT = """early AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-04-01'),
known AS (SELECT p_type, p_brand, p_size,
                 row_number() OVER (ORDER BY p_type, p_brand, p_size) AS dict_id
          FROM (SELECT DISTINCT p_type, p_brand, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM early)))"""

ORACLE["new_dictionary_rows"] = f"""WITH {CTE_DICT},
fresh AS (SELECT DISTINCT p_type, p_brand, p_size FROM part p
          WHERE p_type IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM known k WHERE k.p_type = p.p_type AND k.p_brand = p.p_brand
                            AND k.p_size = p.p_size))
SELECT p_type, p_brand, p_size,
       (SELECT coalesce(max(dict_id), 0) FROM known) + row_number() OVER (ORDER BY p_type, p_brand, p_size) AS dict_id
FROM fresh"""

ORACLE["audit_dictionary"] = f"""WITH {CTE_DICT}
SELECT p_type, p_brand, p_size, count(*) AS n_rows FROM (
  SELECT p_type, p_brand, p_size FROM known
  UNION ALL SELECT DISTINCT p_type, p_brand, p_size FROM part WHERE p_size > 25)
GROUP BY p_type, p_brand, p_size HAVING count(*) > 1"""

ORACLE["dictionary_lookup"] = f"""WITH {CTE_DICT}
SELECT p.p_partkey, k.dict_id FROM part p JOIN known k
  ON p.p_type = k.p_type AND p.p_brand = k.p_brand AND p.p_size = k.p_size"""


# ======================================================= step 9: reshape
ORACLE["rename_split"] = "SELECT o_orderkey AS submission_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders"

ORACLE["recode_yes_no"] = f"""WITH {CTE_SHEETS}
SELECT submission_id, flag,
       CASE WHEN lower(regexp_replace(flag, '\\A{WS_RE2}+|{WS_RE2}+\\z', '', 'g')) = 'igen' THEN '1'
            WHEN lower(regexp_replace(flag, '\\A{WS_RE2}+|{WS_RE2}+\\z', '', 'g')) = 'nem' THEN '0' ELSE flag END AS flag_code
FROM os"""

ORACLE["recode_map"] = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
       WHEN '3-MEDIUM' THEN 'medium' END AS priority_code FROM orders"""

ORACLE["explode_list"] = f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos,
       regexp_replace(raw, '\\A{WS_RE2}+|{WS_RE2}+\\z', '', 'g') AS item
FROM (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS raw
      FROM (SELECT doc_id, string_split(text, ',') AS parts FROM documents WHERE text IS NOT NULL))"""

ORACLE["defaults"] = f"""WITH {CTE_SHEETS}
SELECT submission_id, flag, 2023 AS year, TIMESTAMP '2024-06-30 00:00:00' AS datum, 1 AS active FROM os"""


# ======================================================= step 11
ORACLE["ingest_append_roundtrip"] = f"""WITH {CTE_SHEETS},
bad AS (SELECT DISTINCT submission_id FROM ls WHERE tax_pct IS NOT NULL AND ({RULE_PRED['percent']('tax_pct')}))
SELECT submission_id, row_id, TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(discount AS DOUBLE) AS discount
FROM ls l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.submission_id = l.submission_id)"""


ORACLE["ingest_line_rates"] = f"""WITH {CTE_SHEETS},
bad AS (SELECT DISTINCT submission_id FROM ls WHERE tax_pct IS NOT NULL AND ({RULE_PRED['percent']('tax_pct')}))
SELECT submission_id, row_id, TRY_CAST(tax AS DOUBLE) AS tax
FROM ls l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.submission_id = l.submission_id)"""
ORACLE["rename_split_header"] = "SELECT o_orderkey AS submission_id, o_custkey AS entity_id, o_orderdate AS datum FROM orders"
ORACLE["rename_split_money"] = "SELECT o_orderkey AS submission_id, o_totalprice AS total_price FROM orders"

CTE_FORMS = f"""forms AS (SELECT p_partkey AS submission_id, p_partkey AS row_id, {B.PERTURB_SQL} AS name,
       concat(CASE WHEN p_partkey % 12 < 10 THEN 'nation ' ELSE 'land ' END, CAST(p_partkey % 12 AS VARCHAR)) AS holder, p_type, p_brand, p_size,
       concat(p_type, ' , ', replace(p_name, ' ', ' ,'), ',') AS tags,
       CASE WHEN p_partkey % 97 = 0 THEN 'talan' WHEN p_partkey % 2 = 0 THEN 'Igen' ELSE 'nem' END AS flag FROM part),
shares AS (SELECT l_partkey AS submission_id, l_orderkey * 10 + l_linenumber AS row_id,
       CAST(CAST(l_quantity * CASE WHEN l_linenumber >= 7 THEN 2.02 ELSE 2 END AS DECIMAL(18,2)) AS VARCHAR) AS share
       FROM lineitem),
viol AS (SELECT 'parts' AS sheet, submission_id, row_id, 'p_size' AS field, 'nonneg_int' AS rule,
                CAST(p_size AS VARCHAR) AS value FROM forms WHERE p_size < 0
         UNION ALL
         SELECT 'parts', submission_id, row_id, 'flag', 'yes_no', flag FROM forms
         WHERE lower(trim(flag)) NOT IN ('igen', 'nem')
         UNION ALL
         SELECT 'shares', submission_id, row_id, 'share', 'percent', share FROM shares
         WHERE CAST(share AS DOUBLE) < 0 OR CAST(share AS DOUBLE) > 100),
clean AS (SELECT * FROM forms WHERE submission_id NOT IN (SELECT submission_id FROM viol)),
cdict AS (SELECT * FROM known UNION ALL
  SELECT p_type, p_brand, p_size, (SELECT coalesce(max(dict_id), 0) FROM known) + row_number() OVER (ORDER BY p_type, p_brand, p_size)
  FROM (SELECT DISTINCT p_type, p_brand, p_size FROM clean
        WHERE p_type IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL
        EXCEPT SELECT p_type, p_brand, p_size FROM known))"""


def _resolved(prefix, names_sql, registry_sql, threshold=90):
    """CTEs that resolve names one after the other against a registry:
    <prefix>_id (name, id) and <prefix>_new (entity_id, entity_name)."""
    p = prefix
    score = f"""CAST(round_even((1.0::DOUBLE - (length(a) + length(b) - 2.0::DOUBLE * CAST({LCS_SQL} AS DOUBLE))
                / (length(a) + length(b))) * 100.0::DOUBLE, 0) AS INTEGER)"""

    def pairs(left, right, more=""):
        return (f"SELECT x, y, {score} AS score FROM (SELECT l.q AS x, r.q AS y, "
                "CASE WHEN length(l.q) <= length(r.q) THEN l.q ELSE r.q END AS a, "
                "CASE WHEN length(l.q) <= length(r.q) THEN r.q ELSE l.q END AS b "
                f"FROM {left} l, {right} r {more})")
    return f"""{p}_reg AS ({registry_sql}),
{p}_names AS (SELECT name, {clean_sql('name')} AS q FROM (SELECT DISTINCT name FROM ({names_sql}) WHERE name IS NOT NULL)),
{p}_r AS (SELECT {clean_sql('entity_name')} AS q, min(entity_id) AS entity_id FROM {p}_reg GROUP BY 1),
{p}_u AS (SELECT DISTINCT q FROM {p}_names WHERE length(q) > 0),
{p}_hit AS (SELECT x AS q, arg_min(r.entity_id, (-score, r.entity_id)) AS entity_id
            FROM ({pairs(f'{p}_u', f'{p}_r')}) s JOIN {p}_r r ON s.y = r.q WHERE score >= {threshold} GROUP BY x),
{p}_rest AS (SELECT q, row_number() OVER (ORDER BY q) AS i FROM {p}_u WHERE q NOT IN (SELECT q FROM {p}_hit)),
{p}_near AS MATERIALIZED (SELECT * FROM ({pairs(f'{p}_rest', f'{p}_rest', 'WHERE r.q < l.q')}) WHERE score >= {threshold}),
{p}_walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS leaders
  UNION ALL
  SELECT w.i + 1, CASE WHEN n.before IS NOT NULL AND list_has_any(n.before, w.leaders) THEN w.leaders
                       ELSE list_append(w.leaders, m.q) END
  FROM {p}_walk w JOIN {p}_rest m ON m.i = w.i + 1
  LEFT JOIN (SELECT x, list(y) AS before FROM {p}_near GROUP BY x) n ON n.x = m.q),
{p}_lead AS (SELECT leader, (SELECT coalesce(max(entity_id), 0) FROM {p}_reg) + row_number() OVER (ORDER BY leader) AS entity_id
  FROM (SELECT unnest(leaders) AS leader FROM {p}_walk WHERE i = (SELECT max(i) FROM {p}_walk))),
{p}_of AS (SELECT q, entity_id FROM {p}_hit
  UNION ALL SELECT leader, entity_id FROM {p}_lead
  UNION ALL SELECT n.x, arg_min(l.entity_id, (-n.score, n.y)) FROM {p}_near n JOIN {p}_lead l ON n.y = l.leader
  WHERE n.x NOT IN (SELECT leader FROM {p}_lead) GROUP BY n.x),
{p}_id AS (SELECT n.name, o.entity_id FROM {p}_names n LEFT JOIN {p}_of o ON n.q = o.q),
{p}_new AS (SELECT l.entity_id, min(n.name) AS entity_name FROM {p}_lead l JOIN {p}_names n ON n.q = l.leader GROUP BY l.entity_id)"""


ORACLE["ingest_required_details"] = f"""WITH {CTE_DICT},
ids AS (SELECT * FROM known UNION ALL SELECT p_type, p_brand, p_size, (SELECT coalesce(max(dict_id), 0) FROM known)
  + row_number() OVER (ORDER BY p_type, p_brand, p_size) FROM (
    SELECT DISTINCT p_type, p_brand, p_size FROM part EXCEPT SELECT p_type, p_brand, p_size FROM known)),
numbered AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS ingest_seq FROM part)
SELECT p_partkey AS submission_id, p_partkey AS row_id, ingest_seq, i.dict_id, n.p_size AS area, n.p_brand AS state
FROM numbered n JOIN ids i ON n.p_type = i.p_type AND n.p_brand = i.p_brand AND n.p_size = i.p_size
WHERE n.p_size > 20 AND n.p_brand <> 'Brand#11'"""
ORACLE["staged_by_header"] = """SELECT CAST(o_orderkey AS VARCHAR) AS key,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END AS priority
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"""
ORACLE["staged_header_violations"] = """SELECT DISTINCT 'orders' AS sheet, v.field, v.rule FROM orders,
  (VALUES ('priority', 'missing_header'), ('note', 'unknown_header')) v(field, rule) WHERE o_orderstatus = 'P'"""

CTE_DROPS = """seq AS (
  SELECT o_orderkey AS submission_id, o_custkey AS entity_id, o_orderdate AS datum, o_totalprice AS total_price,
         row_number() OVER (ORDER BY o_orderstatus = 'O', o_orderkey) AS ingest_seq FROM orders)"""
ORACLE["ingest_sequence"] = f"WITH {CTE_DROPS} SELECT submission_id, ingest_seq, entity_id, total_price FROM seq"
ORACLE["ingest_latest"] = f"""WITH {CTE_DROPS}
SELECT entity_id, datum, ingest_seq, submission_id, total_price FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY datum DESC, ingest_seq DESC) AS rn FROM seq) WHERE rn = 1"""
ORACLE["ingest_drops_dictionary"] = f"""WITH {CTE_DICT},
fresh AS (SELECT DISTINCT p_type, p_brand, p_size, p_size > 25 AS late FROM part
          EXCEPT SELECT p_type, p_brand, p_size, p_size > 25 FROM known),
all_ids AS (SELECT * FROM known UNION ALL
  SELECT p_type, p_brand, p_size, (SELECT coalesce(max(dict_id), 0) FROM known)
         + row_number() OVER (ORDER BY late, p_type, p_brand, p_size) FROM fresh)
SELECT p_partkey AS submission_id, dict_id, CAST(1 AS BIGINT) AS n_ids,
       CAST(CASE WHEN p.p_size > 10 THEN 2 ELSE 1 END AS BIGINT) AS n_rows
FROM part p JOIN all_ids a ON p.p_type = a.p_type AND p.p_brand = a.p_brand AND p.p_size = a.p_size"""

CTE_INGEST = f"""WITH RECURSIVE {CTE_DICT}, {CTE_FORMS},
{_resolved('pn', 'SELECT name FROM clean', f"""SELECT min(p_partkey) AS entity_id, p_name AS entity_name FROM part WHERE p_partkey IN
    (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '{B.FIRST_DAYS}') GROUP BY p_name""")},
{_resolved('hn', 'SELECT holder AS name FROM clean', 'SELECT CAST(n_nationkey AS BIGINT) AS entity_id, n_name AS entity_name FROM nation')}"""
ORACLE["ingest_part"] = CTE_INGEST + """
SELECT c.submission_id, c.row_id, p.entity_id, h.entity_id AS holder_id, 2023 AS year,
       CASE WHEN lower(trim(c.flag)) = 'igen' THEN 1 ELSE 0 END AS flag, d.dict_id
FROM clean c LEFT JOIN pn_id p ON c.name = p.name LEFT JOIN hn_id h ON c.holder = h.name
LEFT JOIN cdict d ON c.p_type = d.p_type AND c.p_brand = d.p_brand AND c.p_size = d.p_size"""
ORACLE["ingest_part_tag"] = CTE_INGEST + """
SELECT submission_id, row_id, entity_id, holder_id, CAST(pos AS INTEGER) AS pos, trim(raw) AS item
FROM (SELECT c.submission_id, c.row_id, p.entity_id, h.entity_id AS holder_id,
             unnest(range(len(string_split(tags, ',')))) AS pos, unnest(string_split(tags, ',')) AS raw
      FROM clean c LEFT JOIN pn_id p ON c.name = p.name LEFT JOIN hn_id h ON c.holder = h.name)
WHERE trim(raw) <> ''"""
ORACLE["ingest_part_share"] = f"""WITH {CTE_DICT}, {CTE_FORMS}
SELECT submission_id, row_id, CAST(share AS DOUBLE) AS share FROM shares
WHERE submission_id NOT IN (SELECT submission_id FROM viol)"""
ORACLE["ingest_registry_new"] = CTE_INGEST + "\nSELECT entity_id, entity_name FROM pn_new"
ORACLE["ingest_holder_new"] = CTE_INGEST + "\nSELECT entity_id, entity_name FROM hn_new"
ORACLE["ingest_dictionary_new"] = f"""WITH {CTE_DICT}, {CTE_FORMS}
SELECT p_type, p_brand, p_size, dict_id FROM cdict WHERE dict_id > (SELECT coalesce(max(dict_id), 0) FROM known)"""
ORACLE["ingest_violations"] = f"WITH {CTE_DICT}, {CTE_FORMS} SELECT * FROM viol"


def _cells(report, section, key, row, numbers=(), texts=()):
    """Every cell of a section, as rows."""
    return "\nUNION ALL ".join(
        f"SELECT '{report}' AS report, '{section}' AS section, CAST({row} AS VARCHAR) AS row_key, '{c}' AS column_name, "
        + (f"CAST({c} AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text" if c in numbers else
           f"CAST(NULL AS DOUBLE) AS number, CAST({c} AS VARCHAR) AS text") + f" FROM ({ORACLE[key]})"
        for c in [*numbers, *texts])


_YS = C.TOTALS_CFG["years"]
_GROWTH_COLUMNS = [f"{m}_{y}{w}" for m in C.GROWTH_CFG["metrics"] for y in C.GROWTH_CFG["years"]
                   for w in ("", "_per_entity")]
_GROWTH_COLUMNS += [f"{m}_change{w}_per_entity" for m in C.GROWTH_CFG["metrics"] for w in ("", "_pct")]
_WHO = ["entity_name", "email", "management_email"]
ORACLE["run_batch"] = "\nUNION ALL ".join([
    _cells("totals", "main", "report_totals", "metric",
           [f"y{y}{w}" for y in _YS for w in ("", "_avg")] + ["growth", "growth_pct"]),
    _cells("growth", "main", "report_regional_growth", "region", _GROWTH_COLUMNS),
    _cells("emails", "email_list", "contact_list", "email", [], ["email"]),
    _cells("emails", "details", "contact_details", "entity_id", [], _WHO),
    _cells("missing", "missing", "missing_panel", "entity_id", [], _WHO),
    "SELECT 'broken' AS report, 'failed' AS section, 'broken' AS row_key, 'error' AS column_name, "
    "CAST(NULL AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text"])
ORACLE["safe_pct"] = ORACLE["safe_pct_query"]
ORACLE["round_by_kind"] = ORACLE["round_by_kind_query"]
