"""Reports (R1-R14) as functions of (panel, cfg) -> DataFrame | dict.

A report config is a plain dict: ``type``, ``group_col``, ``metric`` or
``metrics``, ``years``, ``filter_col``/``filter_values``, ``agg`` (a
metric -> kind dict), ``entity``, ``year``. Every report aggregates once in
long form ``(group, year, metric, kind, value)``, derives per-entity values
and changes there or as column arithmetic, and pivots once with explicit
years. Labels are ASCII parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import plain_sum, round_by_kind, round_even, safe_ratio
from ..operators.aggregate import (choose_metrics, distinct_list, first_of_entity, group_agg, settle, to_long)
from ..operators.change import add_first_last, add_present_change, add_yoy
from ..operators.pivot import pivot_labels

ENTITY = "entity_id"
YEAR = "year"


# ---------------------------------------------------------------- filters
def apply_filters(df: DataFrame, years: Sequence[int] | None = None,
                  filter_col: str | None = None, filter_values: Sequence | None = None) -> DataFrame:
    """Year list and membership of one column; empty lists = no filter.
    An unknown ``filter_col`` is an error (silently ignoring it hides typos)."""
    if years:
        df = df.filter(F.col(YEAR).isin([int(y) for y in years]))
    if filter_col and filter_values:
        if filter_col not in df.columns:
            raise ValueError(f"unknown filter column {filter_col!r}")
        df = df.filter(F.col(filter_col).isin(list(filter_values)))
    return df


def _asked(cfg: Mapping) -> list[int]:
    return sorted(int(y) for y in cfg.get("years") or ())


def _cells(cells: DataFrame, cfg: Mapping) -> tuple[DataFrame, list[int]]:
    """Cells and the years of the report (O5): the requested ones (a requested
    year without data gives an empty/0 column), else those that the cells have."""
    if asked := _asked(cfg):
        return cells, asked
    return settle(cells)


def _numeric_round(df: DataFrame, keep: Sequence[str], scale: int = 2) -> DataFrame:
    """half-even rounding of every numeric column except ``keep``."""
    num = {"double", "float", "decimal"}
    cols = []
    for f in df.schema.fields:
        if f.name not in keep and f.dataType.typeName().split("(")[0] in num:
            cols.append(round_even(F.col(f"`{f.name}`"), scale).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# ------------------------------------------------------------------ R1
def report_regional_growth(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """rows = group, columns ``<m>_<y>``, ``<m>_<y>_per_entity``,
    ``<m>_change_per_entity``, ``<m>_change_pct_per_entity``. The per-entity
    divisor is the distinct entities of the group over all filtered years."""
    g = cfg["group_col"]
    spec = choose_metrics(agg, cfg.get("metric"), cfg.get("metrics"))
    df = apply_filters(panel, cfg.get("years"), g, cfg.get("filter_values"))
    df = df.filter(F.col(YEAR).isNotNull() & F.col(g).isNotNull())
    cells, present = settle(growth_cells(df, g, spec))
    years = _asked(cfg) or present
    # A group's cells are its few years: they sum up to its distinct entities.
    cells = cells.withColumn("_n", F.sum("_first").over(Window.partitionBy(g)))
    long = to_long(cells, [g, YEAR, "_n"], spec)
    per = F.when(F.col("kind") == "sum", safe_ratio("value", "_n")).otherwise(F.col("value"))
    long = (long.select(g, F.explode(F.array(
                F.struct(F.concat_ws("_", "metric", F.col(YEAR).cast("string")).alias("label"),
                         F.col("value").alias("v")),
                F.struct(F.concat_ws("_", "metric", F.col(YEAR).cast("string"),
                                     F.lit("per_entity")).alias("label"),
                         per.alias("v")))).alias("c"))
            .select(g, "c.label", "c.v"))
    labels = [f"{m}_{y}" for m in sorted(spec) for y in years]
    labels += [f"{m}_{y}_per_entity" for m in spec for y in years]
    wide = pivot_labels(long, [g], "label", labels, "v", fill=0.0)
    if len(years) >= 2:
        for m in spec:
            wide = add_present_change(wide, [(y, f"{m}_{y}_per_entity") for y in years], present,
                                      f"{m}_change_per_entity", f"{m}_change_pct_per_entity")
    return _numeric_round(wide, [g])


def growth_cells(df: DataFrame, g: str, spec: Mapping[str, str]) -> DataFrame:
    """J12 in one pass: cells (group, year, metrics, _first), where _first sums up
    over a group's cells to its distinct entities."""
    return group_agg(first_of_entity(df, [g], ENTITY), [g, YEAR], spec, more=[F.sum("_first").alias("_first")])


# ------------------------------------------------------------------ R2
def report_totals(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """R2: metric rows x ``y<year>`` totals, ``y<year>_avg`` per-entity values
    (divisor: distinct entities of that year), ``growth``, ``growth_pct``."""
    spec = dict(agg)
    df = apply_filters(panel, cfg.get("years"), cfg.get("filter_col"), cfg.get("filter_values"))
    df = df.filter(F.col(YEAR).isNotNull())
    cells, present = settle(group_agg(df, [YEAR], spec, ENTITY))
    years = _asked(cfg) or present
    long = to_long(cells, [YEAR, "n_entities"], spec)
    avg = F.when(F.col("kind") == "sum", safe_ratio("value", "n_entities")).otherwise(F.col("value"))
    stacked = long.select("metric", F.explode(F.array(
        F.struct(F.concat(F.lit("y"), F.col(YEAR).cast("string")).alias("label"),
                 F.col("value").alias("v")),
        F.struct(F.concat(F.lit("y"), F.col(YEAR).cast("string"), F.lit("_avg")).alias("label"),
                 avg.alias("v")))).alias("c")).select("metric", "c.label", "c.v")
    labels = [f"y{y}" for y in years] + [f"y{y}_avg" for y in years]
    wide = pivot_labels(stacked, ["metric"], "label", labels, "v")
    if len(years) >= 2:
        wide = add_present_change(wide, [(y, f"y{y}_avg") for y in years], present, "growth", "growth_pct")
    return _numeric_round(wide, ["metric"])


# ------------------------------------------------------------------ R5
def report_single_metric(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """One metric by group x year, every year-on-year step (diff, pct)
    and first -> last year present (``total_diff``, ``total_pct``). Not rounded."""
    g, m = cfg["group_col"], cfg["metric"]
    spec = choose_metrics(agg, metric=m)
    df = apply_filters(panel, cfg.get("years"), g, cfg.get("filter_values"))
    df = df.filter(F.col(YEAR).isNotNull())
    cells, present = settle(group_agg(df, [g, YEAR], spec))
    years = _asked(cfg) or present
    cells = cells.select(g, F.concat(F.lit("y"), F.col(YEAR).cast("string")).alias("label"),
                         F.col(m).cast("double").alias("v"))
    wide = pivot_labels(cells, [g], "label", [f"y{y}" for y in years], "v", fill=0.0)
    if len(years) >= 2:
        by_year = [(y, f"y{y}") for y in years]
        wide = add_present_change(add_yoy(wide, by_year), by_year, present, "total_diff", "total_pct")
    return wide


# ------------------------------------------------------------------ R6
def report_multi_metric(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """Every configured metric by group, columns ``<m>_<y>`` (fill 0). Not rounded."""
    g, spec = cfg["group_col"], dict(agg)
    df = apply_filters(panel, cfg.get("years")).filter(F.col(YEAR).isNotNull())
    cells, years = _cells(group_agg(df, [g, YEAR], spec), cfg)
    long = to_long(cells, [g, YEAR], spec)
    long = long.select(g, F.concat_ws("_", "metric", F.col(YEAR).cast("string")).alias("label"), "value")
    labels = [f"{m}_{y}" for m in sorted(spec) for y in years]
    return pivot_labels(long, [g], "label", labels, "value", fill=0.0)


# ------------------------------------------------------------------ R7 / R8
def _entity_wide(long: DataFrame, keys: Sequence[str], years: Sequence[int],
                 fill: float | None) -> DataFrame:
    lab = long.withColumn("label", F.concat(F.lit("y"), F.col(YEAR).cast("string")))
    wide = pivot_labels(lab, [*keys, "metric", "kind"], "label", [f"y{y}" for y in years],
                        "value", fill=fill)
    if len(years) >= 2:
        wide = add_first_last(wide, f"y{years[0]}", f"y{years[-1]}", "diff", "pct")
    value_cols = [f"y{y}" for y in years] + (["diff", "pct"] if len(years) >= 2 else [])
    wide = wide.withColumns({c: round_by_kind(c, "kind") for c in value_cols})
    return wide.drop("kind")


def report_entity(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """One entity of ``group_col``; metrics as rows, years as columns,
    first -> last diff and pct; sum rows rounded to 0, mean rows to 2.
    With ``reindex`` and ``years`` every requested year is a column (A12)."""
    g, entity, spec = cfg["group_col"], cfg["entity"], dict(agg)
    df = apply_filters(panel.filter(F.col(g) == F.lit(entity)), cfg.get("years"))
    df = df.filter(F.col(YEAR).isNotNull())
    cells, present = settle(group_agg(df, [YEAR], spec))
    if not present:
        raise ValueError(f"no data for {g} = {entity!r}; distinct_list(panel, {g!r}) lists the valid values")
    reindex = cfg.get("reindex") and cfg.get("years")
    return _entity_wide(to_long(cells, [YEAR], spec), [], _asked(cfg) if reindex else present, 0.0 if reindex else None)


def report_all_entities(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """R7 for every value of ``group_col`` in one job (one row per
    entity x metric) instead of one job per entity. Years are the requested
    ones (reindexed with 0) or, without a list, all years present."""
    g, spec = cfg["group_col"], dict(agg)
    df = apply_filters(panel, cfg.get("years")).filter(F.col(YEAR).isNotNull() & F.col(g).isNotNull())
    cells, years = _cells(group_agg(df, [g, YEAR], spec), cfg)
    return _entity_wide(to_long(cells, [g, YEAR], spec), [g], years, 0.0)


# ------------------------------------------------------------------ R9 / R10
def _year_totals(panel: DataFrame, cfg: Mapping, spec: Mapping[str, str]):
    df = apply_filters(panel, cfg.get("years")).filter(F.col(YEAR).isNotNull())
    cells, years = _cells(group_agg(df, [YEAR], spec, ENTITY), cfg)
    long = to_long(cells, [YEAR, "n_entities"], spec)
    long = long.withColumn("per_entity", F.try_divide(F.col("value"), F.col("n_entities")))
    return long, years


def report_totals_plain(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """Per year the total and total / distinct entities (means divided
    too, as the class engine does). Not rounded."""
    long, years = _year_totals(panel, cfg, dict(agg))
    st = long.select("metric", F.explode(F.array(
        F.struct(F.concat(F.lit("y"), F.col(YEAR).cast("string"), F.lit("_total")).alias("label"),
                 F.col("value").alias("v")),
        F.struct(F.concat(F.lit("y"), F.col(YEAR).cast("string"), F.lit("_per_entity")).alias("label"),
                 F.col("per_entity").alias("v")))).alias("c")).select("metric", "c.label", "c.v")
    labels = [f"y{y}_{w}" for y in years for w in ("total", "per_entity")]
    return pivot_labels(st, ["metric"], "label", labels, "v")


def report_totals_change(panel: DataFrame, cfg: Mapping, agg: Mapping[str, str]) -> DataFrame:
    """R9 plus the yearly percent change of the per-entity value
    and the whole-period diff/pct; rounded by metric kind (F4)."""
    spec = dict(agg)
    long, years = _year_totals(panel, cfg, spec)
    if not years:
        raise ValueError("no data for the requested years")
    st = long.select("metric", "kind", F.explode(F.array(
        F.struct(F.concat(F.lit("y"), F.col(YEAR).cast("string"), F.lit("_total")).alias("label"),
                 F.col("value").alias("v")),
        F.struct(F.concat(F.lit("y"), F.col(YEAR).cast("string"), F.lit("_per_entity")).alias("label"),
                 F.col("per_entity").alias("v")))).alias("c")).select("metric", "kind", "c.label", "c.v")
    labels = [f"y{y}_{w}" for y in years for w in ("total", "per_entity")]
    wide = pivot_labels(st, ["metric", "kind"], "label", labels, "v")
    pp = [(y, f"y{y}_per_entity") for y in years]
    wide = add_yoy(wide, pp, diff_name=lambda y: f"_d{y}", pct_name=lambda y: f"y{y}_pct")
    wide = wide.drop(*[f"_d{y}" for y in years[1:]])
    if len(years) >= 2:
        wide = add_first_last(wide, pp[0][1], pp[-1][1], "period_diff", "period_pct")
    vals = [c for c in wide.columns if c not in ("metric", "kind")]
    return wide.withColumns({c: round_by_kind(c, "kind") for c in vals}).drop("kind")


# ------------------------------------------------------------------ R3 / R11
def contact_lists(rows: DataFrame, contacts: DataFrame, joined: DataFrame,
                  entity_name: str = "entity_name", email: str = "email",
                  mgmt_email: str = "management_email") -> dict[str, DataFrame]:
    """R3/R11 core: the distinct e-mail list (entity e-mails and one row per
    contact address, U1) in ascending order (O1), and one detail row per entity
    with its joined contact addresses."""
    ents = rows.select(ENTITY, entity_name, email).distinct()
    own = ents.select(F.col(email).alias("email"))
    mg = (contacts.join(ents.select(ENTITY), ENTITY, "left_semi")
                  .select(F.col(mgmt_email).alias("email")))
    emails = own.unionByName(mg).dropna().distinct().orderBy("email")
    details = ents.join(joined, ENTITY, "left").select(ENTITY, entity_name, email, mgmt_email)
    return {"email_list": emails, "details": details}


def report_emails(panel: DataFrame, cfg: Mapping, contacts: DataFrame, joined: DataFrame):
    """Active entities (after the optional filter)."""
    df = panel.filter(F.col("active") == 1)
    df = apply_filters(df, None, cfg.get("filter_col"), cfg.get("filter_values"))
    return contact_lists(df, contacts, joined)


# ------------------------------------------------------------------ R4 / R12
def report_missing(rows: DataFrame, cfg: Mapping, joined: DataFrame) -> DataFrame:
    """Active entities with no row for ``year``: one row each with its
    e-mail and its '; '-joined contact e-mails ('' when none; ``joined`` has one
    row per entity). Needs no more of the panel than its base view: one
    aggregate per entity tells whether the year is there."""
    df = rows.filter(F.col("active") == 1)
    df = apply_filters(df, None, cfg.get("filter_col"), cfg.get("filter_values"))
    df = df.dropna(subset=[ENTITY, "entity_name"])
    per_entity = df.groupBy(ENTITY, "entity_name").agg(
        F.expr("min_by(email, coalesce(year, -1)) FILTER (WHERE email IS NOT NULL)").alias("email"),
        F.max(F.coalesce(F.col(YEAR) == int(cfg["year"]), F.lit(False))).alias("_has"))
    # An entity under several names has the year if any of them has.
    miss = per_entity.withColumn("_has", F.max("_has").over(Window.partitionBy(ENTITY))).filter(~F.col("_has"))
    return (miss.drop("_has").join(joined, ENTITY, "left")
                .withColumn("management_email", F.coalesce("management_email", F.lit(""))))


def missing_submissions(registry: DataFrame, fact: DataFrame, year: int,
                        joined: DataFrame) -> DataFrame:
    """Registered entities with no row of ``fact`` for ``year``."""
    sub = fact.filter(F.col(YEAR) == int(year)).select(ENTITY).distinct()
    miss = registry.join(sub, ENTITY, "left_anti")
    return miss.join(joined, ENTITY, "left").select(ENTITY, "entity_name", "email", "management_email")


# ------------------------------------------------------------------ R13 / R14
def yearly_summary(latest_rows: DataFrame, sums: Sequence[str], means: Sequence[str],
                   scale: int | None = None) -> DataFrame:
    """R13 outer aggregate (A14): per year the entity count, sums (exact at a
    declared scale) and means."""
    return (latest_rows.groupBy(YEAR)
            .agg(F.count(ENTITY).alias("n_entities"),
                 *[plain_sum(c, scale).alias(f"sum_{c}") for c in sums],
                 *[F.avg(F.col(c)).alias(f"avg_{c}") for c in means]))


def compare_years(summary: DataFrame, y1: int, y2: int, value_cols: Sequence[str]) -> DataFrame:
    """The two yearly rows and their difference row (W6, U2); fewer than
    two rows -> no result (empty frame with the same columns).

    One global aggregate over the per-year summary (partial, then one row)
    picks both rows' values and counts the years found; ``inline`` turns that
    row into the year rows and the difference row -- no window over the whole
    frame and no join."""
    both = summary.filter(F.col(YEAR).isin([y1, y2]))
    pick = [F.max(F.when(F.col(YEAR) == y, F.col(c))).alias(f"_{i}_{c}")
            for i, y in enumerate((y1, y2)) for c in value_cols]
    one = both.agg(F.count_distinct(YEAR).alias("_n"), *pick)

    def row(label: str, vals) -> Column:
        return F.struct(F.lit(label).alias("label"), *[v.alias(c) for c, v in zip(value_cols, vals)])

    a = [F.col(f"_0_{c}") for c in value_cols]
    b = [F.col(f"_1_{c}") for c in value_cols]
    rows = F.array(row(str(y1), a), row(str(y2), b), row("difference", [x - y for x, y in zip(b, a)]))
    return one.filter(F.col("_n") == 2).select(F.inline(rows))
