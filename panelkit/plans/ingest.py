"""Full ingest (R17) for every submission of a drop at once: rename -> validate
-> gate per submission -> recode, defaults -> resolve names -> dictionary ids
-> split and explode -> append.

What later steps share is written once: the violations, the held-back
submissions, the resolved names and dictionary ids, and each clean sheet, sorted by
its ids (its numbers come from the places in it). Tables are then plain projections of
a written sheet, appended as one drop. Sheets are loaded beside each other, and so are
the name columns of a sheet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import integral_year, parse_date
from ..operators import quality as Q
from ..operators import reshape as RP
from ..operators.resolve import dense_ids, new_dictionary_rows, resolve_or_register
from ..session import shared_path, together
from ..sources.drops import DropStore

IDS = ("submission_id", "row_id")


@dataclass(frozen=True)
class Names:
    """A name column resolved against a registry (id, name columns); the id is
    stamped into ``stamp`` and unknown names are appended to ``table``."""
    column: str
    registry: DataFrame
    stamp: str = "entity_id"
    table: str = "registry_new"
    id: str = "entity_id"
    name: str = "entity_name"
    threshold: float = 90


@dataclass(frozen=True)
class Dictionary:
    """Natural keys looked up in a dictionary; new ones are appended to ``table``."""
    keys: Sequence[str]
    known: DataFrame
    id: str
    table: str


@dataclass(frozen=True)
class Sheet:
    """How one sheet is loaded. Rules see the renamed columns."""
    tables: Mapping[str, Sequence[str]]
    rules: Sequence[Q.Rule] = ()
    rename: Mapping[str, str] = field(default_factory=dict)
    yes_no: Sequence[str] = ()
    recode: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    defaults: Mapping[str, Column] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    dates: Sequence[str] = ()  # columns whose text becomes a timestamp, whatever its format
    years: Sequence[str] = ()  # columns whose number or date becomes a year
    names: Sequence[Names] = ()
    dictionaries: Sequence[Dictionary] = ()
    lists: Mapping[str, str] = field(default_factory=dict)  # table -> column of separated items
    required: Mapping[str, Sequence[str]] = field(default_factory=dict)  # table -> details that each of its rows must have


def validate(sheets: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Q.Rule]],
             ids: Sequence[str] = IDS) -> DataFrame:
    """C1-C22 over every sheet: one violations frame."""
    out = None
    for sheet, df in sheets.items():
        v = Q.violations(df, rules.get(sheet, []), list(ids), sheet)
        out = v if out is None else out.unionByName(v)
    return out


#: The column that orders rows as they came in, over all drops.
SEQUENCE = "ingest_seq"


def ingest(sheets: Mapping[str, DataFrame], plan: Mapping[str, Sheet], root: str,
           whitelist: Mapping[str, Sequence[str]] | None = None, strict: bool = False,
           drop: str | None = None, found: DataFrame | None = None) -> dict:
    """Run the whole load of one drop. With ``strict`` any violation blocks it;
    otherwise the submissions that have one, in any sheet, are held back.
    ``found`` adds violations met while reading (submission_id, ...).

    Every row gets ``ingest_seq``, its place among all rows of its sheet over all
    drops (submission and row order within one). Names and dictionary keys that
    earlier drops registered are known. Readers (``DropStore(root).read``) see a
    drop when all its tables are written; a drop that is tried again under its id
    uses the numbers it had, and does nothing where it is finished.

    Returns violations, written ({table: path}), blocked and the drop's number. A
    name is resolved by itself, so a submission with several names keeps its rows
    apart."""
    spark = next(iter(sheets.values())).sparkSession
    store = DropStore(spark, root)
    number = store.claim(drop or uuid.uuid4().hex)
    if (tables := store.done(number)) is not None:
        paths = {t: f"{store.root}/{t}/drop={number}" for t in tables if t}
        viol = paths.pop("violations", None)
        return {"violations": spark.read.parquet(viol), "written": paths, "blocked": None, "drop": number}
    run = shared_path(spark, "ingest-runs", uuid.uuid4().hex)

    def once(df: DataFrame, what: str) -> DataFrame:
        df.write.parquet(f"{run}/{what}")
        return spark.read.schema(df.schema).parquet(f"{run}/{what}")

    def claim(kind: str):
        return lambda count, last: store.range(kind, number, count, last)

    def known(df: DataFrame, table: str) -> DataFrame:
        """A registry or dictionary with what earlier drops have added."""
        earlier = store.read(table, drops=[n for n in store.drops(table) if n < number])
        return df if earlier is None else df.unionByName(earlier.select(*df.columns))

    renamed = {s: RP.rename(df, plan[s].rename) for s, df in sheets.items()}
    viol = validate(renamed, {s: p.rules for s, p in plan.items()})
    viol = once(viol if found is None else viol.unionByName(found), "violations")
    written: dict[str, str] = {}
    if strict and not viol.isEmpty():
        return {"violations": viol, "written": written, "blocked": "all", "drop": number}
    bad = once(viol.select("submission_id").distinct(), "held_back")

    def resolved(df: DataFrame, s: str, n: Names) -> tuple[str, DataFrame]:
        """The table of unknown names, and each name's id."""
        # Matching reads names and registry several times: what they come from is read once.
        asked = once(df.select(F.col(n.column).alias("query_id"), F.col(n.column).alias("name")).dropna().distinct(),
                     f"asked-{s}-{n.column}")
        registry = once(known(n.registry.select(n.id, n.name), n.table), f"registry-{s}-{n.column}")
        res, new = resolve_or_register(asked, registry, n.threshold, rid=n.id, rname=n.name, claim=claim(n.table))
        path = store.append(new, n.table, number, whitelist)
        return path, once(res.select(F.col("query_id").alias(n.column), F.col("resolved_id").alias(n.stamp)),
                          f"names-{s}-{n.column}")

    def load(s: str, p: Sheet) -> dict[str, str]:
        """The tables of one sheet."""
        out: dict[str, str] = {}
        df = Q.gate(renamed[s], bad, ["submission_id"])
        df = df.withColumns({c: RP.recode_yes_no(c) for c in p.yes_no})
        df = df.withColumns({c: RP.recode_map(c, m) for c, m in p.recode.items()})
        df = RP.with_defaults(df, p.defaults)
        df = df.withColumns({c: parse_date(c)["value"] for c in p.dates if c in df.columns})
        df = df.withColumns({c: integral_year(c) for c in p.years if c in df.columns})
        df = RP.typed(df, p.types)
        df = dense_ids(df, list(IDS), 0, SEQUENCE, lambda rows: once(rows, f"clean-{s}"))
        before = store.range(f"{SEQUENCE}-{s}", number, df.count())
        df = df.withColumn(SEQUENCE, F.col(SEQUENCE) + before)
        clean = df
        found = together(spark, [lambda n=n: resolved(clean, s, n) for n in p.names]) if apart else None
        for k, n in enumerate(p.names):
            out[n.table], ids = found[k] if found else resolved(df, s, n)
            df = df.join(ids, n.column, "left")
        for d in p.dictionaries:
            have = known(d.known.select(*d.keys, d.id), d.table)
            new = once(new_dictionary_rows(df, have, list(d.keys), d.id, claim(d.table)), f"dictionary-{s}-{d.id}")
            out[d.table] = store.append(new, d.table, number, whitelist)
            df = df.join(have.unionByName(new.select(*d.keys, d.id)), list(d.keys), "left")
        stamps = [*IDS, SEQUENCE, *[n.stamp for n in p.names]]
        if p.names or p.dictionaries:
            df = once(df, f"stamped-{s}")
        for table, part in RP.split(df, p.tables, keep=stamps).items():
            if table in p.required:
                part = part.dropna("any", subset=list(p.required[table]))
            out[table] = store.append(part, table, number, whitelist)
        for table, column in p.lists.items():
            items = RP.explode_list(df, column, stamps).where("item <> ''")
            out[table] = store.append(items, table, number, whitelist)
        return out

    # Sheets and name columns that write no table or column in common don't wait for each other.
    targets = [x for p in plan.values() for x in (*p.tables, *p.lists, *[d.table for d in p.dictionaries],
                                                  *[n.table for n in p.names])]
    apart = len(set(targets)) == len(targets) and not any(
        n.stamp in (m.column, m.stamp) for p in plan.values() for n in p.names for m in p.names if m is not n)
    loads = [lambda s=s, p=p: load(s, p) for s, p in plan.items()]
    for out in together(spark, loads) if apart else [one() for one in loads]:
        written.update(out)
    store.append(viol, "violations", number)
    store.finish(number, ["violations", *written])
    return {"violations": viol, "written": written, "blocked": None, "drop": number}
