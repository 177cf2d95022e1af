"""Staged CSV files are read by the names in their own headers."""
import pytest

from panelkit.operators import quality as Q
from panelkit.plans.ingest import Sheet, ingest
from panelkit.sources.staged import header_names, read_drop, read_sheets
from panelkit.streaming.ingest_stream import start_ingest


def files(folder, **texts):
    folder.mkdir(parents=True)
    for n, t in texts.items():
        (folder / f"{n}.csv").write_text(t, encoding="utf-8")


def test_header_names():
    assert header_names('﻿a, "b, c" ,d') == ["a", "b, c\"", "d"] or header_names('﻿a,"b, c",d') == ["a", "b, c", "d"]
    assert header_names("") == []


def test_columns_are_found_by_name(spark, tmp_path):
    files(tmp_path / "S", one="a,b\n1,2\n3,4\n", two="b,a\n2,1\n", three="b\n5\n", four="a,x,b\n6,7,8\n",
          five="a,a,b\n1,2,3\n", six="")
    sheets, found = read_drop(spark, str(tmp_path), {"S": ["a", "b"]})
    assert sorted((r.submission_id, r.row_id, r.a, r.b) for r in sheets["S"].collect()) == [
        ("five", 2, None, "3"), ("four", 2, "6", "8"), ("one", 2, "1", "2"), ("one", 3, "3", "4"),
        ("three", 2, None, "5"), ("two", 2, "1", "2")]
    assert sorted(tuple(r) for r in found.collect()) == [
        ("S", "five", 1, "a", "repeated_header", "a"), ("S", "four", 1, "x", "unknown_header", "x"),
        ("S", "three", 1, "a", "missing_header", None)]
    with pytest.raises(ValueError, match="header"):
        read_sheets(spark, str(tmp_path), {"S": ["a", "b"]})
    assert read_sheets(spark, str(tmp_path), {"S": ["a", "b"]}, strict=False)["S"].count() == 6


def test_ingest_holds_back_files_whose_header_does_not_fit(spark, tmp_path):
    files(tmp_path / "drop" / "S", good="pct,name\n10,x\n", bad="name\ny\n")
    sheets, found = read_drop(spark, str(tmp_path / "drop"), {"S": ["name", "pct"]})
    out = ingest(sheets, {"S": Sheet(rules=[Q.percent(["pct"])], tables={"t": ["name", "pct"]})},
                 str(tmp_path / "store"), found=found)
    assert [(r.submission_id, r.rule) for r in out["violations"].collect()] == [("bad", "missing_header")]
    assert [(r.submission_id, r.name, r.pct) for r in spark.read.parquet(out["written"]["t"]).collect()] == [
        ("good", "x", "10")]


def test_stream_reads_by_header_too(spark, tmp_path):
    files(tmp_path / "drop" / "S", one="qty,pct\n5,10\n", two="pct,qty\n20,7\n", three="qty\n1\n")
    root = str(tmp_path / "store")
    q = start_ingest(spark, str(tmp_path / "drop"), "S", ["qty", "pct"], [Q.percent(["pct"])],
                     {"amounts": ["qty", "pct"]}, {"qty": "double", "pct": "double"}, root,
                     checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert sorted((r.submission_id, r.qty, r.pct) for r in spark.read.parquet(f"{root}/amounts").collect()) == [
        ("one", 5.0, 10.0), ("two", 7.0, 20.0)]
    assert [(r.submission_id, r.rule) for r in spark.read.parquet(f"{root}/violations").collect()] == [
        ("three", "missing_header")]
