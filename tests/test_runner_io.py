import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.operators import quality as Q
from panelkit.plans import runner
from panelkit.plans.ingest import Names, Sheet, ingest
from panelkit.sources.sinks import append_table, output_folder, write_sections
from panelkit.sources.staged import read_sheets


@pytest.fixture()
def panel(spark):
    return spark.createDataFrame(
        [(1, 2021, "N", 1, 1.0, "a", "a@x.hu"), (2, 2022, "N", 1, 2.0, "b", "b@x.hu")],
        "entity_id int, year int, region string, active int, s double, entity_name string, email string")


def test_dispatch_and_isolation(spark, panel):
    ctx = runner.Context({"full": {"s": "sum"}})
    with pytest.raises(ValueError, match="unknown report type"):
        runner.run(panel, {"type": "nope"}, ctx)
    written, failures = runner.run_batch(panel, [{"type": "totals", "name": "t"}, {"type": "nope"}], ctx)
    assert list(written) == [("t", "main")] and failures[0][0] == "nope"
    assert written["t", "main"].collect() == runner.run(panel, {"type": "totals"}, ctx).collect()


def test_output_folders_and_sections(spark, panel, tmp_path):
    at = dt.datetime(2024, 5, 6, 7, 8)
    cfg = {"type": "totals", "metric": "a metric of a very long name indeed", "years": [2020, 2022]}
    name = output_folder(cfg, at)
    assert name.startswith("type=totals;metric=a_metric_of_a_very_long_name_indeed;years=2020,2022;at=20240506T0708;")
    assert name != output_folder(dict(cfg, agg="small"), at)
    long = ["a section whose name differs only after character 31: x", "a section whose name differs only after character 31: y"]
    paths = write_sections({long[0]: panel, long[1]: panel.limit(1), "a b/c": panel}, str(tmp_path), name)
    assert len(set(paths.values())) == 3 and paths["a b/c"].endswith("/a_b-c")
    assert [spark.read.parquet(paths[s]).count() for s in long] == [2, 1]
    with pytest.raises(ValueError, match="share a folder"):
        write_sections({"a b": panel, "a_b": panel}, str(tmp_path), "other")
    with pytest.raises(Exception):
        write_sections({"a b/c": panel}, str(tmp_path), name)  # nothing is overwritten


def test_reads_after_an_append_see_it(spark, tmp_path):
    from panelkit.sources.tables import Tables
    rows = spark.range(5).withColumnRenamed("id", "o_orderkey")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert Tables(spark, str(tmp_path)).orders.count() == 5
    append_table(rows.limit(3), str(tmp_path), "orders.parquet")
    assert Tables(spark, str(tmp_path)).orders.count() == 8


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from panelkit.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(
        master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(fake)


def test_whitelist_blocks_unknown_columns(spark, panel, tmp_path):
    with pytest.raises(ValueError):
        append_table(panel, str(tmp_path), "t", {"t": ["entity_id"]})
    with pytest.raises(ValueError):
        append_table(panel, str(tmp_path), "other", {"t": ["entity_id"]})


def test_staged_ingest_end_to_end(spark, tmp_path):
    drop = tmp_path / "drop"
    (drop / "Adatok").mkdir(parents=True)
    (drop / "Adatok" / "sub1.csv").write_text("park_nev,arany\nAlfa Ipari Park,50\n", encoding="utf-8")
    (drop / "Adatok" / "sub2.csv").write_text("park_nev,arany\nÚj park,150\n", encoding="utf-8")
    (drop / "Adatok" / "sub3.csv").write_text("park_nev,arany\nŐrség park,20\n", encoding="utf-8")
    sheets = read_sheets(spark, str(drop), {"Adatok": ["park_nev", "arany"]})
    reg = spark.createDataFrame([(7, "Alfa ipari park")], "entity_id long, entity_name string")
    plan = {"Adatok": Sheet(rename={"park_nev": "name"}, rules=[Q.percent(["arany"])], types={"arany": "double"},
                            tables={"adat": ["arany"]}, names=[Names("name", reg)])}
    out = ingest(sheets, plan, str(tmp_path / "store"))
    assert [r.submission_id for r in out["violations"].collect()] == ["sub2"]
    got = sorted((r.submission_id, r.entity_id, r.arany)
                 for r in spark.read.parquet(out["written"]["adat"]).collect())
    assert got == [("sub1", 7, 50.0), ("sub3", 8, 20.0)]


def test_ingest_keeps_names_apart_and_recodes(spark, tmp_path):
    sheet = spark.createDataFrame(
        [("s1", 1, "Alfa Park", "igen", "a, b"), ("s1", 2, "Beta Park", "NEM", "c"), ("s2", 3, "ALFA, park", "talan", None)],
        "submission_id string, row_id long, park string, flag string, tags string")
    reg = spark.createDataFrame([(7, "Alfa park")], "entity_id long, entity_name string")
    plan = {"x": Sheet(rename={"park": "name"}, yes_no=["flag"], types={"flag": "int"}, defaults={"year": F.lit(2020)},
                       names=[Names("name", reg)], tables={"t": ["flag", "year"]}, lists={"tag": "tags"})}
    out = ingest({"x": sheet}, plan, str(tmp_path / "a"))
    got = sorted((r.submission_id, r.row_id, r.entity_id, r.flag, r.year)
                 for r in spark.read.parquet(out["written"]["t"]).collect())
    assert got == [("s1", 1, 7, 1, 2020), ("s1", 2, 8, 0, 2020), ("s2", 3, 7, None, 2020)]
    assert sorted((r.row_id, r["pos"], r.item) for r in spark.read.parquet(out["written"]["tag"]).collect()) == [
        (1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    strict = {"x": Sheet(rules=[Q.yes_no(["flag"])], tables={"t": ["flag"]})}
    out = ingest({"x": sheet}, strict, str(tmp_path / "b"), strict=True)
    assert out["blocked"] == "all" and not out["written"] and out["violations"].count() == 1
    out = ingest({"x": sheet}, strict, str(tmp_path / "c"))
    assert {r.submission_id for r in spark.read.parquet(out["written"]["t"]).collect()} == {"s1"}


def test_a_sheet_is_sorted_and_written_once(spark, tmp_path, monkeypatch):
    """Its rows are never checkpointed: they are numbered from the written sheet."""
    kept, checkpoint = [], type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint",
                        lambda df, *a, **k: kept.append(df.columns) or checkpoint(df, *a, **k))
    rows = [(f"s{i % 7}", i, str(i)) for i in range(100)]
    sheet = spark.createDataFrame(rows, "submission_id string, row_id long, v string").repartition(5)
    out = ingest({"x": sheet}, {"x": Sheet(types={"v": "int"}, tables={"t": ["v"]})}, str(tmp_path / "a"))
    got = sorted((r.ingest_seq, r.submission_id, r.row_id, r.v) for r in spark.read.parquet(out["written"]["t"]).collect())
    assert got == [(n, s, i, int(v)) for n, (s, i, v) in enumerate(sorted(rows), 1)]
    assert not [c for c in kept if "v" in c]


def test_sheets_and_names_are_loaded_beside_each_other(spark, tmp_path, monkeypatch):
    import threading

    from panelkit.plans import ingest as module
    both = {"dense_ids": threading.Barrier(2), "resolve_or_register": threading.Barrier(2)}
    for name, barrier in both.items():
        def meet(*a, fn=getattr(module, name), barrier=barrier, **k):
            barrier.wait(120)  # broken where the other one isn't there
            return fn(*a, **k)
        monkeypatch.setattr(module, name, meet)
    sheet = spark.createDataFrame([("s1", 1, "Alfa", "Beta"), ("s2", 2, "beta", "Gamma")],
                                  "submission_id string, row_id long, a string, b string")
    reg = spark.createDataFrame([(7, "Alfa")], "entity_id long, entity_name string")
    names = [Names("a", reg, "a_id", "a_new"), Names("b", reg, "b_id", "b_new")]
    out = ingest({"x": sheet, "y": sheet}, {"x": Sheet(names=names, tables={"t": ["a"]}), "y": Sheet(tables={"u": ["b"]})},
                 str(tmp_path / "a"))
    assert list(out["written"]) == ["a_new", "b_new", "t", "u"]
    assert sorted(map(tuple, spark.read.parquet(out["written"]["t"]).select("row_id", "a_id", "b_id").collect())) == [
        (1, 7, 8), (2, 8, 9)]
    assert sorted(map(tuple, spark.read.parquet(out["written"]["u"]).select("row_id", "b").collect())) == [
        (1, "Beta"), (2, "Gamma")]


def test_sheets_of_one_table_wait_for_each_other(spark, tmp_path):
    sheet = spark.createDataFrame([("s1", 1, "x")], "submission_id string, row_id long, a string")
    other = spark.createDataFrame([("s2", 2, "y")], "submission_id string, row_id long, a string")
    plan = {"x": Sheet(tables={"t": ["a"]}), "y": Sheet(tables={"t": ["a"]})}
    out = ingest({"x": sheet, "y": other}, plan, str(tmp_path / "a"))
    assert [tuple(r) for r in spark.read.parquet(out["written"]["t"]).select("submission_id", "a").collect()] == [("s2", "y")]


def test_staged_rows_have_their_line_numbers(spark, tmp_path):
    (tmp_path / "S").mkdir()
    for n in ("a", "b"):
        (tmp_path / "S" / f"{n}.csv").write_text("x\n" + "".join(f"{n}{i}\n" for i in range(5)), encoding="utf-8")
    rows = read_sheets(spark, str(tmp_path), {"S": ["x"]})["S"].collect()
    assert sorted((r.submission_id, r.row_id, r.x) for r in rows) == [
        (n, i + 2, f"{n}{i}") for n in "ab" for i in range(5)]


def test_a_section_for_every_value_in_one_write(spark, tmp_path):
    from panelkit.plans import reports as R
    from panelkit.sources.sinks import read_each, write_each
    panel = spark.createDataFrame([(i, 2020 + i % 3, name, float(i)) for i, name in enumerate(
        ["a/b", "a b", "007", "é=%", "x" * 40] * 6)], "entity_id int, year int, name string, s double")
    cfg = {"group_col": "name", "years": [2020, 2021, 2022]}
    path = str(tmp_path / "sections")
    manifest = {r.section: r for r in write_each(R.report_all_entities(panel, cfg, {"s": "sum"}), "name", path).collect()}
    assert set(manifest) == {"a/b", "a b", "007", "é=%", "x" * 40}
    assert len({r.folder for r in manifest.values()}) == 5 and all(r.n_files == 1 == r.n_rows for r in manifest.values())
    for name in manifest:  # each as the report of that entity alone
        one = R.report_entity(panel, dict(cfg, entity=name, reindex=True), {"s": "sum"}).first()
        got = read_each(spark, path).where(F.col("section") == name).select(*one.asDict()).first()
        assert got == one
    many = spark.range(100).select(F.lit("hot").alias("g"), "id")
    r = write_each(many, "g", str(tmp_path / "hot"), file_rows=30).first()
    assert r.n_rows == 100 and r.n_files >= 4
    with pytest.raises(Exception, match="has no g"):
        write_each(spark.createDataFrame([(None, 1)], "g string, x int"), "g", str(tmp_path / "null"))


def test_raw_append_and_views(spark, tmp_path):
    from panelkit.sources.sinks import append_raw
    from panelkit.sources.tables import DRIVER_TABLES, Tables
    path = append_raw(spark.range(2), str(tmp_path), "anything")  # S7: no whitelist asked
    append_raw(spark.range(2, 5), str(tmp_path), "anything")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    from conftest import SF001
    Tables(spark, SF001).register_views()  # S8
    try:
        n = spark.sql("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey").first().n
        assert n == Tables(spark, SF001).orders.count()
    finally:
        for t in DRIVER_TABLES:
            spark.catalog.dropTempView(t)
