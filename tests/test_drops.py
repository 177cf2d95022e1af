"""Drops: numbers and ranges that hold over retries, reads of finished drops
only, newest rows kept up to date, ids that go on over drops."""
import pytest
from pyspark.sql import functions as F

from panelkit.operators import quality as Q
from panelkit.plans.ingest import Dictionary, Names, Sheet, ingest
from panelkit.sources.drops import DropStore, LatestTable


def test_numbers_and_ranges_hold_over_retries(spark, tmp_path):
    store = DropStore(spark, str(tmp_path))
    assert [store.claim(d) for d in ("a", "b", "a", "c", "b")] == [1, 2, 1, 3, 2]
    assert store.range("id", 1, 10, floor=7) == 7
    assert store.range("id", 2, 5) == 17
    assert store.range("id", 1, 10) == 7  # tried again
    assert store.range("id", 3, 0) == 22 and store.range("other", 3, 2) == 0
    with pytest.raises(ValueError, match="now has 11"):
        store.range("id", 1, 11)
    again = DropStore(spark, str(tmp_path))  # another driver
    assert again.claim("c") == 3 and again.range("id", 4, 1) == 22


def test_an_abandoned_claim_is_passed_over(spark, tmp_path):
    store = DropStore(spark, str(tmp_path))
    store._folder("claims").create("000000001", "")  # its driver died before it wrote
    assert store.claim("a") == 2 and store.claim("a") == 2


def test_only_finished_drops_are_read(spark, tmp_path):
    store = DropStore(spark, str(tmp_path))
    df = spark.range(3)
    n = store.claim("a")
    store.append(df, "t", n)
    assert store.read("t") is None and store.done(n) is None
    store.append(df, "t", n)  # tried again after a failure: the folder is written anew
    store.finish(n, ["t"])
    assert store.read("t").count() == 3 and store.done(n) == ["t"]
    store.append(spark.range(5), "t", store.claim("b"))
    assert store.read("t").count() == 3
    with pytest.raises(ValueError, match="not writable"):
        store.append(df, "u", n, {"t": ["id"]})


def newest(spark, rows, store):
    return {tuple(r) for r in rows.select("k", "at", "seq").collect()}


def test_latest_follows_the_drops(spark, tmp_path):
    store = DropStore(spark, str(tmp_path))
    latest = LatestTable(store, "t", ["k"], ["at", "seq"], parts=8)
    assert latest.fold() == [] and latest.read() is None
    drops = [[(1, 10, 1), (2, 10, 2), (1, 12, 3), (None, 1, 4)], [(2, 9, 5), (3, 1, 6)], [(1, 12, 7), (None, 0, 8)]]
    want: dict = {}
    for i, rows in enumerate(drops):
        n = store.claim(f"d{i}")
        store.append(spark.createDataFrame(rows, "k int, at int, seq int").repartition(3), "t", n)
        store.finish(n, ["t"])
        assert latest.fold() == [n] and latest.fold() == []
        for k, at, seq in rows:
            want[k] = max(want.get(k, (at, seq)), (at, seq))
        got = {r.k: (r["at"], r.seq) for r in latest.read().collect()}
        assert got == want
    # a drop rewrites the parts of its keys and no others
    last = {int(p) for p in latest.folds.read("000000002").split()}
    keys = spark.createDataFrame([(2,), (3,)], "k int")
    assert last == {r.p for r in keys.select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("p")).collect()}


def test_a_fold_that_broke_off_is_done_again(spark, tmp_path):
    store = DropStore(spark, str(tmp_path))
    latest = LatestTable(store, "t", ["k"], ["seq"], parts=4)
    n = store.claim("a")
    store.append(spark.createDataFrame([(1, 1), (1, 2)], "k int, seq int"), "t", n)
    store.finish(n, ["t"])
    create = latest.folds.create
    latest.folds.create = lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver"))
    with pytest.raises(RuntimeError):
        latest.fold()
    assert latest.read() is None
    latest.folds.create = create
    assert latest.fold() == [n] and [tuple(r) for r in latest.read().collect()] == [(1, 2)]


def forms(spark, *rows):
    return spark.createDataFrame(list(rows), "submission_id string, row_id long, name string, kind string, area string")


def test_names_and_ids_go_on_over_drops(spark, tmp_path):
    reg = spark.createDataFrame([(7, "Alfa park")], "entity_id long, entity_name string")
    kinds = spark.createDataFrame([("road", 3)], "kind string, kind_id long")
    plan = {"x": Sheet(types={"area": "double"}, names=[Names("name", reg)], rules=[Q.nonneg_real(["area"])],
                       dictionaries=[Dictionary(["kind"], kinds, "kind_id", "kinds_new")],
                       tables={"t": ["area", "kind_id"]}, required={"t": ["area"]})}
    first = forms(spark, ("s1", 1, "Beta Park", "rail", "1"), ("s1", 2, "ALFA park", "road", "2"),
                  ("s2", 1, "Gamma telep", "air", "-1"), ("s3", 1, "Alfa park", "rail", None))
    second = forms(spark, ("s4", 1, "beta park", "sea", "4"), ("s4", 2, "Delta zona", "rail", "5"),
                   ("s4", 3, "Alfa park", "air", "6"))
    root = str(tmp_path)
    one = ingest({"x": first}, plan, root, drop="one")
    assert one["drop"] == 1
    two = ingest({"x": second}, plan, root, drop="two")
    again = ingest({"x": first}, plan, root, drop="one")  # nothing changes
    assert again["drop"] == 1 and again["written"] == one["written"]
    assert again["violations"].collect() == one["violations"].collect()
    store = DropStore(spark, root)
    got = sorted((r.submission_id, r.row_id, r.ingest_seq, r.entity_id, r.area, r.kind_id) for r in store.read("t").collect())
    # s2 is held back by its area, the row without one is not kept (but has its place)
    assert got == [("s1", 1, 1, 8, 1.0, 4), ("s1", 2, 2, 7, 2.0, 3),
                   ("s4", 1, 4, 8, 4.0, 5), ("s4", 2, 5, 9, 5.0, 4), ("s4", 3, 6, 7, 6.0, 6)] or \
        got == [("s1", 1, 1, 8, 1.0, 4), ("s1", 2, 2, 7, 2.0, 3),
                ("s4", 1, 4, 8, 4.0, 6), ("s4", 2, 5, 9, 5.0, 4), ("s4", 3, 6, 7, 6.0, 5)]
    assert sorted((r.entity_id, r.entity_name) for r in store.read("registry_new").collect()) == [
        (8, "Beta Park"), (9, "Delta zona")]
    assert two["drop"] == 2


def test_a_failed_drop_uses_its_numbers_when_tried_again(spark, tmp_path, monkeypatch):
    reg = spark.createDataFrame([(7, "Alfa park")], "entity_id long, entity_name string")
    plan = {"x": Sheet(names=[Names("name", reg)], tables={"t": ["area"], "u": ["kind"]})}
    rows = forms(spark, ("s1", 1, "Beta Park", "rail", "1"), ("s1", 2, "Gamma", "road", "2"))
    append = DropStore.append

    def fails(self, df, table, number, whitelist=None):
        if table == "u":
            raise RuntimeError("lost driver")
        return append(self, df, table, number, whitelist)
    monkeypatch.setattr(DropStore, "append", fails)
    with pytest.raises(RuntimeError):
        ingest({"x": rows}, plan, str(tmp_path), drop="one")
    store = DropStore(spark, str(tmp_path))
    assert store.read("t") is None and store.read("registry_new") is None
    monkeypatch.setattr(DropStore, "append", append)
    assert ingest({"x": rows}, plan, str(tmp_path), drop="one")["drop"] == 1
    assert sorted((r.ingest_seq, r.entity_id, r.area) for r in store.read("t").collect()) == [(1, 8, "1"), (2, 9, "2")]
    assert store.read("u").count() == 2 and store.read("registry_new").count() == 2
