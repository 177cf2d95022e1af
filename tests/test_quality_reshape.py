from pyspark.sql import functions as F

from panelkit.operators import quality as Q
from panelkit.operators import reshape as RP


def _viol(spark, data, schema, rules):
    df = spark.createDataFrame(data, schema)
    return sorted((r.row_id, r.field, r.rule) for r in
                  Q.violations(df, rules, ["submission_id", "row_id"], "s").collect())


def test_rules_nulls_pass_and_limits(spark):
    rows = [("a", 1, "100", "0", "igen", "x@y.hu", "árvíztűrő@tükör.hu"),
            ("a", 2, "100.5", "-1", "Nem", "bad@", None),
            ("b", 3, None, "2.5", "talán", None, "x@y")]
    schema = "submission_id string, row_id int, pct string, n string, yn string, e string, e2 string"
    got = _viol(spark, rows, schema, [Q.percent(["pct"]), Q.nonneg_int(["n"]), Q.yes_no(["yn"]),
                                      Q.pattern(["e", "e2"], Q.EMAIL_PATTERN, "email"),
                                      Q.percent(["absent_column"])])
    assert got == [(2, "e", "email"), (2, "n", "nonneg_int"), (2, "pct", "percent"),
                   (3, "e2", "email"), (3, "n", "nonneg_int"), (3, "yn", "yes_no")]


def test_sum_rules_only_when_all_present(spark):
    rows = [("a", 1, "60", "40.0000001"), ("a", 2, "60", "41"), ("a", 3, None, "90")]
    got = _viol(spark, rows, "submission_id string, row_id int, a string, b string",
                [Q.sum_equals(["a", "b"], 100.0), Q.sum_at_most(["a", "b"], 100.0)])
    assert got == [(2, "a+b", "sum_at_most"), (2, "a+b", "sum_equals")]


def test_gate_holds_back_whole_submission(spark):
    data = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "submission_id string, row_id int")
    bad = spark.createDataFrame([("a", 2)], "submission_id string, row_id int")
    assert [r.row_id for r in Q.gate(data, bad, ["submission_id"]).collect()] == [3]


def test_recode_and_explode(spark):
    df = spark.createDataFrame([(1, " Igen ", "a, b , c ,"), (2, "NEM", None), (3, "x", "")],
                               "id int, f string, t string")
    codes = {r.id: r.c for r in df.select("id", RP.recode_yes_no("f").alias("c")).collect()}
    assert codes == {1: "1", 2: "0", 3: "x"}  # what is neither stays, for the rules to report
    typed = RP.typed(df.withColumn("f", RP.recode_yes_no("f")), {"f": "int"})  # as the ingest does next
    assert {r.id: r.f for r in typed.collect()} == {1: 1, 2: 0, 3: None}
    parts = [(r.id, r.pos, r.item) for r in RP.explode_list(df, "t", ["id"]).orderBy("id", "pos").collect()]
    assert parts == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, ""), (3, 0, "")]


def test_rename_split_defaults(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "k int, a string, b double")
    wide = RP.rename(df, {"a": "name", "zz": "ignored"})
    parts = RP.split(wide, {"t1": ["name"], "t2": ["b", "missing"]}, keep=["k"])
    assert parts["t1"].columns == ["k", "name"] and parts["t2"].columns == ["k", "b"]
    out = RP.with_defaults(wide, {"year": F.lit(2023), "b": F.lit(0.0)}).first()
    assert out.year == 2023 and out.b == 2.0


def test_audits(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "k int, pid int")
    assert [r.key for r in Q.audit_fk(child, "pid", parent, "id", "fk").collect()] == [3]
    assert Q.audit_pk(child.union(child), ["k"]).count() == 3
    nn = {r.field: r.n_null for r in Q.audit_not_null(child, ["k", "pid"]).collect()}
    assert nn == {"pid": 1}
