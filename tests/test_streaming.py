from panelkit.operators import quality as Q
from panelkit.streaming.ingest_stream import start_ingest


def test_stream_ingest_available_now(spark, tmp_path):
    drop = tmp_path / "drop" / "lines"
    drop.mkdir(parents=True)
    (drop / "s1.csv").write_text("qty,pct\n5,10\n7,20\n", encoding="utf-8")
    (drop / "s2.csv").write_text("qty,pct\n1,150\n", encoding="utf-8")
    root = str(tmp_path / "store")
    q = start_ingest(spark, str(tmp_path / "drop"), "lines", ["qty", "pct"], [Q.percent(["pct"])],
                     {"amounts": ["qty", "pct"]}, {"qty": "double", "pct": "double"}, root,
                     checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted((r.submission_id, r.qty) for r in spark.read.parquet(f"{root}/amounts").collect())
    assert got == [("s1", 5.0), ("s1", 7.0)]
    v = spark.read.parquet(f"{root}/violations").collect()
    assert [(r.submission_id, r.rule) for r in v] == [("s2", "percent")]
    # a second file arriving later is picked up by the next run, old ones are not re-read
    (drop / "s3.csv").write_text("qty,pct\n2,30\n", encoding="utf-8")
    q = start_ingest(spark, str(tmp_path / "drop"), "lines", ["qty", "pct"], [Q.percent(["pct"])],
                     {"amounts": ["qty", "pct"]}, {"qty": "double", "pct": "double"}, root,
                     checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted((r.submission_id, r.qty) for r in spark.read.parquet(f"{root}/amounts").collect())
    assert got == [("s1", 5.0), ("s1", 7.0), ("s3", 2.0)]
