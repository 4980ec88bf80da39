from pyspark.sql import functions as F

from altfinder.operators import ingest as ing
from altfinder.schemas import PROGRESS_SCHEMA
from altfinder.sources import snapshots as snap
from altfinder.streaming import ingest_stream as ist

TS = "2025-01-01 00:00:00"


def test_progress_fixture(spark):
    empty = spark.createDataFrame([], PROGRESS_SCHEMA)
    rows = spark.createDataFrame([(1, "completed", 768, 150), (2, "completed", 768, 200), (3, "failed", None, 0)],
                                 "product_id long, status string, embedding_dimension int, text_length int")
    p = ing.record(empty, rows, TS)
    ids = spark.createDataFrame([(1,), (999,)], "product_id long")
    got = {r["product_id"]: r["processed"] for r in ing.is_processed(p, ids).collect()}
    assert got == {1: True, 999: False}
    assert ing.high_water_mark(p).first()[0] == 2
    st = ing.progress_stats(p).first()
    assert (st["total_processed"], st["completed"], st["failed"], st["skipped"]) == (3, 2, 1, 0)
    # replace on repeat
    again = ing.record(p, spark.createDataFrame([(3, "completed", 768, 10)], rows.schema), TS)
    assert ing.high_water_mark(again).first()[0] == 3 and again.count() == 3


def test_pending_modes(spark):
    src = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    p = ing.record(spark.createDataFrame([], PROGRESS_SCHEMA),
                   spark.createDataFrame([(1, "completed", 8, 1), (2, "failed", None, 0), (4, "completed", 8, 1)],
                                         "product_id long, status string, embedding_dimension int, text_length int"),
                   TS)
    assert sorted(r["id"] for r in ing.pending(src, p).collect()) == [2, 3, 5, 6]
    assert sorted(r["id"] for r in ing.pending(src, p, mode="mark").collect()) == [5, 6]


def test_batch_resume_equals_one_shot(spark, tmp_base):
    docs = spark.createDataFrame([(i, f"steel pipe {i}" if i % 4 else "the and") for i in range(1, 41)],
                                 "id long, text string")
    # one shot
    rows1 = ing.process(docs, f"{tmp_base}/a", 16, TS, fields=["text"])
    one = ing.record(spark.createDataFrame([], PROGRESS_SCHEMA), rows1, TS)
    # two runs: first half, then whatever is pending; the second repeated
    prog = spark.createDataFrame([], PROGRESS_SCHEMA)
    r_a = ing.process(docs.where("id <= 20"), f"{tmp_base}/b", 16, TS, fields=["text"])
    prog = ing.record(prog, r_a, TS)
    rest = ing.pending(docs, prog)
    for _ in range(2):
        r_b = ing.process(rest, f"{tmp_base}/b", 16, TS, run=1, fields=["text"])
    two = ing.record(prog, r_b, TS)
    norm = lambda df: sorted((r["product_id"], r["status"]) for r in df.collect())
    assert norm(one) == norm(two) == norm(ing.progress(spark, f"{tmp_base}/b"))
    assert ing.vectors(spark, f"{tmp_base}/b").count() == 30
    got = {r["run"]: (r["rows"], r["embedded"], r["failed"]) for r in ing.reports(spark, f"{tmp_base}/b").collect()}
    assert got == {0: (20, 15, 5), 1: (25, 15, 10)}


def test_stream_ingest_equals_batch(spark, tmp_base):
    docs = spark.createDataFrame([(i, f"brass elbow {i}" if i % 5 else "") for i in range(1, 31)],
                                 "id long, text string")
    docs.repartition(3, "id").write.parquet(f"{tmp_base}/source")
    rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_base}/source")
    ist.start(rows, f"{tmp_base}/out", f"{tmp_base}/checkpoint", 16, TS, ["text"]).awaitTermination()
    st = {r["product_id"]: r["status"] for r in ing.progress(spark, f"{tmp_base}/out").collect()}
    assert len(st) == 30 and sum(v == "completed" for v in st.values()) == 24
    assert ing.vectors(spark, f"{tmp_base}/out").count() == 24


def test_keyed_write_and_verify(spark, tmp_base):
    a = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id long, v string, load int")
    b = spark.createDataFrame([(2, "z", 1), (2, "q", 0), (3, "w", 0), (None, "bad", 0)], a.schema)
    t1, _ = snap.keyed_write(None, a, f"{tmp_base}/t1", f"{tmp_base}/r1", order_col="load")
    t2, rej = snap.keyed_write(t1, b, f"{tmp_base}/t2", f"{tmp_base}/r2", order_col="load")
    assert sorted(map(tuple, t2.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert rej.count() == 1
    v = snap.verify(t2, t1.schema, 3).first()
    assert v["schema_ok"] and v["count_ok"]
