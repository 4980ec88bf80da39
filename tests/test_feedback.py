import datetime as dt

from pyspark.sql import functions as F

from altfinder.operators import feedback as fb
from altfinder.schemas import CROSSREF_SCHEMA
from altfinder.streaming import feedback_state as fst
from altfinder.streaming import feedback_stream as fs


def table(spark, rows):
    data = [(k, [{"r": r, "l": l, "d": d} for r, l, d in lst], None, None) for k, lst in rows]
    return spark.createDataFrame(data, CROSSREF_SCHEMA)


def events(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(hours=h), s, m, f) for i, (h, s, m, f) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, source_item string, matched_item string, "
                                       "feedback string")


def test_fold_removal_and_emptied_list(spark):
    t = table(spark, [("S", [("A|90|", None, None), ("B|80|", 0, 6)]), ("E", [])])
    ev = events(spark, [(0, "S", "A", "like"), (1, "S", "B", "like"), (2, "S", "A", "dislike"),
                        (3, "S", "Z", "like"), (4, "E", "A", "like"), (5, "S", "A", "wow")]
                + [(6 + i, "S", "A", "dislike") for i in range(5)] + [(20, "S", "A", "like")])
    new, rep = fb.fold(t, ev)
    r = {x["event_id"]: (x["status"], x["likes"], x["dislikes"], x["removed"]) for x in rep.collect()}
    assert r[0] == ("updated", 1, 0, False)
    assert r[1] == ("updated", 1, 6, True)       # a like removes an entry already above 5 dislikes
    assert r[3][0] == "not_found" and r[4][0] == "no_crossref"
    assert 5 not in r                            # invalid type never replies
    assert r[10] == ("updated", 1, 6, True)      # sixth dislike removes A
    assert r[11][0] == "no_crossref"             # list emptied
    assert {x["item_number"]: x["matches"] for x in new.collect()}["S"] == []


def _streamed(spark, base, ev, t, n_files, merge_every):
    """The fold by a stream that reads one file per micro-batch, in time order."""
    import os
    import shutil

    os.makedirs(f"{base}/events")
    cuts = sorted(r["ts"] for r in ev.select("ts").collect())
    bounds = [cuts[len(cuts) * k // n_files] for k in range(n_files)] + [cuts[-1] + dt.timedelta(seconds=1)]
    for k in range(n_files):
        ev.where((F.col("ts") >= bounds[k]) & (F.col("ts") < bounds[k + 1])).coalesce(1).write.parquet(f"{base}/part{k}")
        name = next(f for f in os.listdir(f"{base}/part{k}") if f.endswith(".parquet"))
        shutil.copy(f"{base}/part{k}/{name}", f"{base}/events/f{k}.parquet")
        os.utime(f"{base}/events/f{k}.parquet", (1_000_000 + k, 1_000_000 + k))
        rows = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
        fs.start(rows, t, f"{base}/state", f"{base}/checkpoint", merge_every).awaitTermination()
    return fs.table(spark, t, f"{base}/state")


def test_stream_equals_batch(spark, tmp_base):
    t = table(spark, [("S", [("A|90|", None, None), ("B|80|", None, None), ("A|70|", 2, 4)]), ("N", [("A|1|", None, None)])])
    rows = [(h, "S", "A" if h % 3 else "B", "dislike" if h % 2 else "like") for h in range(40)]
    ev = events(spark, rows)
    batch, _ = fb.fold(t, ev)
    norm = lambda df: sorted((r["item_number"], [(m["r"], m["l"], m["d"]) for m in r["matches"]])
                             for r in df.collect())
    assert norm(batch) == norm(_streamed(spark, tmp_base, ev, t, 5, 3))  # restarted after each file, merged twice


def test_keyed_state_equals_batch_in_any_order_of_arrival(spark, tmp_base):
    import os
    import shutil

    t = table(spark, [("S", [("A|90|", None, None), ("B|80|", 0, 6), ("A|70|", 2, 4)]), ("N", [("A|1|", None, None)]), ("E", [])])
    rows = [(h, "S", "A" if h % 3 else "B", "dislike" if h % 2 else "like") for h in range(40)]
    rows += [(5, "N", "A", "dislike")] * 4 + [(33, "N", "A", "like"), (7, "E", "A", "like"), (8, "S", "Z", "like"), (9, "S", "A", "wow")]
    rows += [(1, "N", "A", "dislike"), (2, "N", "A", "like")]  # these two come with the last file: late
    ev = events(spark, rows)
    last = len(rows) - 2
    # files hold ten hours each; every fourth event comes a file late, less than the delay
    place = F.floor(F.hour("ts") / 10 + F.datediff("ts", F.lit("2024-01-01").cast("date")) * 2.4)
    filed = ev.withColumn("file", F.when(F.col("event_id") >= last, 4).otherwise(
        F.least(F.lit(4), place + (F.col("event_id") % 4 == 3).cast("int")))).persist()
    os.makedirs(f"{tmp_base}/events")
    names = []
    for k in range(5):
        filed.where(F.col("file") == k).drop("file").coalesce(1).write.parquet(f"{tmp_base}/part{k}")
        names.append(next(f for f in os.listdir(f"{tmp_base}/part{k}") if f.endswith(".parquet")))
    late = 0
    for present in (2, 5):  # stopped after two files, then started again with the others
        for k in range(present):
            if not os.path.exists(f"{tmp_base}/events/f{k}.parquet"):
                shutil.copy(f"{tmp_base}/part{k}/{names[k]}", f"{tmp_base}/events/f{k}.parquet")
                os.utime(f"{tmp_base}/events/f{k}.parquet", (1_000_000 + k, 1_000_000 + k))
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_base}/events")
        query = fst.start(stream, t, f"{tmp_base}/state", f"{tmp_base}/checkpoint", delay="16 hours")
        query.awaitTermination()
        late += fst.late_events(query)
        norm = lambda df: sorted((r["item_number"], [(m["r"], m["l"], m["d"]) for m in r["matches"]])
                                 for r in df.collect())
        seen = filed.where((F.col("file") < present) & (F.col("event_id") < last)).drop("file")
        assert norm(fst.table(spark, t, f"{tmp_base}/state")) == norm(fb.fold(t, seen)[0])
    assert late == 2


def _python_fold(lists, evs):
    """The reference's one-request-at-a-time fold, in plain Python."""
    lists = {k: [dict(r=r, l=l or 0, d=d or 0) for r, l, d in v] for k, v in lists.items()}
    for _, _, s, m, f in sorted(evs, key=lambda e: (e[1], e[0])):
        cur = lists.get(s)
        if not cur or f not in ("like", "dislike"):
            continue
        out = []
        for e in cur:
            if e["r"].startswith(f"{m}|"):
                e = dict(e, l=e["l"] + (f == "like"), d=e["d"] + (f == "dislike"))
                if e["d"] > 5:
                    continue
            out.append(e)
        lists[s] = out
    return {k: [(e["r"], e["l"], e["d"]) for e in v] for k, v in lists.items()}


def test_hot_key_fold_matches_sequential(spark):
    import random

    rnd = random.Random(5)
    lists = {"HOT": [("A|90|", None, None), ("B|80|", None, None), ("A|70|", 0, 0)],
             "S2": [("A|60|", None, None), ("C|50|", None, None)]}
    t = table(spark, [(k, v) for k, v in lists.items()])
    t0 = dt.datetime(2024, 1, 1)
    evs = []
    for i in range(300):
        src = "HOT" if i % 3 else rnd.choice(["S2", "HOT", "NONE"])
        item = rnd.choice(["A", "B", "C", "Z"])
        fbk_type = "like" if rnd.random() < 0.8 else "dislike"
        evs.append((i, t0 + dt.timedelta(minutes=7 * i), src, item, fbk_type))
    ev = spark.createDataFrame(evs, "event_id long, ts timestamp, source_item string, matched_item string, "
                                    "feedback string")
    for chunk in (60, 3600, 10 ** 7):      # many chunks per key ... one chunk per key
        new, _ = fb.fold(t, ev, chunk_seconds=chunk)
        got = {r["item_number"]: [(m["r"], m["l"] or 0, m["d"] or 0) for m in r["matches"]] for r in new.collect()}
        assert got == _python_fold(lists, evs)


def test_keyed_state_keeps_a_row_for_a_group_of_pairs(spark, tmp_base):
    lists = {f"S{i}": [("A|90|", None, None), ("B|80|", 0, 5), ("A|70|", 2, 4)] for i in range(40)}
    t = table(spark, [*lists.items()])
    rows = [(h, f"S{i}", "AB"[h % 2], "dislike" if h % 3 else "like") for i in range(40) for h in range(9)]
    ev = events(spark, [*rows, (3, None, "A", "like"), (3, "S1", None, "like")])
    ev = ev.withColumn("ts", F.when(~F.col("event_id").isin(5, 19), F.col("ts")))  # two without a time: last
    ev.unionByName(ev.where("event_id % 7 = 0")).coalesce(1).write.parquet(f"{tmp_base}/events")  # some come twice
    read = spark.read.parquet(f"{tmp_base}/events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_base}/events")
    query = fst.start(stream, t, f"{tmp_base}/state", f"{tmp_base}/checkpoint", groups=3)
    query.awaitTermination()
    norm = lambda df: {r["item_number"]: [(m["r"], m["l"] or 0, m["d"] or 0) for m in r["matches"]] for r in df.collect()}
    want = _python_fold(lists, [(r["event_id"], r["ts"] or dt.datetime.max, r["source_item"], r["matched_item"], r["feedback"])
                                for r in read.collect()])
    assert norm(fst.table(spark, t, f"{tmp_base}/state")) == want
    kept = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(kept) < 40  # groups, their values and timers; not a row for each pair and event
