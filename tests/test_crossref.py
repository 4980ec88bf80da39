from pyspark.sql import functions as F

from altfinder.operators import crossref as xr
from altfinder.schemas import CROSSREF_SCHEMA

TS = "2025-01-01 00:00:00"


def table(spark, rows):
    data = [(k, [{"r": r, "l": None, "d": None} for r in lst], None, None) for k, lst in rows]
    return spark.createDataFrame(data, CROSSREF_SCHEMA)


def test_best_alternative_skips_self_and_bad_scores(spark):
    t = table(spark, [("S1", ["S1|100|", "A|x|", "B|90|cfm", "C|90|"]), ("S2", []), ("S3", ["S3|100|"])])
    got = {r["item_number"]: (r["alt_item_number"], r["match_score"]) for r in xr.best_alternative(t).collect()}
    assert got == {"S1": ("B", 90)}


def test_empty_list_is_missing(spark):
    t = table(spark, [("S1", ["A|90|"]), ("S2", [])])
    req = spark.createDataFrame([("S1",), ("S2",), ("S9",)], "item_number string")
    got = {r["item_number"]: r["found"] for r in xr.stored_matches(t, req).collect()}
    assert got == {"S1": True, "S2": False, "S9": False}


def test_upsert_twice_equals_once(spark):
    t = table(spark, [("S1", ["A|90|"])])
    new = spark.createDataFrame([("S1", [{"r": "B|80|", "l": None, "d": None}]),
                                 ("S2", [{"r": "C|70|", "l": None, "d": None}])],
                                "item_number string, matches array<struct<r:string,l:int,d:int>>")
    once = xr.upsert(t, new, TS)
    twice = xr.upsert(once, new, TS)
    norm = lambda df: sorted((r["item_number"], [m["r"] for m in r["matches"]]) for r in df.collect())
    assert norm(once) == norm(twice) == [("S1", ["B|80|"]), ("S2", ["C|70|"])]


def test_delete_raw_prefix_and_statuses(spark):
    t = table(spark, [("S1", [" A |90|", "A|80|", "A|70|x", "AB|60|"]), ("S2", [])])
    dels = spark.createDataFrame([("S1", "A"), ("S1", "Z"), ("S2", "A"), ("S9", "A")],
                                 "source_item string, matched_item string")
    new, status = xr.delete_matches(t, dels, TS)
    lists = {r["item_number"]: [m["r"] for m in r["matches"]] for r in new.collect()}
    assert lists["S1"] == [" A |90|", "AB|60|"] and lists["S2"] == []
    st = {(r["source_item"], r["matched_item"]): (r["status"], r["remaining_matches"]) for r in status.collect()}
    assert st == {("S1", "A"): ("removed", 2), ("S1", "Z"): ("not_found", 2),
                  ("S2", "A"): ("no_crossref", 0), ("S9", "A"): ("no_crossref", 0)}


def test_bulk_upsert_counts(spark):
    t = table(spark, [("S1", ["A|90|"])])
    e = spark.createDataFrame([(1, "S1", [{"r": "B|1|", "l": None, "d": None}]),
                               (2, "S2", [{"r": "C|2|", "l": None, "d": None}]),
                               (3, "S2", [{"r": "D|3|", "l": None, "d": None}]),
                               (4, None, [])],
                              "ordinal long, item_number string, matches array<struct<r:string,l:int,d:int>>")
    new, counts = xr.bulk_upsert(t, e, TS)
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"updated": 2, "saved": 1, "error": 1}
    assert {r["item_number"]: r["matches"][0]["r"] for r in new.collect()} == {"S1": "B|1|", "S2": "D|3|"}


def test_save_step_scores(spark):
    res = spark.createDataFrame([
        ("S1", True, 0, "A", 0.876, 10, ["cfm"]), ("S1", True, 1, "B", None, 0, []),
        ("S1", True, 2, "C", None, 77, None), ("S2", False, 0, "D", 0.9, 90, []),
        ("S3", True, 0, "E", 0.5, 50, [])],
        "source_item string, found boolean, match_idx int, item_number string, relevance_score double, "
        "match_score int, varying_attributes array<string>")
    excl = spark.createDataFrame([("S3", 0)], "source_item string, match_idx int")
    got = {r["item_number"]: [m["r"] for m in r["matches"]] for r in xr.save_step(res, excl).collect()}
    assert got == {"S1": ["A|88|cfm", "B|50|", "C|77|"]}


def test_cache_routing_treats_empty_list_as_missing(spark):
    from altfinder.operators import matching as mt

    t = table(spark, [("S1", ["A|90|"]), ("S2", [])])
    src = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "item_number string")
    cached, fresh = mt.route_by_cache(src, t)
    assert [r["item_number"] for r in cached.collect()] == ["S1"]
    assert sorted(r["item_number"] for r in fresh.collect()) == ["S2", "S3"]


def test_model_hook_replies_are_parsed(spark):
    from altfinder.operators import matching as mt

    req = spark.createDataFrame([(1, 0, "r1"), (2, 0, "r2")], "query_id long, batch int, request string")

    def model(texts):
        return ['```json\n[{"r": "A|91|cfm"}, {"r": "B|x|"}]\n```' if t == "r1" else "oops" for t in texts]
    got = sorted((r["query_id"], r["item_number"], r["match_score"], r["varying_attributes"])
                 for r in mt.score_by_model(req, model).collect())
    assert got == [(1, "A", 91, ["cfm"]), (1, "B", 50, [])]
