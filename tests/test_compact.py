from pyspark.sql import functions as F

from altfinder.functions import compact as cp


def parse(spark, values, bad=50):
    df = spark.createDataFrame([(v,) for v in values], "r string")
    return [r["p"] for r in df.select(cp.parse_compact(F.col("r"), bad).alias("p")).collect()]


def test_parse_edge_rows(spark):
    p = parse(spark, ["A|x|", "A", "", " A | 90 | cfm , ", "A|9.5|", "ACM09008|100|", "SUPDB8|92|cfm"])
    assert (p[0]["item"], p[0]["score"], p[0]["ok"]) == ("A", 50, True)
    assert not p[1]["ok"] and not p[2]["ok"]
    assert (p[3]["item"], p[3]["score"], p[3]["attrs"]) == ("A", 90, ["cfm"])
    assert p[4]["score"] == 50
    assert (p[5]["score"], p[5]["attrs"]) == (100, [])
    assert p[6]["attrs"] == ["cfm"]
    assert parse(spark, ["A|x|"], bad=0)[0]["score"] == 0


def test_write_parse_roundtrip(spark):
    rows = [("FCC46120002", 85, ["cfm", "voltage"]), ("AERAF08", 78, ["cfm", "type", "voltage"]), ("X", 50, [])]
    df = spark.createDataFrame(rows, "item string, score int, attrs array<string>")
    back = df.select(cp.parse_compact(cp.write_compact("item", "score", "attrs")).alias("p")).collect()
    assert [(b["p"]["item"], b["p"]["score"], b["p"]["attrs"]) for b in back] == rows


def test_reply_fence_and_bad_json(spark):
    df = spark.createDataFrame([('```json\n[{"r": "A|90|"}]\n```',), ("not json",), ('[{"r": "B|80|x"}]',)],
                               "reply string")
    got = [r["a"] for r in df.select(cp.parse_reply(F.col("reply")).alias("a")).collect()]
    assert got == [["A|90|"], None, ["B|80|x"]]
