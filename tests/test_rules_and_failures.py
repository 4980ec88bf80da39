"""Substitution rules on literal names; failures stay with the row they hit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from altfinder.functions import attributes as at
from altfinder.operators import ingest, matching
from altfinder.plans.registry import RULE_PAIRS


def score(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        at.rule_score(at.extract(F.col("a")), at.extract(F.col("b")), F.lit("x"), F.lit("y")).alias("r")).first().r
    return row.score, ",".join(row.varying) if row.score else ""


def test_rule_pairs(spark):
    rows = [(i, a.replace("{}", "8"), b.replace("{}", "8")) for i, (a, b, *_) in enumerate(RULE_PAIRS)]
    got = spark.createDataFrame(rows, "i int, a string, b string").select(
        "i", at.rule_score(at.extract(F.col("a")), at.extract(F.col("b")), F.lit("x"), F.lit("y")).alias("r")).collect()
    for row in got:
        _, _, want, varying = RULE_PAIRS[row.i]
        assert row.r.score == want, RULE_PAIRS[row.i]
        assert not want or ",".join(row.r.varying) == varying


def test_one_failing_request_costs_one_request(spark):
    requests = spark.createDataFrame([(i, 0, f"text {i}") for i in range(20)], "query_id long, batch int, request string").coalesce(1)

    def model(texts):
        if any(t == "text 7" for t in texts):
            raise ValueError("no answer")
        return ["[]" for _ in texts]

    got = {r.query_id: r for r in matching.ask_model(requests, model).collect()}
    assert [i for i, r in got.items() if r.reply is None] == [7]
    assert got[7].error == "ValueError: no answer" and got[6].error is None


def test_record_keeps_one_row_and_the_worse_outcome(spark):
    now = dt.datetime(2024, 1, 1)
    old = ingest.record(spark.createDataFrame([], "product_id long, status string, embedding_dimension int, text_length int, "
                                                  "created_at timestamp, updated_at timestamp"),
                        spark.createDataFrame([(1, "completed", 8, 3)], "product_id long, status string, embedding_dimension int, text_length int"), now)
    new = spark.createDataFrame([(1, "completed", 8, 3), (1, "failed", None, 0)],
                                "product_id long, status string, embedding_dimension int, text_length int")
    assert [(r.product_id, r.status) for r in ingest.record(old, new, now).collect()] == [(1, "failed")]


@pytest.mark.parametrize("blank", [None, "", "  "])
def test_a_row_that_turns_blank_is_failed(spark, tmp_base, blank):
    from altfinder.schemas import TEXT_FIELDS

    schema = "id long, " + ", ".join(f"{c} string" for c in TEXT_FIELDS)
    good = spark.createDataFrame([(1, *["word"] * len(TEXT_FIELDS)), (2, *["other"] * len(TEXT_FIELDS))], schema)
    ingest.process(good, tmp_base, 8, dt.datetime(2024, 1, 1))
    turned = spark.createDataFrame([(1, *[blank] * len(TEXT_FIELDS))], schema)
    progress = ingest.process(turned, tmp_base, 8, dt.datetime(2024, 1, 2), run=1)
    assert [(r.product_id, r.status) for r in progress.collect()] == [(1, "failed")]
