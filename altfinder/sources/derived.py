"""Tables derived from the driver's event log, in Spark and as SQL text.

``match_feedback``: a purchase is a like, an error a dislike; the user is the
source and the JSON counter picks one of five matches.

``crossref_from_events``: a cross-reference table over the same keys: one
list per user, one entry per (user, match) seen in any event, ordered by
match; the score grows with the number of events, some scores are padded
or unparseable (as real model output can be), and users with a purchase
also list themselves at 100 -- so parsing, self-removal and ties all get
exercised on data that grows with the event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altfinder.schemas import MATCH_ARRAY
from altfinder.session import read_table

FEEDBACK_SQL = """
SELECT event_id, ts,
       concat('U', CAST(user_id AS VARCHAR)) AS source_item,
       concat('M', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR)) AS matched_item,
       CASE event_type WHEN 'purchase' THEN 'like' ELSE 'dislike' END AS feedback
FROM events
WHERE event_type IN ('purchase', 'error')
"""


def _counter(props) -> F.Column:
    return F.regexp_extract(props, r"([0-9]+)", 1).try_cast("int")


def match_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_of(read_table(spark, sf_dir, "events"))


def feedback_of(ev: DataFrame) -> DataFrame:
    """The feedback in an event log, static or streaming."""
    return ev.where(F.col("event_type").isin("purchase", "error")).select(
        "event_id", "ts",
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_item"),
        F.concat(F.lit("M"), (_counter(F.col("props")) % 5).cast("string")).alias("matched_item"),
        F.when(F.col("event_type") == "purchase", F.lit("like")).otherwise(F.lit("dislike")).alias("feedback"),
    )


def crossref_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("M"), (_counter(F.col("props")) % 5).cast("string")).alias("item"),
        "event_type", "ts")
    g = ev.groupBy("src", "item").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("attrs"),
        F.min("ts").alias("c"), F.max("ts").alias("u"))
    s = (F.lit(40) + (F.col("n") * 7) % 61).cast("string")
    score_txt = (F.when(F.col("n") % 7 == 0, F.lit("x"))
                 .when(F.col("n") % 5 == 0, F.concat(F.lit(" "), s, F.lit(" ")))
                 .otherwise(s))
    entries = g.select("src", "item", "c", "u",
                       F.concat_ws("|", F.col("item"), score_txt, F.col("attrs")).alias("r"))
    selfs = (ev.where(F.col("event_type") == "purchase").groupBy("src")
             .agg(F.min("ts").alias("c"), F.max("ts").alias("u"))
             .select("src", F.col("src").alias("item"), "c", "u", F.concat(F.col("src"), F.lit("|100|")).alias("r")))
    allr = entries.unionByName(selfs)
    return (allr.groupBy("src")
            .agg(F.array_sort(F.collect_list(F.struct("item", "r"))).alias("_l"),
                 F.min("c").alias("created_at"), F.max("u").alias("updated_at"))
            .select(F.col("src").alias("item_number"),
                    F.transform("_l", lambda x: F.struct(x["r"].alias("r"), F.lit(None).cast("int").alias("l"),
                                                         F.lit(None).cast("int").alias("d"))).cast(MATCH_ARRAY)
                    .alias("matches"),
                    "created_at", "updated_at"))


# Exploded form of the same table: one row per (item_number, pos) with the
# raw entry text; list order is by matched item.
CROSSREF_ENTRIES_SQL = """
xr_ev AS (
  SELECT concat('U', CAST(user_id AS VARCHAR)) AS src,
         concat('M', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR)) AS item,
         event_type, ts
  FROM events
),
xr_g AS (
  SELECT src, item, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS attrs
  FROM xr_ev GROUP BY src, item
),
xr_e AS (
  SELECT src, item,
         concat_ws('|', item,
                   CASE WHEN n % 7 = 0 THEN 'x'
                        WHEN n % 5 = 0 THEN ' ' || CAST(40 + (n * 7) % 61 AS VARCHAR) || ' '
                        ELSE CAST(40 + (n * 7) % 61 AS VARCHAR) END,
                   attrs) AS r
  FROM xr_g
  UNION ALL
  SELECT DISTINCT src, src AS item, src || '|100|' AS r FROM xr_ev WHERE event_type = 'purchase'
),
xr AS (
  SELECT src AS item_number, item, r,
         CAST(row_number() OVER (PARTITION BY src ORDER BY item, r) - 1 AS INTEGER) AS pos
  FROM xr_e
)
"""
