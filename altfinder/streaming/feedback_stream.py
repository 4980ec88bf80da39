"""the feedback fold as a Structured Streaming job.

The state is a table with a row per list entry (likes, dislikes, removed).
Each micro-batch folds its events into the entries they name with the batch
fold's own two-phase scan, so an entry that gets a third of all events is
spread over many tasks, and appends the entries it touched as the epoch of its
number; now and then an epoch is written whole, so reading the state does not
slow down with time. A micro-batch reads only earlier epochs and replaces its
own, so a replay counts nothing twice; the stream's checkpoint holds the
offsets.

Inside a micro-batch events apply in the order (ts, event_id), and micro-batches
in the order of arrival, as requests do: the result equals one batch fold (F1)
when no event arrives after a micro-batch that has later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from altfinder.operators import feedback as fb
from altfinder.sources import snapshots as snap

KEYS = ["source_item", "pos"]


def start(events: DataFrame, crossref: DataFrame, state: str, checkpoint: str,
          merge_every: int = snap.MERGE_EVERY) -> StreamingQuery:
    """Start the stream over ``events``, a streaming DataFrame of feedback; it
    processes every file present and stops. ``state`` is the folder of the
    state table; a restart passes the same ``crossref``."""
    spark = crossref.sparkSession
    first = fb.entries(crossref).withColumn("removed", F.lit(False)).withColumn("last_ts", F.lit(None).cast("timestamp"))
    snap.write_epoch(first, state, -1)

    def batch(df: DataFrame, epoch: int) -> None:
        held = snap.latest(spark, state, KEYS, before=epoch, every=merge_every)
        valid, _ = fb.split_valid(df)
        after = fb.state_after(fb.applied(held.where("not removed").drop("removed", "last_ts"), valid))
        after = after.select(*KEYS, F.col("l").alias("_l"), F.col("d").alias("_d"), F.col("removed").alias("_removed"),
                             F.col("last_ts").alias("_ts"))
        rows = held.join(after, KEYS, "left" if snap.merged(epoch, merge_every) else "inner")
        snap.write_epoch(rows.select(
            *KEYS, "matched_item", F.coalesce("_l", "l0").cast("int").alias("l0"),
            F.coalesce("_d", "d0").cast("int").alias("d0"), F.coalesce("_removed", "removed").alias("removed"),
            F.greatest("last_ts", "_ts").alias("last_ts")), state, epoch)

    return (events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def table(spark: SparkSession, crossref: DataFrame, state: str) -> DataFrame:
    """The cross-reference table with the streamed state in it."""
    touched = snap.latest(spark, state, KEYS).where("last_ts is not null")
    return fb.with_state(crossref, touched.select(*KEYS, F.col("l0").alias("l"), F.col("d0").alias("d"), "removed", "last_ts"))
