"""Incremental embedding ingest: progress table (I1-I4), resumable selection
(I5), one-batch processing (I6) and the run report (I7).

The reference walks the source in id order, 100 rows per request, and keeps
a SQLite progress file. Here the unit of work is a whole pending set: one
plan embeds it and appends every row, with its vector or its reject reason, as
one epoch of the outcomes table. Vectors, progress and counts are read from
there; a re-run picks up exactly the rows not yet completed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from altfinder.functions import text as tx
from altfinder.operators import vectors as vx
from altfinder.schemas import PROGRESS_SCHEMA, TEXT_FIELDS
from altfinder.sources import snapshots as snap
from altfinder.sources.catalog import key_range

STATUSES = ("completed", "failed", "skipped")


def record(progress: DataFrame, rows: DataFrame, ts) -> DataFrame:
    """Add (product_id, status, embedding_dimension, text_length) rows;
    one row per product, a repeat replaces the earlier row entirely (both
    timestamps become ``ts``, as an INSERT OR REPLACE does)."""
    ts = F.lit(ts).cast("timestamp")
    new = rows.select(F.col("product_id").cast("long"), "status",
                      F.col("embedding_dimension").cast("int"), F.col("text_length").cast("int"),
                      ts.alias("created_at"), ts.alias("updated_at"), F.lit(1).alias("_new"))
    old = progress.select(*[f.name for f in PROGRESS_SCHEMA.fields]).withColumn("_new", F.lit(0))
    # of two new rows of one product the worse outcome stays
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "skipped", 1).otherwise(2)
    w = Window.partitionBy("product_id").orderBy(F.desc("_new"), rank, F.col("text_length").desc_nulls_last())
    return (new.unionByName(old).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .drop("_rn", "_new"))


def completed(progress: DataFrame) -> DataFrame:
    """Ids whose status is completed (the only status that counts)."""
    return progress.where(F.col("status") == "completed").select("product_id")


def is_processed(progress: DataFrame, ids: DataFrame, id_col: str = "product_id") -> DataFrame:
    """Per requested id, whether it is completed."""
    done = completed(progress).withColumn("processed", F.lit(True))
    return (ids.select(F.col(id_col).alias("product_id")).join(done, "product_id", "left")
            .withColumn("processed", F.coalesce("processed", F.lit(False))))


def high_water_mark(progress: DataFrame) -> DataFrame:
    """Max completed id (null when none)."""
    return completed(progress).agg(F.max("product_id").alias("last_processed_id"))


def progress_stats(progress: DataFrame) -> DataFrame:
    """I4: one row -- total, completed, failed, skipped, high-water mark."""
    st = F.col("status")
    return progress.agg(
        F.count(F.lit(1)).alias("total_processed"),
        *[F.count_if(st == s).alias(s) for s in STATUSES],
        F.max(F.when(st == "completed", F.col("product_id"))).alias("last_processed_id"))


def pending(source: DataFrame, progress: DataFrame, mode: str = "anti", id_col: str = "id",
            limit: int | None = None) -> DataFrame:
    """Rows still to process. ``anti`` (default): every row not
    completed, so failures are retried; ``mark`` (reference): rows above the
    high-water mark only, which is read first (one number), so that it
    reaches the scan as a pushed filter. ``limit`` cuts to the next batch."""
    if mode == "mark":
        mark = high_water_mark(progress).first()[0]
        return key_range(source, -1 if mark is None else mark, limit, id_col)
    done = completed(progress).withColumnRenamed("product_id", id_col)
    rest = source.join(done, id_col, "left_anti")
    return rest if limit is None else rest.orderBy(id_col).limit(limit)


def process(rows: DataFrame, base: str, dim: int, ts, run: int = 0, embedder=None,
            fields: list[str] = TEXT_FIELDS) -> DataFrame:
    """Combined text -> vector or reject reason, appended as epoch ``run``
    of the outcomes table at ``base`` (a repeat of the run replaces it).
    Returns the run's progress rows, read back from what was written.

    Only rows whose vector was written are completed (the reference marks a
    whole batch even when its write failed); rows without text or with a bad
    vector are failed. Each text is embedded once; the counts of the report
    are gathered with ``observe`` during the write."""
    spark = rows.sparkSession
    started = dt.datetime.now()
    emb = vx.embed(rows.withColumn("text_combined", tx.combine_fields(fields)), dim=dim, embedder=embedder)
    emb = vx.check_dimension(emb.withColumnRenamed("reject_reason", "_r0"), dim) \
        .withColumn("reject_reason", F.coalesce("_r0", "reject_reason")).drop("_r0")
    obs = Observation()
    path = snap.write_epoch(
        emb.withColumn("processed_at", F.lit(ts).cast("timestamp"))
        .observe(obs, F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("reject_reason").isNull()).alias("embedded"),
                 F.count_if(F.col("reject_reason").isNotNull()).alias("failed")), base, run)
    snap.write_epoch(run_report(spark, obs.get, started, dt.datetime.now()), reports_path(base), run)
    return progress_rows(spark.read.parquet(path))


def progress_rows(outcomes: DataFrame, *more: Column) -> DataFrame:
    """Progress rows of outcomes; a row without a vector has no dimension."""
    good = F.col("reject_reason").isNull()
    return outcomes.select(
        F.col("id").alias("product_id"), F.when(good, "completed").otherwise("failed").alias("status"),
        F.when(good, F.size("embedding")).cast("int").alias("embedding_dimension"),
        F.length("text_combined").cast("int").alias("text_length"), *more)


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """The vector table: the last vector written of each id (a row that failed
    later keeps the one it had, as in the reference)."""
    good = spark.read.parquet(base).where("reject_reason is null")
    return snap.last_per_key(good, ["id"], F.col("epoch")).drop("epoch", "reject_reason", "processed_at")


def progress(spark: SparkSession, base: str) -> DataFrame:
    """The progress table (I1): each id as its last run left it; of two rows
    of one id in a run the worse outcome."""
    at = F.col("processed_at")
    rows = progress_rows(spark.read.parquet(base), at.alias("created_at"), at.alias("updated_at"), F.col("epoch"))
    return snap.last_per_key(rows, ["product_id"], F.col("epoch"), F.col("status") == "failed").drop("epoch")


def reports_path(base: str) -> str:
    return f"{base.rstrip('/')}-reports"


def run_report(spark: SparkSession, counts: dict, started: dt.datetime, finished: dt.datetime) -> DataFrame:
    """One-row report -- status, start, end, duration, counts, rate."""
    seconds = max((finished - started).total_seconds(), 1e-9)
    row = {"status": "completed", "started_at": started, "finished_at": finished, "duration_s": seconds,
           **{k: int(v) for k, v in counts.items()}, "rate_per_s": float(counts.get("embedded", 0)) / seconds}
    return spark.createDataFrame([row])


def reports(spark: SparkSession, base: str) -> DataFrame:
    """The reports of all runs, one row each."""
    return spark.read.parquet(reports_path(base)).withColumnRenamed("epoch", "run")
