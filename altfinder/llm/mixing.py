"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated up to a
number of epochs. A document's virtual finish time is the source's words up to
and with it, divided by the source's target; all documents are range-sorted by
it and the mix is cut where the total budget is reached. Everything is
DataFrame work: the running sums go in two steps (sums per bucket, then inside
a bucket), so a source with a third of all rows is never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) per source.

    Sources, ordered by code point with null last, weigh 1, 2, 3, repeating,
    and share all words; a target stops at ``max_epochs`` times its source's
    words and the excess goes to the others by weight. The level is found in
    closed form over sources sorted by limit per weight. The table has one row
    per source, so its windows are small next to the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"))
    limit = F.col("source_size").cast("double") * max_epochs
    rank = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    upto = rank.rowsBetween(Window.unboundedPreceding, -1)
    rest = rank.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    levels = (per.withColumn("ratio", limit / F.col("weight"))
              .withColumn("limits_before", F.coalesce(F.sum(limit).over(upto), F.lit(0.0)))
              .withColumn("weights_from", F.sum("weight").over(rest))
              .withColumn("budget", F.sum("source_size").over(all_rows).cast("double"))
              .withColumn("level", (F.col("budget") - F.col("limits_before")) / F.col("weights_from")))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)
    return levels.select("source", "source_size",
                         F.least(F.coalesce(found["level"], F.lit(0.0)) * F.col("weight"), limit).alias("target"))


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same ``keys`` up to
    and with this one, ordered by ``bucket`` (which splits a key into pieces of
    bounded size), then ``order``. Only bucket sums meet in one window."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for k in (*keys, bucket):
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = df.alias("l").join(offsets.alias("r"), same).select(*[f"l.{c}" for c in df.columns], "r._before")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_before")


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 17, rows_per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, size, source, source_size, target, epochs, taken) per row.

    ``epochs`` is how often the mix takes the document and ``taken`` is epochs
    times size. A source's words come within half a document of its share of
    the mix. The order is a hash of doc_id and text under ``seed``, so reruns
    agree; rows with the same doc_id, text and source are taken alike. Null
    and empty texts have size 0 and are never taken; a null source is a
    source. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", *_keys(docs, seed), word_count(F.col("text")).alias("size")), "mix-sizes")
    per = mix_epochs(sized, max_epochs, rows_per_bucket)
    out = sized.alias("a").join(per.alias("b"), _same("a", "b"))
    return out.select("a.doc_id", "a.size", "a.source", "b.source_size", "b.target", "b.epochs",
                      (F.col("b.epochs") * F.col("a.size")).alias("taken"))


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    return [F.col("source").cast("string").alias("source"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("shuffle")]


def _same(a: str, b: str) -> Column:
    return ((F.col(f"{a}.shuffle") == F.col(f"{b}.shuffle")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
            & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")))


def mix_epochs(sized: DataFrame, max_epochs: int, rows_per_bucket: int) -> DataFrame:
    """(doc_id, source, shuffle, source_size, target, epochs) per distinct
    (doc_id, source, shuffle) of ``sized``, whose equal rows queue together."""
    targets = source_targets(sized, max_epochs)
    units = sized.groupBy("doc_id", "source", "shuffle").agg(F.sum("size").alias("words"))
    n = sized.count()
    bits = max(0, math.ceil(math.log2(max(1, n / rows_per_bucket))))
    # the top bits of the hash: equal stretches of the shuffled order
    bucket = F.shiftrightunsigned("shuffle", 64 - bits) if bits else F.lit(0).cast("long")
    queued = running_sum(units.withColumn("bucket", bucket), ["source"], "bucket",
                         [F.col("shuffle"), F.col("doc_id")], "words", "upto")
    queued = queued.alias("q").join(targets.alias("t"), F.col("q.source").eqNullSafe(F.col("t.source"))).select(
        "q.*", "t.source_size", "t.target")
    queued = written(queued.select("doc_id", "source", "shuffle", "words", "source_size", "target",
                                   (F.col("upto") - F.col("words") / F.lit(2.0)).alias("middle")), "mix-queue")
    cut = _cut(queued, max_epochs)
    # epoch e (from 0) is taken when its middle is served by the cut: e * source_size + middle <= cut * target
    times = F.floor((F.lit(cut) * F.col("target") - F.col("middle")) / F.greatest("source_size", F.lit(1))) + 1
    epochs = F.when(F.col("words") > 0, F.least(F.greatest(times, F.lit(0)), F.lit(max_epochs))).otherwise(F.lit(0))
    return queued.select("doc_id", "source", "shuffle", "source_size", "target", epochs.cast("long").alias("epochs"))


def _cut(queued: DataFrame, max_epochs: int, bins: int = 4096) -> float:
    """The virtual time at which the words served reach the budget (all words).

    A document's time is that of its middle word, so a cut through it takes it
    or leaves it by the larger half. Every (document, epoch) falls into one of
    ``bins`` equal ranges of time; the range sums are a table of bounded size
    whose running total tells the range of the cut, and a second pass inside
    that range alone the cut itself to a part in ``bins`` squared.
    """
    time = (F.col("e") * F.col("source_size") + F.col("middle")) / F.nullif(F.col("target"), F.lit(0.0))
    served = (queued.where("words > 0")
              .select("words", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("e"),
                      "middle", "source_size", "target")
              .select("words", time.alias("time")))
    budget = queued.agg(F.sum("words")).first()[0] or 0
    low, width, before = 0.0, 2.0, 0
    for _ in range(2):
        step = width / bins
        ranges = (served.where((F.col("time") > low) & (F.col("time") <= low + width))
                  .groupBy(F.ceil((F.col("time") - low) / step).alias("k")).agg(F.sum("words").alias("words"))
                  .orderBy("k").collect())
        for row in ranges:
            if before + row["words"] >= budget:
                low, width = low + (row["k"] - 1) * step, step
                break
            before += row["words"]
        else:
            return 1.0
    return low + width


def mixed(docs: DataFrame, max_epochs: int = 3, seed: int = 17, rows_per_bucket: int = 20_000) -> DataFrame:
    """The documents the mix takes, each row as often as it takes it, with all
    the columns of ``docs``. The texts meet their counts in one join."""
    sized = written(docs.select("doc_id", *_keys(docs, seed), word_count(F.col("text")).alias("size")), "mix-sizes")
    per = mix_epochs(sized, max_epochs, rows_per_bucket).where("epochs > 0")
    keys = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *_keys(docs, seed))
    out = keys.alias("a").join(per.alias("b"), _same("a", "b"))
    return out.select("a.row", F.explode(F.sequence(F.lit(1), F.col("b.epochs")))).select("row.*")
