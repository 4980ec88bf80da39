"""Shards of nearly equal bytes by longest-processing-time scheduling.

Documents with the same text are one group and stay together. Groups of at
least one part in ``units`` of all bytes are units of their own (at most
``units`` of them, by arithmetic); smaller groups are gathered into ``units``
buckets by a hash of their digest, and each bucket is a unit. So the scheduler
sees at most 2 x ``units`` numbers however large the table is: it takes them
largest first and gives each to the least-loaded shard, kept in a heap. The
loads then differ by about the smallest units, a few parts in ``units``, unless
one group alone is larger than a shard's share.

Texts are read once, for their digests; what moves is one small row a document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

ROW_BYTES = 16  # what a row costs beside its text
UNITS = 20_000


def schedule(loads: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """(unit, shard) for (unit, size): largest first (ties by name), each to
    the least-loaded shard (ties to the smallest number)."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for unit, size in sorted(loads, key=lambda u: (-u[1], u[0])):
        load, s = heap[0]
        out.append((unit, s))
        heapq.heapreplace(heap, (load + size, s))
    return out


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _digest() -> Column:
    return F.sha2(_text(), 256)


def _bucket(digest: Column, units: int) -> Column:
    return F.concat(F.lit("~"), F.pmod(F.xxhash64(digest), F.lit(units)).cast("string"))


def plan_units(rows: DataFrame, shards: int, units: int) -> DataFrame:
    """(unit, shard) for ``rows`` (digest, size): at most 2 x ``units`` rows.
    A unit is a group's digest, or the bucket of the groups that are smaller."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes").cast("decimal(38,0)") * units >= F.lit(total).cast("decimal(38,0)")
    unit = F.when(large, F.col("digest")).otherwise(_bucket(F.col("digest"), units))
    sums = groups.groupBy(unit.alias("unit")).agg(F.sum("bytes").alias("bytes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [u for b in batches for u in zip(b["unit"].tolist(), b["bytes"].tolist(), strict=True)]
        if loads:
            yield pd.DataFrame(schedule(loads, shards), columns=["unit", "shard"])

    return written(sums.coalesce(1).mapInPandas(run, "unit string, shard int"), "shards-plan")


def _placed(rows: DataFrame, plan: DataFrame, units: int) -> DataFrame:
    """``rows`` (with their digest) and their shard. The plan's size is bounded
    by 2 x ``units``, so it is broadcast."""
    own = F.broadcast(plan.select(F.col("unit").alias("digest"), F.col("shard").alias("_own")))
    shared = F.broadcast(plan.select(F.col("unit").alias("_bucket"), F.col("shard").alias("_shared")))
    return (rows.withColumn("_bucket", _bucket(F.col("digest"), units)).join(own, "digest", "left").join(shared, "_bucket", "left")
            .withColumn("shard", F.coalesce("_own", "_shared")).drop("_own", "_shared", "_bucket"))


def assign(docs: DataFrame, shards: int = 40, units: int = UNITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``.

    size is the text's UTF-8 bytes plus 16. Rows with equal texts share a
    shard; a null text counts as empty, and nulls and empty texts are one
    group. slot numbers a shard's rows from 0 without gaps, by the text's
    digest, then doc_id (null first), so equal texts stand side by side;
    repeated rows get a slot each. Reruns agree, but for the slots of rows
    equal in both. An empty table gives no rows; other columns are ignored.
    """
    rows = written(docs.select("doc_id", (F.octet_length(_text()) + ROW_BYTES).cast("long").alias("size"),
                               F.crc32(_text().cast("binary")).alias("text_crc32"), _digest().alias("digest")), "shards-rows")
    placed = _placed(rows, plan_units(rows, shards, units), units)
    return numbered(placed, ["shard"], [F.col("digest"), F.col("doc_id")], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, units: int = UNITS, files_per_shard: int = 8) -> None:
    """The rows of ``docs``, all columns, as Parquet under ``path`` in one folder
    a shard (``shard=0`` ...). A shard's rows are split over ``files_per_shard``
    tasks, so that no task writes a whole shard; equal texts share the folder, not always the file."""
    if "shard" in docs.columns:
        raise ValueError("the documents have a column named shard already")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _digest().alias("digest"),
                       (F.octet_length(_text()) + ROW_BYTES).cast("long").alias("size"))
    sized = written(rows.select("digest", "size"), "shards-sizes")
    out = _placed(rows, plan_units(sized, shards, units), units).select("row.*", "shard")
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    out.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)
