"""Keyed tables.

``keyed_merge`` is the merge itself; ``keyed_write`` writes its result and the
rejects to folders that the caller names. A table that grows by runs or
micro-batches is a folder of epochs: each run appends what it changed as
``epoch=N`` and overwrites only that when it is repeated, ``latest`` reads one
row per key, and ``merged`` says which epochs hold a whole table, so that
reading never goes back further than a fixed number of epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_EVERY = 20


def epoch_path(base: str, epoch: int) -> str:
    return f"{base.rstrip('/')}/epoch={epoch}"


def write_epoch(df: DataFrame, base: str, epoch: int) -> str:
    """Write what one run or micro-batch changed; a repeat replaces it."""
    path = epoch_path(base, epoch)
    df.write.mode("overwrite").parquet(path)
    return path


def merged(epoch: int, every: int = MERGE_EVERY) -> bool:
    """Whether this epoch is written as a whole table."""
    return epoch % every == 0


def latest(spark: SparkSession, base: str, keys: list[str], before: int | None = None,
           every: int | None = None) -> DataFrame:
    """One row per key, from the last epoch that has it. ``before`` leaves out
    that epoch and later ones; with ``every`` the epochs before the last whole
    table are not read either."""
    rows = spark.read.parquet(base)
    if before is not None:
        rows = rows.where(F.col("epoch") < before)
        if every:
            rows = rows.where(F.col("epoch") >= max((before - 1) // every * every, -1))
    return last_per_key(rows, keys, F.col("epoch")).drop("epoch")


def last_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the last in ``order``; rows that tie there are told
    apart by their values. Grouped, so Spark merges before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")


def keyed_merge(old: DataFrame | None, new: DataFrame, key: str = "id", *, order_col: str,
                recreate: bool = False) -> DataFrame:
    """Last write per key wins. ``new`` rows win over ``old``; within
    ``new`` the highest ``order_col`` wins (load order), which is not kept.
    ``recreate`` drops the old table (rebuild mode)."""
    rows = new.withColumn("_load", F.struct(F.lit(1), F.col(order_col).cast("long"))).drop(order_col)
    if old is not None and not recreate:
        columns = [c for c in rows.columns if c in old.columns]
        kept = old.select(*columns).withColumn("_load", F.struct(F.lit(0), F.lit(None).cast("long")))
        rows = rows.unionByName(kept, allowMissingColumns=True)
    return last_per_key(rows, [key], F.col("_load")).drop("_load")


def keyed_write(old: DataFrame | None, new: DataFrame, path: str, rejects_path: str, key: str = "id", *,
                order_col: str, recreate: bool = False, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """S4/S5 with rejects: rows failing ``valid`` (or without a key) go to
    ``rejects_path``, the merged table to ``path``; both are replaced, so a
    repeat leaves the same. Returns (table, rejects), read back."""
    spark = new.sparkSession
    good = F.col(key).isNotNull() if valid is None else F.col(key).isNotNull() & F.coalesce(valid, F.lit(False))
    keyed_merge(old, new.where(good), key, order_col=order_col, recreate=recreate).write.mode("overwrite").parquet(path)
    new.where(~good).write.mode("overwrite").parquet(rejects_path)
    return spark.read.parquet(path), spark.read.parquet(rejects_path)


def verify(table: DataFrame, expected_schema, expected_count: int | None = None) -> DataFrame:
    """One row -- row count, whether it equals the expected count, and
    whether the schema has the expected fields and types."""
    got = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected_schema.fields}
    schema_ok = all(got.get(k) == v for k, v in want.items())
    c = table.agg(F.count(F.lit(1)).alias("document_count"))
    c = c.withColumn("schema_ok", F.lit(schema_ok))
    if expected_count is not None:
        c = c.withColumn("count_ok", F.col("document_count") == F.lit(expected_count))
    return c
