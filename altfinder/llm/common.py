"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, \n, \v, \f, \r. On UTF-8
#: bytes this is what ``bytes.split()`` cuts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master, as in tests, may leave it unset; it then gets a
    temporary folder. On a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="altfinder-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *cluster: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back, so
    that later branches neither recompute it nor depend on one executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text (null: 0) as a long, inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) inside its ``group`` of non-null
    columns, by ``order``; rows equal in that are dealt by where they stand.

    The rows are cut into ranges of (group, order) and written once. Counts per
    range and group are summed in range order, rows are numbered inside their
    range, so no task sees a whole group.
    """
    keys = [*[F.col(c) for c in group], *order, F.col("_row")]
    cut = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    ranged = written(cut.withColumn("_range", F.spark_partition_id()), f"numbered-{name}")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order, "_row"))
    return (ranged.withColumn("_in", inside).join(before, [*group, "_range"])
            .withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_row", "_range", "_in", "_before"))


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an unsigned array."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, each word hashed once per worker; emptied
    when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of runs of a row of 64-bit symbol hashes, modulo 2^64."""

    _tables: dict[int, list[np.ndarray]] = {}

    def __init__(self, row: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        self.power, self.back = self._powers(base, len(row) + 1)
        self.sums = np.zeros(len(row) + 1, dtype=np.uint64)
        np.cumsum(row * self.power[:len(row)], out=self.sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> list[np.ndarray]:
        """base^i and base^-i for i below ``n``; the tables grow by doubling
        with the longest row seen."""
        held = cls._tables.get(base)
        if held is None or len(held[0]) < n:
            held = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(1 << max(14, n.bit_length()), b, dtype=np.uint64)
                p[0] = 1
                held.append(np.multiply.accumulate(p))
            cls._tables[base] = held
        return held

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each run [begin, end), told by its symbols and length."""
        return mix64((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Hash of each run of ``n`` symbols."""
        at = np.arange(len(self.sums) - n, dtype=np.int64)
        return self.runs(at, at + n)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of ``edges``
    (a, b). Alternating large-star and small-star steps; a node's neighbours
    meet only in a minimum and a join, never in one list."""
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        n = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = n.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = n.join(low, "a")
        if large:  # neighbours above the node go to its smallest
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return down.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        now = written(star(written(star(now, True), name), False), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
