"""Session construction and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "altfinder") -> SparkSession:
    """A session tuned for the operators here.

    On a cluster the master, memory and checkpoint folder come from the
    submit configuration; only the SQL knobs below are set.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:  # else the submit configuration's number holds
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ALTFINDER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system).
    Only a local master, as in tests, may leave it unset and gets a scratch
    folder; on a cluster a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        # the setting is fixed at start-up (it cannot be changed at run time);
        # only an unset one gets a scratch folder, and only on the context
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = path or tempfile.mkdtemp(prefix="altfinder-ckpt-")
        sc.setCheckpointDir(path)
    return path or sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that a
    job runs from any working folder without an installed package."""
    sc = spark.sparkContext
    if getattr(sc, "_altfinder_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="altfinder-ship-"), "altfinder.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, str(Path(here.name) / file.relative_to(here)))
    sc.addPyFile(path)
    sc._altfinder_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A table as a stream of its files. The path of a stream must be a folder
    or a pattern, and a table may be one file, so it is named by a pattern."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path[:-1] + "[t]")


FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"
ROW_BYTES_PER_FILE_BYTE = "50"  # bytes of rows that a byte of a Parquet file may stand for


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, for a job's own tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a table written as Parquet to
    the shared folder named by ``spark.checkpoint.dir`` and read back, so later
    branches that read it take only the columns and rows they need, do not
    recompute the plan, and a lost executor does not lose it.

    Term counts take a few bytes a row as Parquet and about a hundred as rows.
    The planner goes by the file size when it picks a side to broadcast, and the
    driver builds that side, so the session is told the factor; joins of tables
    that turn out small are still changed to broadcasts by their measured size."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    if float(spark.conf.get(FILE_FACTOR)) == 1.0:  # a number set by the user holds
        spark.conf.set(FILE_FACTOR, ROW_BYTES_PER_FILE_BYTE)
    return spark.read.schema(df.schema).parquet(path)
