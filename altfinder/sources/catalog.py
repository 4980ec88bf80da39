"""Catalogue sources: key-range scan (S2), profile (S3) and the
catalogue shape derived from the driver's part / lineitem / supplier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from altfinder.session import read_table


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows (id + six text fields) from part, lineitem, supplier.

    Each part's supplier is the one that shipped the largest quantity of it
    (ties to the lower key). Every tenth description is a null token and every
    thirteenth brand is blank, so the cleaner has work to do."""
    part = read_table(spark, sf_dir, "part")
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    qty = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("qty"), F.asc("l_suppkey"))
    top = qty.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    p = part.alias("p")
    size = F.col("p.p_size").cast("string")
    return (
        p.join(top, F.col("l_partkey") == F.col("p.p_partkey"), "left")
        .join(sup, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.col("p.p_partkey").alias("id"),
            F.concat(F.lit("IT"), F.lpad(F.col("p.p_partkey").cast("string"), 6, "0")).alias("item_number"),
            F.concat(F.col("p.p_name"), F.lit(" "), size, F.lit(" in.")).alias("item_name"),
            F.when(F.col("p.p_partkey") % 13 == 0, F.lit("  ")).otherwise(F.col("p.p_brand")).alias("brand"),
            F.concat(F.col("p.p_type"), F.lit("-"), size).alias("catalog_number"),
            F.when(F.col("p.p_partkey") % 10 == 0, F.lit(" N/A "))
            .otherwise(F.concat(F.col("p.p_type"), F.lit(" "), F.col("p.p_name"))).alias("description"),
            F.col("s_name").alias("supplier"),
        )
    )


INVENTORY_SQL = """
WITH sup AS (
  SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_partkey, l_suppkey
), top_sup AS (
  SELECT l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_partkey ORDER BY qty DESC, l_suppkey) AS rn
  FROM sup
)
SELECT p.p_partkey AS id,
       concat('IT', lpad(CAST(p.p_partkey AS VARCHAR), 6, '0')) AS item_number,
       concat(p.p_name, ' ', CAST(p.p_size AS VARCHAR), ' in.') AS item_name,
       CASE WHEN p.p_partkey % 13 = 0 THEN '  ' ELSE p.p_brand END AS brand,
       concat(p.p_type, '-', CAST(p.p_size AS VARCHAR)) AS catalog_number,
       CASE WHEN p.p_partkey % 10 = 0 THEN ' N/A '
            ELSE concat(p.p_type, ' ', p.p_name) END AS description,
       s.s_name AS supplier
FROM part p
LEFT JOIN top_sup t ON t.l_partkey = p.p_partkey AND t.rn = 1
LEFT JOIN supplier s ON s.s_suppkey = t.l_suppkey
"""


def key_range(df: DataFrame, after_id, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows with id above the mark, ordered; with a limit this plans as a
    TakeOrderedAndProject (a per-partition top-n, no full sort)."""
    out = df.where(F.col(id_col) > F.lit(after_id))
    if limit is not None:
        out = out.orderBy(id_col).limit(limit)
    return out


def profile(df: DataFrame) -> DataFrame:
    """S3: one row per column (position, name, type) with the table row count."""
    spark = df.sparkSession
    cols = spark.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, data_type string")
    total = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("_k", F.lit(1))
    return cols.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
