"""Cleaning, validity and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altfinder.functions import text as tx
from altfinder.schemas import TEXT_FIELDS


def with_reject_reason(df: DataFrame, fields: list[str] = TEXT_FIELDS, id_col: str = "id") -> DataFrame:
    """Cleaned fields plus a ``reject_reason`` (null when the row is
    valid). Computed once, so valid rows, rejects and counts all come from a
    single pass."""
    cleaned = [tx.clean_text(F.col(f)).alias(f) for f in fields]
    out = df.select(F.col(id_col).alias(id_col), *cleaned)
    all_null = F.coalesce(*[F.col(f) for f in fields]).isNull()
    reason = (F.when(F.col(id_col).isNull(), F.lit("missing_id"))
              .when(all_null, F.lit("all_fields_null")))
    return out.withColumn("reject_reason", reason)


def transform(df: DataFrame, fields: list[str] = TEXT_FIELDS, id_col: str = "id") -> DataFrame:
    """Drop rows without id, clean six fields, drop rows with all null."""
    return with_reject_reason(df, fields, id_col).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(df: DataFrame, fields: list[str] = TEXT_FIELDS, id_col: str = "id") -> DataFrame:
    """Rejected rows with their stage and reason."""
    return (with_reject_reason(df, fields, id_col).where(F.col("reject_reason").isNotNull())
            .withColumn("stage", F.lit("transform")))


def transform_counts(df: DataFrame, fields: list[str] = TEXT_FIELDS, id_col: str = "id") -> DataFrame:
    """Rows kept and skipped, by reason (one aggregation)."""
    r = with_reject_reason(df, fields, id_col)
    return (r.groupBy(F.coalesce(F.col("reject_reason"), F.lit("valid")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def field_completeness(df: DataFrame, fields: list[str] = TEXT_FIELDS) -> DataFrame:
    """Per field non-null, null and completeness percent of the cleaned
    value; 0 percent on empty input. One aggregation, then ``stack``."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count(tx.clean_text(F.col(f))).alias(f"_nn_{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    stacked = ", ".join(f"'{f}', _nn_{i}" for i, f in enumerate(fields))
    return (one.selectExpr("_total", f"stack({len(fields)}, {stacked}) AS (field, non_null)")
            .select("field", "non_null",
                    (F.col("_total") - F.col("non_null")).alias("null_count"),
                    F.when(F.col("_total") > 0, F.round(F.col("non_null") * 100.0 / F.col("_total"), 4))
                    .otherwise(F.lit(0.0)).alias("completeness"),
                    F.col("_total").alias("total_records")))


def with_combined_text(df: DataFrame, fields: list[str] = TEXT_FIELDS) -> DataFrame:
    """Combined text plus a failure reason for rows without any."""
    return (df.withColumn("text_combined", tx.combine_fields(fields))
            .withColumn("reject_reason", F.when(F.col("text_combined") == "", F.lit("no_text"))))


def result_projection(hits: DataFrame, docs: DataFrame, fields: list[str] = TEXT_FIELDS,
                      with_id: bool = True, id_col: str = "id") -> DataFrame:
    """Payload columns joined after the top-k, so scoring only moves ids."""
    payload = docs.select(id_col, *fields)
    out = hits.join(payload, id_col, "left")
    return out if with_id else out.drop(id_col)
