"""Fixed field lists and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The six catalogue text fields, in the order the reference
# indexes and combines them (supplier, brand, item number, catalogue number,
# description, name).
TEXT_FIELDS = ["supplier", "brand", "item_number", "catalog_number", "description", "item_name"]

# Fields that also carry an exact-value (keyword) form.
KEYWORD_FIELDS = ["supplier", "brand", "item_number", "catalog_number"]

# Fields of an uploaded row; the item number is required.
UPLOAD_FIELDS = ["item_number", "item_name", "brand", "catalog_number", "description", "supplier"]

CATALOG_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), True)]
    + [T.StructField(f, T.StringType(), True) for f in TEXT_FIELDS]
)

MATCH_STRUCT = T.StructType([
    T.StructField("r", T.StringType(), True),
    T.StructField("l", T.IntegerType(), True),
    T.StructField("d", T.IntegerType(), True),
])
MATCH_ARRAY = T.ArrayType(MATCH_STRUCT)

CROSSREF_SCHEMA = T.StructType([
    T.StructField("item_number", T.StringType(), False),
    T.StructField("matches", MATCH_ARRAY, True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

PROGRESS_SCHEMA = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("embedding_dimension", T.IntegerType(), True),
    T.StructField("text_length", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("source_item", T.StringType(), True),
    T.StructField("matched_item", T.StringType(), True),
    T.StructField("feedback", T.StringType(), True),
])
