from pyspark.sql import functions as F

from altfinder.functions import text as tx


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("o")).first()["o"]


def test_clean_text_null_tokens(spark):
    for v in [None, "null", " N/A ", "None", "\t", "", "NULL"]:
        assert one(spark, tx.clean_text, v) is None, v
    assert one(spark, tx.clean_text, "  pipe  ") == "pipe"
    assert one(spark, tx.clean_text, " fan ") == "fan"


def test_combine_fields_none_only_before_strip(spark):
    df = spark.createDataFrame([(" none ", "None", "A  B", "", None, "x")],
                               "supplier string, brand string, item_number string, catalog_number string, "
                               "description string, item_name string")
    got = df.select(tx.combine_fields().alias("t")).first()["t"]
    # ' none ' is not equal to 'none' before stripping, so it stays (stripped)
    assert got == "none A B x"


def test_standard_terms_keep_repeats_and_drop_stop_words(spark):
    got = one(spark, tx.standard_terms, "The pipe and the PIPE, 3.5 in.")
    assert got == ["pipe", "pipe", "3", "5"]


def test_edge_grams_and_folding(spark):
    assert one(spark, tx.edge_grams, "3.5") == []
    assert one(spark, tx.edge_grams, "Café") == ["ca", "caf", "cafe"]
    assert one(spark, tx.edge_grams, "Straße")[-1] == "strasse"
    long_word = "a" * 20
    assert len(one(spark, tx.edge_grams, long_word)) == 14


def test_fold_table_is_single_letters():
    assert len(tx.FOLD_FROM) == len(tx.FOLD_TO)
    assert all(c.isascii() for c in tx.FOLD_TO)
    assert dict(zip(tx.FOLD_FROM, tx.FOLD_TO))["é"] == "e"
