import corpus_pipeline as pipeline

from altfinder.llm import neardup, quality
from altfinder.llm.common import table, word_count, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, held, seen = docs.columns, docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        seen[name] = written(stage(spark, held, SF), "test-stage")
        assert seen[name].columns == columns
        if name == "quality_rules":
            kept = quality.judge(held, table(spark, SF, "labels"))[0].where("kept")
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in seen[name].collect())
        if name == "near_duplicates":
            want = [r.doc_id for r in neardup.link(held).where("kept").collect()]
            assert sorted(want) == sorted(r.doc_id for r in seen[name].collect())
        if name == "secrets":
            assert seen[name].count() == held.count()
            assert not seen[name].where(r"text rlike '[0-9a-f]{32}'").count()
        held = seen[name]
    words = lambda d: d.select(word_count(d.text).alias("n")).agg({"n": "sum"}).first()[0]
    assert abs(words(held) - words(seen["secrets"])) < 0.1 * words(held)
    pieces = pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in held.select("doc_id").collect()}
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
