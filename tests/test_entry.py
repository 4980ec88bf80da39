import __spark_entry__ as ent


def test_registry_shapes():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    assert {"substitutes_inventory", "rule_scores_by_group"} <= set(q)


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == [f.name for f in ent.entry(spark).schema.fields]
