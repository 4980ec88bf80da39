"""Tables that are small as files and large as rows."""

from pyspark.sql import functions as F

from altfinder.session import materialize


def test_written_table_is_not_broadcast_by_its_file_size(spark):
    rows = spark.range(300_000).select("id", F.concat(F.lit("prefix-of-a-long-term-"), F.col("id") % 7).alias("term"))
    table = materialize(rows)
    other = materialize(rows.withColumnRenamed("id", "other"))
    plan = table.join(other, F.col("id") == F.col("other"))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_a_small_table_is_embedded_on_all_cores(spark):
    from altfinder.plans import substitutes as sb
    from altfinder.schemas import TEXT_FIELDS

    rows = spark.range(0, 500, 1, 1).select("id", *[F.concat(F.lit(f"{f} "), "id").alias(f) for f in TEXT_FIELDS])
    assert sb._embedded(rows, 8, None).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_candidates_are_planned_without_the_steps_of_their_legs(spark):
    from altfinder.plans import substitutes as sb
    from altfinder.schemas import TEXT_FIELDS

    raw = spark.range(6).select("id", *[F.concat(F.lit(f"steel {f} "), "id").alias(f) for f in TEXT_FIELDS])
    sources = raw.select(F.col("id").alias("query_id"), F.col("item_name").alias("query_text"))
    found = sb.candidates(raw, sb.Legs.build(raw, 8), sources, top_k=2, dim=8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan  # the vector leg's tiles
    assert "WindowGroupLimit" not in plan and found.where("in_vector").count() == 24


def test_the_vector_leg_compares_all_pairs_at_any_size(spark):
    """Beyond a number of pairs the leg went through codes."""
    import inspect

    import numpy as np

    from altfinder.operators import vectors as vx
    from altfinder.plans import substitutes as sb
    from altfinder.schemas import TEXT_FIELDS

    raw = spark.range(400).select("id", *[F.concat(F.lit(f"{f} "), F.md5(F.concat(F.lit(f), "id"))).alias(f) for f in TEXT_FIELDS])
    rnd = np.random.default_rng(2)
    vectors = {i: rnd.normal(size=24).tolist() for i in range(400)}
    legs = sb.Legs.build(raw, 24, lambda texts: np.array([np.random.default_rng(len(t) + sum(map(ord, t))).normal(size=24) for t in texts]))
    legs.vectors = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>")
    sources = raw.where("id < 40").select(F.col("id").alias("query_id"), F.col("item_name").alias("query_text"))

    def embedder(texts):
        return np.array([np.random.default_rng(sum(map(ord, t))).normal(size=24) for t in texts])
    switch = {"exact_pairs": 0} if "exact_pairs" in inspect.signature(sb.candidates).parameters else {}
    found = sb.candidates(raw, legs, sources, top_k=2, dim=24, embedder=embedder, **switch)
    texts = {r.query_id: r.query_text for r in sources.collect()}
    asked = vx._unit(embedder(list(texts.values())).astype(np.float32))
    scores = np.round(asked @ vx._unit(np.array(list(vectors.values()))).T, 6)
    want = {(q, int(j)) for q, row in zip(texts, scores) for j in np.lexsort((np.arange(400), -row))[:4]}
    assert {(r.query_id, r.id) for r in found.where("in_vector").collect()} == want
