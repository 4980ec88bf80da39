import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from altfinder.operators import keyword as kw

DOCS = [
    (1, "Carbon steel pipe connector 2 inch diameter"),
    (2, "Stainless steel pipe fitting 1.5 inch premium quality"),
    (3, "Brass elbow joint for plumbing"),
    (4, "Stainless steel coupling heavy duty industrial"),
]


def _bm25_brute(docs, query, stop=True, k1=1.2, b=0.75):
    import math
    import re

    from altfinder.functions.text import STOP_WORDS

    def terms(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return [x for x in w if not (stop and x in STOP_WORDS)]
    dt = {i: terms(t) for i, t in docs}
    n = len(dt)
    avg = sum(map(len, dt.values())) / n
    out = {}
    for i, ws in dt.items():
        s = 0.0
        for q in terms(query):
            tf = ws.count(q)
            if tf:
                df = sum(1 for v in dt.values() if q in v)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / avg))
        if s:
            out[i] = round(s, 4)
    return out


def test_bm25_fixture_scores(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    q = spark.createDataFrame([(0, "stainless steel pipe fitting")], "query_id long, text string")
    idx = kw.KeywordIndex.build(docs, ["text"])
    hits = kw.search(idx, q, ["text"], k=10, fuzzy=False).orderBy("rank").collect()
    got = [(r["id"], r["score"]) for r in hits]
    want = _bm25_brute(DOCS, "stainless steel pipe fitting")
    assert [i for i, _ in got] == [2, 4, 1]          # the reference test expects 2 and 4 on top
    assert dict(got) == want
    assert hits[0]["total_hits"] == 3
    # without stop words the fixture's published numbers come out
    assert _bm25_brute(DOCS, "stainless steel pipe fitting", stop=False) == {2: 2.5933, 4: 1.0998, 1: 1.0342}


def test_blank_query_is_not_scored(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    q = spark.createDataFrame([(0, "   "), (1, None)], "query_id long, text string")
    idx = kw.KeywordIndex.build(docs, ["text"])
    assert kw.search(idx, q, ["text"], k=10).count() == 0
    assert kw.validate_queries(q).where("error IS NOT NULL").count() == 2


def _osa(a, b):
    """Edits with adjacent swaps counted once (optimal string alignment)."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_fuzzy_expansion_equals_brute_force(spark):
    rnd = random.Random(3)
    alpha = "abcde"
    vocab = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 8))) for _ in range(400)})
    terms = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 8))) for _ in range(60)})
    v = spark.createDataFrame([("f", t) for t in vocab], "field string, term string")
    q = spark.createDataFrame([("f", t) for t in terms], "field string, term string")
    for prefix in (0, 2):
        got = {(r["term"], r["match_term"], r["edits"])
               for r in kw.fuzzy_expand(q, v, prefix_length=prefix, max_expansions=10_000).collect()}
        want = set()
        for t in terms:
            k = 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
            for w in vocab:
                if prefix and w[:prefix] != t[:prefix]:
                    continue
                d = _osa(t, w)
                if d <= k:
                    want.add((t, w, d))
        assert got == want


def test_fuzzy_expansion_of_long_terms(spark):
    rnd = random.Random(5)

    def edited(t, n):
        for _ in range(n):
            i, kind = rnd.randrange(len(t)), rnd.randrange(4)
            if kind == 3:
                t = t[:i] + t[i:i + 2][::-1] + t[i + 2:]
            else:
                t = t[:i] + (rnd.choice("ab") if kind else "") + t[i + (kind != 1):]
        return t

    terms = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(16, 60))) for _ in range(40)})
    vocab = sorted({edited(t, n) for t in terms for n in (0, 1, 2, 2, 2, 3)})
    v = spark.createDataFrame([("f", t) for t in vocab], "field string, term string")
    q = spark.createDataFrame([("f", t) for t in terms], "field string, term string")
    want = {(t, w, _osa(t, w)) for t in terms for w in vocab if abs(len(t) - len(w)) <= 2 and _osa(t, w) <= 2}
    for prefix in (0, 2):
        got = {(r["term"], r["match_term"], r["edits"])
               for r in kw.fuzzy_expand(q, v, prefix_length=prefix, max_expansions=10_000).collect()}
        assert got == {x for x in want if x[0][:prefix] == x[1][:prefix]}


def test_swaps_are_one_edit(spark):
    words = ["the", "motor", "receive", "abcdef", "xyabc"]
    v = spark.createDataFrame([("f", w) for w in words], "field string, term string")
    q = spark.createDataFrame([("f", w) for w in ["teh", "mtoor", "recieve", "badcef", "badcfe", "xyca"]], "field string, term string")
    got = {(r.term, r.match_term, r.edits) for r in kw.fuzzy_expand(q, v, prefix_length=0).collect()}
    # three swaps are too many; "ca" to "abc" would edit a swapped pair again
    assert got == {("teh", "the", 1), ("mtoor", "motor", 1), ("recieve", "receive", 1), ("badcef", "abcdef", 2)}
    got = {(r.term, r.match_term) for r in kw.fuzzy_expand(q, v, prefix_length=2).collect()}
    assert got == {("recieve", "receive")}


def test_max_expansions_keeps_best(spark):
    v = spark.createDataFrame([("f", w) for w in ["pipe", "pipes", "piped", "pipex", "pip"]], "field string, term string")
    q = spark.createDataFrame([("f", "pipe")], "field string, term string")
    got = [r["match_term"] for r in kw.fuzzy_expand(q, v, 2, 2).orderBy(F.desc("boost"), "match_term").collect()]
    assert got == ["pipe", "piped"]   # boost 1 - 1/min(len): piped 0.75 beats pip 0.67


def test_results_independent_of_partitioning(spark):
    docs = spark.createDataFrame(DOCS * 1, "id long, text string")
    q = spark.createDataFrame([(0, "steel pipe"), (1, "brass joint")], "query_id long, text string")
    a = kw.search(kw.KeywordIndex.build(docs, ["text"]), q, ["text"], k=3).collect()
    b = kw.search(kw.KeywordIndex.build(docs.repartition(3), ["text"]), q.repartition(2), ["text"], k=3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("k", [1, 3, 7])
def test_pruned_top_k_equals_scoring_every_pair(spark, k):
    """Few distinct words, so that values repeat, scores tie and the cut at k
    goes through groups of equal documents."""
    rng = random.Random(k)
    words = ["steel", "pipe", "brass", "in", "elbow", "elbows", "8", "12", "duct"]
    name = lambda: " ".join(rng.choices(words, [9, 9, 3, 30, 2, 1, 4, 2, 1], k=rng.randint(1, 5)))
    rows = [(i, name(), rng.choice([None, "steel", "ducts co", name()])) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    q = spark.createDataFrame([(i, name()) for i in range(30)] + [(30, "zzz"), (31, ""), (32, None)],
                              "query_id long, text string")
    index = kw.KeywordIndex.build(docs, ["a", "b"], edge=True)
    full = kw.search(index, q, ["a", "b"], k=k, edge=True)
    pruned = kw.search(index, q, ["a", "b"], k=k, edge=True, with_total=False)
    cols = ["query_id", "rank", "id", "score", "best_field"]
    want = sorted(map(tuple, full.select(cols).collect()))
    assert sorted(map(tuple, pruned.select(cols).collect())) == want and len(want) == 30 * k


def test_index_tasks_follow_the_documents_and_pairs_are_dealt_before_sums(spark, monkeypatch):
    monkeypatch.setattr(kw, "DOCS_PER_TASK", 10)
    docs = spark.range(200).select("id", F.concat(F.lit("steel pipe w"), F.col("id") % 9).alias("text"))
    assert kw._term_counts(docs, ["text"], "id", False).rdd.getNumPartitions() == 20
    queries = docs.where("id < 5").select(F.col("id").alias("query_id"), "text")
    hits = kw.search(kw.KeywordIndex.build(docs, ["text"]), queries, ["text"], k=3, fuzzy=False)
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2  # the hits and the totals
    assert {r["total_hits"] for r in hits.collect()} == {200}


def test_pruned_top_k_writes_few_pairs(spark, monkeypatch):
    """Values that share a frequent term with every query are ranked where
    they meet: the pairs are neither written nor dealt out one by one."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, f"{words[i % 40]} {words[i * 7 % 40]} {words[i * i % 40]} x{i}") for i in range(600)],
                                 "id bigint, name string")
    queries = spark.createDataFrame([(i, f"{words[i % 40]} {words[i * 3 % 40]} {words[i * 11 % 40]}") for i in range(200)],
                                    "query_id bigint, text string")
    index = kw.KeywordIndex.build(docs, ["name"])
    weighted = kw.weighted_terms(index, kw.query_terms(queries, ["name"]), fuzzy=False)
    pairs = kw.score_pairs(index, weighted, ["name"]).withColumn("score", F.round("score", 4))
    want = sorted(map(tuple, kw.top_k(pairs, 3).select("query_id", "rank", "id", "score").collect()))
    written = []

    def told(df):
        out = real(df)
        if "vid" in out.columns and "sq" in out.columns:
            written.append(out.count())
        return out
    real = kw.materialize
    monkeypatch.setattr(kw, "materialize", told)
    got = sorted(map(tuple, kw.pruned_top_k(index, weighted, 3).select("query_id", "rank", "id", "score").collect()))
    assert got == want
    assert written and max(written) * 3 < pairs.count()
    # the same over many small tiles
    monkeypatch.setattr(kw, "TILE_QUERIES", 20, raising=False)
    monkeypatch.setattr(kw, "TILE_VALUES", 60, raising=False)
    assert sorted(map(tuple, kw.pruned_top_k(index, weighted, 3).select("query_id", "rank", "id", "score").collect())) == want


@pytest.mark.parametrize("tile", [None, 7])
def test_totals_from_tiles_equal_scoring_every_pair(spark, monkeypatch, tile):
    """Repeated and null document ids, classes of equal documents, ties."""
    rng = random.Random(3)
    words = ["steel", "pipe", "brass", "in", "elbow", "elbows", "8", "12", "duct"]
    name = lambda: " ".join(rng.choices(words, [9, 9, 3, 30, 2, 1, 4, 2, 1], k=rng.randint(1, 5)))
    rows = [(None if i % 23 == 5 else i % 90, name(), rng.choice([None, "steel", name()])) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    queries = spark.createDataFrame([(i, name()) for i in range(30)] + [(30, "zzz"), (31, ""), (None, "steel")],
                                    "query_id long, text string")
    index = kw.KeywordIndex.build(docs, ["a", "b"], edge=True)
    fields = ["a", "b", "a.edge", "b.edge"]
    weighted = kw.weighted_terms(index, kw.query_terms(queries, ["a", "b"], edge=True))
    pairs = kw.score_pairs(index, weighted, fields).withColumn("score", F.round("score", 4))
    totals = pairs.groupBy("query_id").agg(F.count("score").alias("total_hits"))
    cols = ["query_id", "rank", "id", "score", "best_field", "total_hits"]
    want = sorted(map(str, kw.top_k(pairs, 4).join(totals, "query_id").select(cols).collect()))
    if tile:
        monkeypatch.setattr(kw, "TILE_QUERIES", tile)
        monkeypatch.setattr(kw, "TILE_VALUES", tile)
    written = []

    def told(df):
        out = real(df)
        written.append(out.count())
        return out
    real = kw.materialize
    monkeypatch.setattr(kw, "materialize", told)
    hits = kw.search(index, queries, ["a", "b"], k=4, edge=True)
    assert sorted(map(str, hits.select(cols).collect())) == want and len(want) == 120
    assert "query_id" not in index.postings.columns and "sha2" not in want[0]
    shuffled = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "match_term" not in shuffled  # the pairs were scored in the tiles, not in the plan of the hits


def test_pairs_of_one_field_are_summed_in_tasks_of_bounded_size(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    q = spark.createDataFrame([(n, "steel pipe fitting") for n in range(20)], "query_id long, text string")
    index = kw.KeywordIndex.build(docs, ["text"])
    weighted = kw.weighted_terms(index, kw.query_terms(q, ["text"]), fuzzy=False)
    monkeypatch.setattr(kw, "PAIRS_PER_TASK", 10)
    pairs = kw.score_pairs(index, weighted, ["text"])
    # steel is in three documents, pipe in two, fitting in one: 20 x 6 sums, 10 to a task
    assert pairs.rdd.getNumPartitions() == 12
    assert pairs.count() == 20 * 3


def test_totals_send_no_row_once_per_block(spark, monkeypatch):
    """rows of terms went once to every tile, so disk grew with the square."""
    from altfinder.operators import blocks as bk

    words = ["steel", "pipe", "brass", "in", "elbow", "duct"]
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4)), f"{i} {words[i % 6]}") for i in range(150)], "id long, a string, b string")
    queries = docs.select(F.col("id").alias("query_id"), F.concat_ws(" ", "a", "b").alias("text"))
    index = kw.KeywordIndex.build(docs, ["a", "b"])
    monkeypatch.setattr(kw, "TILE_QUERIES", 10)
    monkeypatch.setattr(kw, "TILE_VALUES", 10)
    plans, sides = [], []
    real, met = kw.materialize, bk.met

    def told(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    def watched(first, second, *rest):
        sides.append((first.count(), first.distinct().count(), second.count(), second.distinct().count()))
        return met(first, second, *rest)
    monkeypatch.setattr(kw, "materialize", told)
    monkeypatch.setattr(bk, "met", watched)
    assert kw.search(index, queries, ["a", "b"], k=3).count() == 450
    assert not any("CoGroup" in plan for plan in plans)
    (q, q_once, v, v_once), = sides
    assert (q, v) == (q_once, v_once)


def test_common_terms_are_added_as_rare_ones(monkeypatch):
    rnd = np.random.default_rng(6)
    for least in (-1.0, 0.0, 0.5):  # weights of both signs, none, and all above it
        terms, scores = 40, []
        sides = []
        for n in (30, 50):
            at = rnd.random((n, terms)) < np.linspace(0.005, 0.9, terms)
            member, term = np.nonzero(at)
            weight = np.where(rnd.random(len(member)) < 0.2, least, least + rnd.random(len(member)))
            sides += kw._grouped(member, term, weight, terms)
        for dense in (1 << 40, 64, 0):
            monkeypatch.setattr(kw, "DENSE", dense or 1)
            found, hit = np.zeros((30, 50)), np.zeros((30, 50), bool)
            kw._added(found, *sides, hit)
            scores.append((found, hit))
        for found, hit in scores[1:]:
            assert np.allclose(found, scores[0][0], atol=1e-12) and (hit == scores[0][1]).all()


def test_totals_keep_a_bounded_number_of_equal_classes():
    q = {"sq": np.array([4, 9]), "f": np.zeros(2, np.int32), "t": np.array([1, 2]), "qw": np.ones(2)}
    best = kw._Totals(q, 3, 2e-4)
    for lo in (500, 0):  # the better ones come last
        vid = np.arange(lo, lo + 500)
        block = {"vid": vid, "n": np.ones(500, np.int64), "f": np.zeros(500, np.int32), "t": np.ones(500, np.int64), "w": np.full(500, 2.0)}
        best.meet(block, np.arange(500), vid)
    sq, vid, score, of, n = best.pairs()
    assert list(zip(sq, vid, score, n)) == [(4, 0, 2.0, 1), (4, 1, 2.0, 1), (4, 2, 2.0, 1), (4, kw.NO_ID, 0.0, 1000)]


def test_hits_below_another_fields_k_best_are_not_sent_on(spark, monkeypatch):
    """Each field query's k best went on to every query, whatever the other fields had."""
    rows = [(i, "valve" if i < 5 else "pipe", None if i < 20 else "steel brass" if i < 40 else "steel") for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, a string, b string")
    queries = spark.createDataFrame([(1, "valve steel"), (2, "valve brass"), (3, "zzz")], "query_id long, text string")
    index = kw.KeywordIndex.build(docs, ["a", "b"])
    weighted = kw.weighted_terms(index, kw.query_terms(queries, ["a", "b"]), fuzzy=False)
    pairs = kw.score_pairs(index, weighted, ["a", "b"]).withColumn("score", F.round("score", 4))
    want = sorted(map(str, kw.top_k(pairs, 4).select("query_id", "id", "score", "best_field", "rank").collect()))
    sent, real = [], kw.top_k
    monkeypatch.setattr(kw, "top_k", lambda pairs, k: sent.append(pairs.count()) or real(pairs, k))
    got = kw.pruned_top_k(index, weighted, 4).select("query_id", "id", "score", "best_field", "rank")
    assert sorted(map(str, got.collect())) == want
    assert sent == [8]
