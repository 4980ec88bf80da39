import numpy as np
from pyspark.sql import functions as F

from altfinder.operators import codes
from altfinder.operators import vectors as vx


def _vectors(spark, n=120, dim=8, seed=1):
    rnd = np.random.default_rng(seed)
    m = rnd.normal(size=(n, dim)).astype(np.float32)
    m[5] = m[7]  # an exact tie
    rows = [(i, [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>"), m


def _brute(m, k):
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for q in range(len(m)):
        order = sorted(range(len(m)), key=lambda j: (-s[q, j], j))[:k]
        out[q] = [(j, s[q, j]) for j in order]
    return out


def test_knn_equals_brute_force(spark):
    v, m = _vectors(spark)
    q = v.withColumnRenamed("id", "query_id")
    want = _brute(m, 5)
    for kwargs in ({}, {"q_block_rows": 16, "v_block_rows": 16}):
        got = {}
        for r in vx.knn(q, v, k=5, **kwargs).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["cosine"]))
        for qid, lst in got.items():
            assert [(i, c) for _, i, c in sorted(lst)] == [(i, c) for i, c in want[qid]]


def test_ivf_with_all_cells_probed_is_exact(spark):
    v, m = _vectors(spark, n=80)
    q = v.withColumnRenamed("id", "query_id")
    approx = vx.knn_ivf(q, v, k=5, centres=vx.sample_centres(v, 4), nprobe=4)
    exact = vx.knn(q, v, k=5)
    rec = vx.recall_at_k(approx, exact).select("mean_recall").first()[0]
    assert rec == 1.0


def test_dimension_and_zero_checks(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)],
                               "id long, embedding array<float>")
    got = {r["id"]: r["reject_reason"] for r in vx.check_dimension(df, 2).collect()}
    assert got == {1: None, 2: "zero_vector", 3: "wrong_dimension", 4: "no_vector"}


def test_embed_blank_and_hook(spark):
    df = spark.createDataFrame([(1, "steel pipe"), (2, "   ")], "id long, text_combined string")
    e = {r["id"]: r for r in vx.embed(df, dim=16).collect()}
    assert e[1]["reject_reason"] is None and len(e[1]["embedding"]) == 16
    assert e[2]["embedding"] is None and e[2]["reject_reason"] == "no_text"
    hook = vx.embed(df, dim=3, embedder=lambda texts: np.ones((len(texts), 3)))
    h = {r["id"]: r for r in hook.collect()}
    assert list(h[1]["embedding"]) == [1.0, 1.0, 1.0] and h[2]["embedding"] is None


def test_codes_stand_for_their_vectors():
    rnd = np.random.default_rng(4)
    unit = vx._unit(rnd.normal(size=(600, 10)))
    centres = codes._kmeans(unit, 7)
    book = codes.Codebook(centres, np.zeros((3, codes.BOOK, 4)))
    rest = book.padded(unit - centres[np.argmax(unit @ centres.T, axis=1)])
    for p in range(3):
        book.books[p] = codes._kmeans(rest[:, 4 * p:4 * p + 4], codes.BOOK)
    cell, code = book.encode(unit)
    # each part is the nearest entry of its book
    for i in (0, 17, 599):
        for p in range(3):
            far = ((book.books[p] - rest[i, 4 * p:4 * p + 4]) ** 2).sum(1)
            assert far[code[i, p]] <= far.min() + 1e-12
    assert np.linalg.norm(book.decode(cell, code) - unit, axis=1).mean() < 0.35


def test_knn_by_codes(spark):
    v, m = _vectors(spark, n=900, dim=12)
    q = v.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    exact = _brute(m, 5)
    book = codes.train(v)
    assert len(book.centres) == 30 and book.books.shape == (3, 256, 4)

    def answers(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
            out.setdefault(r.query_id, []).append((r.id, round(r.cosine, 6)))
        return out
    # a short list of every vector is the exact search
    assert answers(codes.knn_codes(q, v, k=5, book=book, short_list=180)) == {i: exact[i] for i in exact if i % 9 == 0}
    near = answers(codes.knn_codes(q, v, k=5, book=book))
    share = np.mean([len({i for i, _ in near[x]} & {i for i, _ in exact[x]}) / 5 for x in near])
    assert share >= 0.9
    probed = answers(codes.knn_codes(q, v, k=5, book=book, nprobe=15))
    assert all(len(found) == 5 for found in probed.values()) and len(probed) == 100
    with_all = codes.knn_codes(q, v, k=5, book=book, nprobe=30, short_list=180)
    assert answers(with_all) == {i: exact[i] for i in exact if i % 9 == 0}


def test_code_sample_is_bounded(spark):
    v, _ = _vectors(spark, n=900, dim=4)
    assert len(codes.train(v, sample_rows=100).centres) <= 30


def test_ivf_scores_the_probed_cells_and_sends_a_query_once_per_block(spark):
    v, m = _vectors(spark)
    q = v.withColumnRenamed("id", "query_id")
    centres = vx.sample_centres(v, 16)
    cen = np.array([r["centre"] for r in centres.orderBy("cell").collect()], dtype=np.float64)
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    cen /= np.linalg.norm(cen, axis=1, keepdims=True)
    near = np.argsort(-np.rint(u @ cen.T * 1e6).astype(int), axis=1, kind="stable")
    s = np.round(u @ u.T, 6)
    want = {(a, j): s[a, j] for a in range(len(m)) for j in sorted(
        (j for j in range(len(m)) if near[j, 0] in near[a, :5]), key=lambda j: (-s[a, j], j))[:4]}
    for rows in (8, 64):  # cells cut into several blocks; several cells in a block
        got = vx.knn_ivf(q, v, k=4, centres=centres, nprobe=5, q_block_rows=rows, v_block_rows=rows).collect()
        assert {(r["query_id"], r["id"]): r["cosine"] for r in got} == want
    plain_q, plain_v = q.select("query_id", F.col("embedding").alias("vec")), v.select("id", F.col("embedding").alias("vec"))
    sent, _ = vx._probed_blocks(plain_q, vx._in_cells(plain_v, cen), cen, 12, 64, 128)
    assert sent.count() == len(m)  # one block of vectors, though twelve cells are probed


def test_small_blocks_do_not_multiply_the_rows_sent(spark):
    v, m = _vectors(spark)
    sent = vx._tiles(v.select(F.col("id").alias("query_id"), F.col("embedding").alias("vec")),
                     v.select("id", F.col("embedding").alias("vec")), 16, 16)
    assert [side.count() for side in sent] == [len(m), len(m)]


def test_later_blocks_of_a_tile_cannot_lose_ties_or_better_vectors():
    rnd = np.random.default_rng(3)
    m = vx._unit(rnd.integers(-1, 2, size=(700, 4)) + 0.0)  # many equal cosines
    ids = rnd.permutation(700).astype(np.int64)
    probed, cells = rnd.random((700, 9)) < 0.4, rnd.integers(0, 9, 700)
    s = np.rint(m @ m.T * 1e6).astype(int)
    for mask in (None, probed):
        got = vx._topk_tile(ids, m, ids, m, 6, 50, 16, mask, None if mask is None else cells)
        found = {}
        for q, v, _ in zip(*got):
            found.setdefault(q, set()).add(v)
        for i in range(700):
            js = [j for j in range(700) if mask is None or mask[i, cells[j]]]
            want = {ids[j] for j in sorted(js, key=lambda j: (-s[i, j], ids[j]))[:6]}
            assert found.get(ids[i], set()) == want


def test_terms_are_counted_in_bounded_parts(monkeypatch):
    import numpy as np
    import pandas as pd

    from altfinder.operators import vectors as vx

    rows = [np.arange(n, dtype=np.int32) % 5 for n in (3, 0, 40, 7, 0, 1, 25)]
    calls = []
    count = np.bincount
    monkeypatch.setattr(vx.np, "bincount", lambda x, **how: calls.append(len(x)) or count(x, **how))
    monkeypatch.setattr(vx, "TERMS_AT_ONCE", 20)
    got = vx._bucket_counts_to_unit.func(pd.Series(rows), pd.Series([5] * len(rows)))
    want = [count(r, minlength=5) for r in rows]
    assert np.allclose(np.stack(got), [w / max(1e-9, np.linalg.norm(w)) for w in want])
    assert sum(calls) == 76 and max(calls) < 20 + 40


def test_rows_are_sent_once_however_many_blocks(spark, monkeypatch):
    v, m = _vectors(spark)
    monkeypatch.setattr(vx, "TILE_QUERIES", 16)
    monkeypatch.setattr(vx, "TILE_VECTORS", 16)
    plain = v.select("id", F.col("embedding").alias("vec"))
    sent = vx._tiles(plain.withColumnRenamed("id", "query_id"), plain, 16, 16)
    assert [side.count() for side in sent] == [len(m), len(m)]
    got = vx.knn(v.withColumnRenamed("id", "query_id"), v, k=5, q_block_rows=16, v_block_rows=16)
    want = _brute(m, 5)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["id"], r["cosine"]))
    assert found == want


def test_passed_over_pairs_cannot_be_among_the_best(monkeypatch):
    rnd = np.random.default_rng(8)
    many = vx._unit(rnd.integers(0, 2, size=(500, 70)) + rnd.random((500, 70)) * 1e-5)  # cosines about 1e-6 apart
    equal = np.repeat(vx._unit(rnd.normal(size=(3, 70))), 170, axis=0)[:500]
    for m in (many, equal, np.concatenate([many[:250], equal[:250]])):
        ids = rnd.permutation(len(m)).astype(np.int64)
        s = np.rint(m @ m.T * 1e6).astype(int)
        best = vx._Best(ids, m, 9)
        for at in range(0, len(m), 64):
            best.meet(ids[at:at + 64], m[at:at + 64])
        found = {}
        for q, v, _ in zip(*best.pairs()):
            found.setdefault(q, set()).add(v)
        for i in range(len(m)):
            want = sorted(range(len(m)), key=lambda j: (-s[i, j], ids[j]))[:9]
            assert found[ids[i]] == {ids[j] for j in want}
    few = vx._Best(ids[:4], m[:4], 9)
    few.meet(ids[:5], m[:5])  # fewer vectors than asked for
    assert len(few.pairs()[0]) == 20


def test_short_lists_are_scored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vx, "TILE_VECTORS", 50)
    v, m = _vectors(spark, n=300, dim=12)
    twice = v.unionByName(v.where("id < 3"))  # rows that repeat count as often as they come
    q = v.where("id % 9 = 0").withColumnRenamed("id", "query_id")
    got = codes.knn_codes(q, twice, k=4, short_list=80)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Join Inner" not in plan.split("Join Cross")[0]  # no vector joined to its places
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.id, r.cosine))
    want = {(r.query_id, r["rank"]): (r.id, r.cosine) for r in vx.knn(q, twice, k=4).collect()}
    assert found[18] == [want[18, i] for i in (1, 2, 3, 4)] and len(found) == 34
