"""Collocations, shards and the manifest against plain versions on small
tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names, hot words and hot languages."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from altfinder.llm import collocation, merkle, sharding

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, at int, tree string, level int, digest string, "
        "shard string, slot int, words int, unit string, bucket int, place int, phrase string, path string, size int")
CLASH = (1, "t", 2, "d", "s", 3, 4, "u", 5, 6, "p", "q", 7)


def make_texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["The", "É", "ß", "語", "a\x0bb", "x y", "\x1cz"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t "]) for _ in range(rng.randint(1, 60)))
             for _ in range(60)]
    texts += ["hot pair " + f"n{i} m{i % 7}" for i in range(80)]
    texts += ["Licence line of five words"] * 40 + ["x " * 400, " ".join(f"long{i}" for i in range(5000))]
    texts += [None, "", " \t\n", "...", "one", "ONE two", "a.b,c;d:e!f?g\rh"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 9, t, ["en", None, "und", "é", "en", "en"][i % 6], ["b", "", None][i % 3], [len(t or ""), None][i % 2], *CLASH)
            for i, t in enumerate(make_texts())]
    rows += [rows[5], rows[5], (None, "no id", "solo", None, None, *CLASH), (None, "no id", "two", None, None, *CLASH)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ phrases

def plain_collocations(rows, least, top):
    upper = {c: c + 32 for c in range(65, 91)}
    per = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            w = re.findall("[^ \t]+", piece)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    per[lang or "und"][tuple(w[i:i + m])] += 1
    out = set()
    for lang, f in per.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        around = collections.Counter()
        for g, c in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    around[g[i:i + m]] = max(around[g[i:i + m]], c)
        for g, a in candidates.items():
            if 100 * around[g] >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for i, (s, a, g, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, i + 1, g.decode(), -a, left, right, n, -s))
    return out


@pytest.mark.parametrize("edges,flush", [(collocation.BUCKET_EDGES, collocation.FLUSH_WORDS), (12, 500)])
def test_collocations(docs, edges, flush):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = [tuple(r) for r in collocation.collocations(docs, 2, 40, bucket_edges=edges, flush=flush).collect()]
    want = plain_collocations(rows, 2, 40)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_collocations_of_nothing(empty, docs):
    assert collocation.collocations(empty).count() == 0
    assert collocation.collocations(docs.where("text is null")).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long").selectExpr(
        "(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s")
    assert row.first().s == 2_000_000 * big // (2 * big)


# ------------------------------------------------------------------ shards

def test_schedule_is_the_heap():
    rng = random.Random(3)
    loads = [(f"u{i}", rng.choice([1, 5, 5, 9, 1000])) for i in range(300)]
    sums, want = [0] * 7, []
    for unit, size in sorted(loads, key=lambda u: (-u[1], u[0])):
        s = sums.index(min(sums))
        sums[s] += size
        want.append((unit, s))
    assert sharding.schedule(loads, 7) == want
    heap = list(sums)
    heapq.heapify(heap)
    assert max(sums) - min(sums) <= 1000


@pytest.mark.parametrize("units", [sharding.UNITS, 60])
def test_shards(docs, units):
    texts = collections.Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    by_id = collections.defaultdict(list)
    for i, t in texts.elements():
        by_id[i].append(t)
    got = sharding.assign(docs, 6, units).collect()
    assert len(got) == sum(texts.values())
    slots, of_text, loads = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        crcs = {zlib.crc32(t.encode()): t for t in by_id[r.doc_id]}
        text = crcs[r.text_crc32]
        assert r["size"] == len(text.encode()) + 16
        slots[r.shard].append(r.slot)
        of_text[text].add(r.shard)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) <= set(range(6))
    groups = collections.Counter()
    for (_, t), n in texts.items():
        groups[t] += n * (len(t.encode()) + 16)
    largest, share = max(groups.values()), sum(groups.values()) / 6
    rest = [v for v in loads.values() if v < largest]
    assert max(loads.values()) <= max(largest, 1.1 * share)
    assert max(rest) - min(rest) <= max(sorted(groups.values())[-2], sum(groups.values()) * 2 // units + 200)


def test_shards_of_nothing(empty):
    assert sharding.assign(empty).count() == 0


def test_written_shards(spark, docs, tmp_base):
    path = f"{tmp_base}/shards"
    plain = docs.drop("shard")
    sharding.write_shards(plain, path, 6)
    back = spark.read.parquet(path)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, back.select(plain.columns).collect()))
    want = {(r.text_crc32, r.shard) for r in sharding.assign(plain, 6).collect()}
    assert {(zlib.crc32((r.text or "").encode()), r.shard) for r in back.collect()} == want
    with pytest.raises(ValueError):
        sharding.write_shards(docs, path + "2", 6)


# ------------------------------------------------------------------ manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def plain_tree(leaves):
    """(root, per leaf the (left, right) siblings on the way up)."""
    way, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            way[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 8])))
        level = [sha(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], way


def plain_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text)), r))
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        members = [r for _, r in sorted(by[lang], key=lambda m: m[0])]
        trees.append((members, *plain_tree([plain_leaf(r, r.text) for r in members])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, ways), top in zip(trees, tops, strict=True):
        for r, way in zip(members, ways, strict=True):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            h = plain_leaf(r, text)
            for left, right in way + top:
                h = sha(left, h, right)
            out.append((r.doc_id, plain_leaf(r, r.text), subroot, root, sha(*[a + b for a, b in way + top]), h))
    return sorted(out, key=repr)


def manifest_rows(df):
    out = merkle.manifest(df)
    return sorted((tuple(r) for r in out.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(out.path).alias("p"), merkle.fold(out.tampered, out.path).alias("f")
    ).collect()), key=repr)


def test_manifest(docs):
    got = manifest_rows(docs)
    assert got == plain_manifest(docs.collect())
    bad = [r for r in got if r[5] != r[3]]
    assert bad and len(bad) < len(got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 600])
def test_manifest_sizes(spark, n):
    rows = [(i, "Text %d" % i if i % 4 else None, "en" if n < 600 else ["en", None, "de"][i % 50 // 24], "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(df) == plain_manifest(df.collect())


def test_manifest_of_many_languages(spark):
    rows = [(i, "A", f"l{i % 70}", None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(df) == plain_manifest(df.collect())


def test_manifest_with_few_ancestors_shuffled(docs, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", -1)
    assert manifest_rows(docs) == plain_manifest(docs.collect())


def test_manifest_of_nothing(empty):
    out = merkle.manifest(empty)
    assert out.count() == 0
    assert out.select(merkle.fold(out.tampered, out.path)).count() == 0
