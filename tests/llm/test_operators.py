"""Each operator against a plain version on small tables: nulls, empty and
long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from altfinder.llm import chat, htmltext, lzprint, mixing, neardup, packing, quality, secret_scan, substring_dedup, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, target int, node string, kept int"


def make_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "é", "ß", "語"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 220))) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(55))
    texts = list(base)
    for i in range(8):
        words = base[0].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [base[1], base[1], base[2].upper(), base[3] + "\n" + passage, base[4] + " " + passage, passage,
              None, "", " \t\n", "one", "one two three", "a\x0bb\x0cc d", " ".join(["x"] * 120),
              " ".join(f"z{i}" for i in range(6000)), passage + " " + passage]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else None, ["b", "a", None, "é"][i % 4], 0, "clash", 1, "n", 2)
            for i, t in enumerate(make_texts())]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_near_duplicates(docs, empty):
    texts = texts_of(docs)
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in texts}
    for _ in range(len(texts)):
        for a in texts:
            for b in texts:
                both, some = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if both and 100 * both >= 75 * some:
                    low[a] = low[b] = min(low[a], low[b])
    got = neardup.link(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)
    assert neardup.link(empty).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in low if low[i] == i)


def test_long_lists_are_exact(docs):
    want = sorted(tuple(r) for r in neardup.link(docs).collect())
    assert sorted(tuple(r) for r in neardup.link(docs, short_list=1).collect()) == want


def test_substring_dedup(docs, empty):
    texts = texts_of(docs)
    first = {}
    want = {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p:p + 50]), i) < i:
                gone[p:p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3] for r in got)
    assert any(r.n_removed for r in got)
    with_text = substring_dedup.remove_repeats(docs, with_text=True).collect()
    assert len(with_text) == docs.count() and all(r.kept == want[r.doc_id][3] for r in with_text)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_phrase_fingerprints(docs, empty, spark):
    texts = texts_of(docs)
    rows = [texts[r.doc_id] for r in docs.select("doc_id").orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    want = []
    for k, (i, t) in enumerate(zip(ids, rows)):
        following = rows[(k + 1) % len(rows)]
        edited = lzprint.edit(t, following)
        a, b, c = (lzprint.fingerprint(x) for x in (t, edited, following))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lzprint.as_text(a), lzprint.as_text(b),
                     lzprint.likeness(a, b), lzprint.likeness(a, c)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint).hex(), bytes(r.edited_fingerprint).hex(),
            r.near_edited, r.near_next) for r in lzprint.neighbours(docs).collect()]
    assert sorted(got) == sorted(want)
    assert lzprint.neighbours(empty).count() == 0
    alone = lzprint.neighbours(spark.createDataFrame([(1, "abcd efgh")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0


def test_phrases_follow_the_dictionary():
    row = list(b"aababcababab".decode().encode()[i:i + 1] for i in range(12))
    ends = lzprint.parse(row)
    phrases = ["".join(x.decode() for x in row[b:e]) for b, e in zip([0, *ends], ends)]
    assert phrases == ["a", "ab", "abc", "aba", "b", "ab"]


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "source", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    texts = texts_of(docs)
    assert all(s == len(texts[i].encode().split()) for i, s in zip(got.doc_id, got["size"]))
    assert (got.taken <= 3 * got["size"]).all()
    by = got.fillna({"source": "~null"}).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    order = sorted((s for s in by.index if s != "~null"), key=lambda s: s.encode("utf-32-be")) + ["~null"]
    weight, target, room = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, float(by["size"].sum())
    while len(target) < len(order):
        free = [s for s in order if s not in target]
        level = room / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * by["size"][s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 3.0 * by["size"][s]
            room -= target[s]
    biggest = got["size"].max()
    for s in order:
        assert by["target"][s] == pytest.approx(target[s])
        assert abs(by["taken"][s] - target[s]) <= biggest
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == got.epochs.sum()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\b<s>\\"), (1, 2, "assistant", "<\\s>"),
            (1, 3, "assistant", None), (2, 0, None, ""), (2, 1, "[INST]", "x"), (None, 0, "assistant", "[/INST"),
            (3, 1, "assistant", "]"), (3, 1, "assistant", "]"), (3, 0, "user", "語" * 5000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert all(r.loss_text == "".join(t for role, t in want[c] if role == "assistant") for c, r in got.items())
    assert got[1].formatted.count("</s>") == 2  # adjacent turns of one role are one block
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = texts_of(docs)
    got = packing.pack(docs, shard_tokens=3000).toPandas()
    repeated = docs.groupBy("doc_id").count().where("count > 1").first().doc_id
    for i, pieces in got.groupby("doc_id"):
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids + [0]
        times = 2 if i == repeated else 1
        covered = np.zeros(len(ids), int)
        for p in pieces.itertuples():
            covered[p.start:p.start + p.length] += 1
            part = np.array(ids[p.start:p.start + p.length], dtype="<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids)
        assert (covered == times).all()
    assert set(got.doc_id) == set(texts)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        total = int(s.length.sum())
        assert total == 1024 or (total < 1024 and total & (total - 1) == 0)
    assert packing.pack(empty).count() == 0


def test_packing_keeps_neighbours_together(spark):
    rng = random.Random(8)
    common = "the of and to in that it was for on with as his they at be this from have or".split()
    topics = [["river", "stone", "water", "bridge", "forest", "valley"], ["market", "price", "trade", "money", "bank", "credit"],
              ["music", "song", "voice", "dance", "stage", "theatre"], ["engine", "wheel", "motor", "metal", "steel", "power"]]
    rare = [chr(0x4E00 + k) for k in range(400)]  # each text has an entry of its own at the vocabulary's end
    rows = []
    for i in range(160):
        of = lambda words, n: " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(common) for _ in range(n))
        text = of(topics[i % 4], 200)
        if i % 8 < 4:  # a long text whose left-over alone tells no topic
            text = of(topics[i % 4], 1000) + " " + of(common, 200)
        rows.append((i, text + " " + rng.choice(rare)))
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_tokens=8000).toPandas()
    mixed = [len(set(s.doc_id % 4)) for _, s in got.groupby("sequence_id") if len(s) > 1 and s.length.sum() == 1024]
    assert len(mixed) > 20 and sum(n == 1 for n in mixed) > 0.7 * len(mixed)


@pytest.mark.parametrize("text", ["a  b", "  x ", "a\n\nb c", "x <|endoftext|> y", "", "　a b\xa0 c", "a \x1cb", "it's 'll  'd"])
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.Tokens.at(path).encode(text).tolist() == want


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2
    live = "gh" + "p_" + "A1b2" * 9
    rows = [(1, f'é password = "hunter2hunter2" {hexes}f', "a", "en"), (2, "secret: \"token: abcdefgh1234", "a", "en"),
            (3, "AKIA" + "A" * 12 + " AKIAXAKIA", "b", "en"), (4, None, None, None), (5, "", "b", "en"), (6, live, "a", "en"),
            (7, "token=abc token==abcdefgh", "b", "en")]
    rows += [(10 + i, "AKIA" + "Z" * 16 + " " + "gh" + "p_" + "C3d4" * 9, f"s{i}", "en") for i in range(5)]
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id int, text string, source string, lang string, n_chars int, uid string")
    table = table.union(table.where("doc_id = 6"))
    got = {r.doc_id: r for r in secret_scan.scan(table).collect()}
    forms = [("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
             ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    for i, text, *_ in rows:
        want = sorted((m.start(), k, m.end()) for k, (_, form, group, least) in enumerate(forms)
                      for m in re.finditer(form, text or "") if len(m[group]) >= least)
        assert [(s.begin, s.kind_no, s.end) for s in got[i].base] == want
    assert [s.kind for s in got[6].added] == ["github", "mixed"]  # one owner only
    assert not got[10].added and got[10].examples == 1  # copied by five owners
    clean = {r.doc_id: r for r in secret_scan.redacted(table).collect()}
    assert clean[6].text == "[SECRET]" and clean[5].text == "" and clean[4].text is None and clean[7].text == "token=abc [SECRET]"
    assert clean[6].n_chars == 8 and secret_scan.redacted(table).columns == table.columns
    assert clean[10].text.startswith("[SECRET] gh")  # the added kind is a copied example
    assert secret_scan.scan(table.limit(0)).count() == 0


def test_quality_statistics():
    text = "a b c a b c d\na b c a b c d\n \n#$x É!! 12"
    words = text.encode().split()
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k in range(len(grams)) if grams.count(grams[k]) > 1 for j in range(3)}
    got = dict(zip(quality.STATS, quality.text_stats(text)))
    assert got["n_words"] == len(words) and got["n_repeat_words"] == len(again) and got["n_dup_lines"] == 1
    assert got["word_chars"] == sum(len(w.decode()) for w in words) and got["n_symbols"] == 2
    assert quality.text_stats(None) == quality.text_stats("") == (0,) * len(quality.STATS)


def test_quality_rules(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "early"]) + str(rng.randrange(500)) for _ in range(90))
    poor = lambda: " ".join(rng.choice(["buy###", "now$$$"]) + str(rng.randrange(500)) for _ in range(90))
    rows = [(i, good() if i % 3 else poor(), "kept") for i in range(300)] + [(1000, None, "x"), (1001, "short", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, stats string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(0, 200)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    out, rules = quality.judge(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert rules and all(got[i].kept == bool(i % 3) for i in range(200, 300))
    assert got[1000].base_failed and not got[1001].kept
    x = quality.features_of(np.array([[got[i].stats[c] for c in quality.STATS] for i in range(300)]))
    covered = np.zeros(300, dtype=bool)
    for rule in rules:
        covered |= rule.covers(x)
    assert [got[i].kept for i in range(300)] == (~covered).tolist()  # the expression is the list
    assert quality.keep_good(docs, labels).columns == docs.columns
    unlabelled, none = quality.judge(docs, labels.limit(0))
    assert none == [] and unlabelled.where("kept").count() == 300
    assert quality.judge(docs.limit(0), labels)[0].count() == 0


def test_rare_kinds_get_their_rules():
    rng = np.random.default_rng(1)
    n = 20_000
    x = rng.random((n, len(quality.FEATURES)))
    rare, noisy, late = np.arange(n) % 100 == 0, np.arange(n) % 100 < 20, np.arange(n) % 50 == 1
    x[:, 2] = np.where(rare, 0.3 + 0.2 * x[:, 2], 0.1 * x[:, 2])
    order = rng.integers(0, 1 << 40, n)
    rules = quality.learn(x, rare, order)
    assert len(rules) == 1 and (rules[0].covers(x) == rare).all()
    # most poor rows are told by nothing: their rules fail, the precise ones still come
    x[:, 4] = np.where(late, 0.9 + 0.1 * x[:, 4], 0.8 * x[:, 4])
    poor = rare | late | (noisy & (rng.random(n) < 0.3))
    covered = np.any([r.covers(x) for r in quality.learn(x, poor, order)], axis=0)
    assert covered[rare | late].all() and not (covered & ~poor).any()


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "x" * 100), (3, "http://b/\r\nX: y", "x" * 100), (4, None, "x" * 99), (6, "u", "x" * 99),
            (7, "u", None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" + "é\u0000" * 60), (9, "u", "x" * 100),
            (None, "u", "x" * 100)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, digest string")
    got = warc.archive_and_read(pages)
    out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "").encode() == body))
        revisit = len(body) >= 100 and i != first
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert out == sorted(want, key=str)
    for r in warc.original(got).where("page_id = 5").collect():
        (head, fields, payload), = warc.parse(iter([bytes(r.record)]))
        assert fields["WARC-Type"] == "revisit" and payload == b""
    assert warc.archive_and_read(pages.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site name</header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>\n text&nbsp;here<br>line<p>Second &lt;b&gt; 1 < 2
<script>var t = "</p><p>no";</script><div class="ad-box">Buy</div><form>Name <input></form><aside>See also</aside>
<table><tr><td>cell one<td>cell two</table><section class="comments"><p>Nice post</p></section><footer>By me</footer></article>
<div id="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def test_html_text(spark):
    shared = "<div>Join our club today and get every offer first</div>"
    bare = lambda own: f"<html><body>{shared}<div>{own}</div>{shared}</body></html>"
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, "http://h/3", ""), (4, "http://k/1", bare("own words of page four")),
            (5, "http://k/2", bare("other words of page five")), (6, "http://l/1", bare("a page of another host")),
            (7, None, "<p>unclosed <a href='x>text"), (8, "u", "plain & text " * 20000), (9, "u", "<!-- open")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, uid int")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert got[1] == ("Title & more\n\nFirst bold text here line\n\nSecond <b> 1 < 2\n\ncell one\n\ncell two")
    assert got[2] == got[3] == got[9] == ""
    assert got[4] == "own words of page four" and got[5] == "other words of page five"
    club = "Join our club today and get every offer first"
    assert got[6] == f"{club}\n\na page of another host\n\n{club}"  # nothing repeats on its host
    assert got[7] == "unclosed text" or got[7].startswith("unclosed")
    assert got[8] == " ".join(["plain & text"] * 20000)
    assert htmltext.extract(pages.limit(0)).count() == 0


def texts_from(spark, pages, **knobs):
    table = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)],
                                  "page_id bigint, url string, html string")
    return [r.text for r in sorted(htmltext.extract(table, **knobs).collect(), key=lambda r: r.page_id)]


def own_words(i, n=12):
    return " ".join(f"own{i}x{k}" for k in range(n))


def test_html_repeats_go_beside_the_marks(spark):
    club = "Join our club today and get every offer first"
    pages = [("h", f"<body><article><p>{own_words(i)}</p><p>{club}</p></article></body>") for i in range(8)]
    pages += [("few", page) for _, page in pages[:4]]  # too few pages to overrule a mark
    want = [own_words(i) for i in range(8)] + [f"{own_words(i)}\n\n{club}" for i in range(4)]
    assert texts_from(spark, pages) == want
    assert texts_from(spark, pages, part_pages=2) == want  # a host counted in parts


def test_html_copies_and_ordinary_repeats_stay(spark):
    body = "".join(f"<p>{own_words(k)}</p>" for k in range(3))
    copies = [("h", f"<body>{body}</body>"), ("h", f"<body><nav>Home</nav>{body}</body>")]
    quote = "an ordinary paragraph that two of the pages quote"
    some = [("k", f"<body><p>{own_words(10 + i)}</p>{f'<p>{quote}</p>' * (i < 2)}</body>") for i in range(6)]
    short = [("s", f"<body><p>{own_words(20 + i)}</p><p>one two three four five six {i} {i}</p></body>") for i in range(2)]
    got = texts_from(spark, copies + some + short)
    assert got[0] == got[1] == "\n\n".join(own_words(k) for k in range(3))
    assert got[2:8] == [own_words(10 + i) + f"\n\n{quote}" * (i < 2) for i in range(6)]
    assert got[8:] == [f"{own_words(20 + i)}\n\none two three four five six {i} {i}" for i in range(2)]
    near = [("n", f"<body><p>{own_words(0, 40)}</p><p>{own_words(1, 40)} edit{i}</p></body>") for i in range(2)]
    assert all(texts_from(spark, near))


def test_html_pages_are_dealt_once(spark):
    club = "<p>Join our club today and get every offer first</p>"
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"<body><p>{own_words(i)}</p>{club}</body>") for i in range(30)],
                                  "page_id bigint, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = htmltext.extract(pages)
        out.collect()
        ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ran.count("MapInArrow _streams") == 1  # parsed in one place
    assert any("ReusedExchange" in line and "stream#" in line for line in ran.splitlines()), ran


def test_html_containers(spark):
    long, more = own_words(1, 30), own_words(2)
    pages = [f"<main><h1>Title</h1><article><p>{long}</p></article></main>",
             f"<main><p>{long}</p><article>{more}</article></main>",
             f"<main><p>{long}</p></main><article>{more}</article>",
             f"<article>{more}</article><article>{long}</article>",
             f"<div class=post><h2>Title</h2><p>By me</p><article>{long}</article></div>",
             f"<div class=content><p>{long}</p><article>{more}</article></div>",
             f"<html><head><title>t</title><meta charset=utf-8><body><p>{more}</p></body></html>",
             f"<head><title>t</title><link rel=x><p>{more}</p>",
             f"<head><title>t</title>{more}",
             f"<head><noscript><p>no</p></noscript><template><div>no</div></template></head><body>{more}"]
    got = texts_from(spark, [(f"h{i}", page) for i, page in enumerate(pages)])
    assert got == [f"Title\n\n{long}", f"{long}\n\n{more}", long, f"{more}\n\n{long}", f"Title\n\n{long}", f"{long}\n\n{more}",
                   more, more, more, more]


def test_packing_cuts_and_ranks_as_the_plain_forms():
    import random

    import numpy as np
    import tiktoken

    from altfinder.llm import packing

    fast = packing.Tokens.at(packing.default_tokenizer()).plain
    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=fast._mergeable_ranks, special_tokens={})
    rnd = random.Random(4)
    for _ in range(3_000):
        text = "".join(rnd.choice(" \t\n\r  'sdmtlvreLé漢١2½#-_.\x85") for _ in range(rnd.randrange(14)))
        assert fast.encode_ordinary(text) == plain.encode_ordinary(text)
    for n in (1, packing.NEAR, 1_000):
        scores = np.random.default_rng(n).integers(-1, 5, n).astype(float)
        scores[: n // 3] = np.random.default_rng(n).random(n // 3)
        assert list(packing.ranked(scores)) == np.argsort(-scores, kind="stable").tolist()


def test_packing_cuts_ascii_texts_and_counts_ids_as_the_plain_forms():
    import random

    import numpy as np
    import tiktoken

    from altfinder.llm import packing

    tokens = packing.Tokens.at(packing.default_tokenizer())
    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=tokens.plain._mergeable_ranks, special_tokens={})
    rnd = random.Random(5)
    for _ in range(3_000):
        text = "".join(rnd.choice("  \t\n\r\x0b\x1c\x00'sdmtlvreLZ09#-_.") for _ in range(rnd.randrange(16)))
        ids = plain.encode_ordinary(text)
        assert tokens.ascii.encode_ordinary(text) == tokens.plain.encode_ordinary(text) == tokens.encode(text).tolist() == ids
        assert tokens.plain.encode_ordinary(text + "  　é") == plain.encode_ordinary(text + "  　é")
        if ids:
            terms, counts = np.unique(np.array(ids, np.uint16), return_counts=True)
            got = packing.bag(b"", *packing.bag_bytes(np.array(ids, np.uint16)))
            assert got[0].tolist() == terms.tolist() and got[1].tolist() == counts.tolist()
