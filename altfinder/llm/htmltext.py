"""Main text of web pages, with host suffix arrays for repeated boilerplate.

A page is cut into blocks of text. Marks in the page (elements, roles, class
and id words) tell what is noise (menus, headers, footers, sidebars, notices,
adverts, forms, comments) and which containers may hold the article. Beside
the marks the host decides: the token streams of its pages are read as one
suffix array, and a block that is covered by long token runs found on half of
the host's distinct pages is boilerplate, in an article too. Of the containers
the one with the most text that does not repeat remains.

Only common beginnings of at least ``LEAST`` tokens matter, so a suffix is kept
as the hash of its host and first ``LEAST`` tokens. Pages are dealt by host,
large hosts in parts; a part sorts its suffixes, which brings equal beginnings
together as in the full array, and sends on only those that enough of its
pages share.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, WordHashes

LEAST = 8
COVERED = 0.8
#: Of a host's distinct pages, how many must share a run; and the fewest pages
#: that overrule a mark.
SHARE = 0.5
FIRM = 5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset(
    "head script style noscript template nav menu aside footer form dialog button select textarea iframe object svg "
    "canvas audio video map search datalist".split())
#: Words of class and id names (cut at - and _) that name no article text.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar toolbar "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification popup modal overlay toast alert newsletter subscribe subscription signup login "
    "comment comments reply replies respond disqus share sharing social related recommended recommendations pagination "
    "pager widget widgets copyright skip search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Whole class or id names that name the article.
ARTICLE_NAMES = frozenset(
    "article article-body article-content article-text content main-content page-content post post-body post-content "
    "post-text entry entry-content entry-body story story-body main".split())
NEGATED = frozenset("no non has with without is not hide hidden".split())
CLOSES_P = BLOCK - frozenset("html body head".split())
SCOPE = frozenset("html table td th caption template object button".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
STOPS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
         "tr": frozenset(["table"]), "td": frozenset("tr table".split()), "th": frozenset("tr table".split()),
         "option": frozenset("select datalist".split()), "optgroup": frozenset(["select"])}

_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_MARKUP_PLAIN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())

#: Marks around a block, added up.
BODY, NAMED, MAIN, ARTICLE, HEADING, NOISE = 0, 1, 2, 4, 8, 16


def _kind(name: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """(noise, marks) of an element; ``inside``: within an article."""
    noise = name in NOISE_TAGS or (name == "header" and not inside)
    marks = ARTICLE if name == "article" else MAIN if name == "main" else HEADING if name in HEADINGS else BODY
    if attrs and name not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                noise |= value.strip() in NOISE_ROLES
                marks |= {"main": MAIN, "article": ARTICLE}.get(value.strip(), BODY)
            elif key == "itemprop":
                marks |= ARTICLE if value.strip() == "articlebody" else BODY
            else:
                for whole in value.split():
                    if whole in ARTICLE_NAMES:
                        marks |= NAMED
                        continue
                    words = re.split(r"[-_]+", whole)
                    if not NEGATED.intersection(words):
                        noise |= not NOISE_WORDS.isdisjoint(words) or ("header" in words and not inside)
    return noise, marks


def blocks(page: str) -> list[tuple[int, str]]:
    """(marks, text) of each block that has text, in page order; the marks are
    NOISE, or those of all elements around the block."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int]] = [("", False, BODY)]  # (name, noise, marks) with those around it
    parts: list[str] = []
    state: tuple[bool, int] = (False, BODY)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((NOISE if state[0] else state[1], text))

    def close_to(depth: int) -> None:
        nonlocal state
        if any(s[0] in BLOCK or s[1:] != state for s in stack[depth:]) or stack[depth - 1][1:] != state:
            flush()
        del stack[depth:]
        state = stack[-1][1:]

    at, n, pattern = 0, len(page), _MARKUP
    while at < n:
        begin = page.find("<", at)
        if stack[-1][0] == "head" and page[at:begin if begin >= 0 else n].strip():
            close_to(len(stack) - 1)
        if begin < 0:
            parts.append(page[at:])
            break
        if begin > at:
            parts.append(page[at:begin])
        m = pattern.match(page, begin)
        if m is None and pattern is _MARKUP:
            m = _MARKUP_PLAIN.match(page, begin)
            if m is not None:  # a quote that never closes: no later one is trusted
                pattern = _MARKUP_PLAIN
        if m is None:
            parts.append("<")
            at = begin + 1
            continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                parts.append(" ")
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    break
            else:
                if name == "p":
                    flush()
            continue
        attrs = m["attrs"]
        if name == "body" or (stack[-1][0] == "head" and name not in IN_HEAD):  # </head> may be left out
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "head":
                    close_to(depth)
                    break
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
        if name in SAME:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in SAME[name]:
                    close_to(depth)
                    break
                if stack[depth][0] in STOPS[name]:
                    break
        if name == "br" or name == "wbr":
            if name == "br":
                parts.append(" ")
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = n if close is None else page.find(">", close.start()) + 1 or n
            continue
        noise, marks = _kind(name, attrs, bool(state[1] & (MAIN | ARTICLE)))
        inner = (state[0] or noise, state[1] | marks)
        if name in BLOCK or inner != state:
            flush()
        stack.append((name, *inner))
        state = inner
    flush()
    return out


def scopes(found: list[tuple[int, str]]) -> list[list[int]]:
    """The blocks that each kind of container on the page would keep: those
    within a main element, within articles outside of one (with the headings of
    a named container), within named containers. Without any, one scope of all
    blocks that are not noise."""
    main = [k for k, (marks, _) in enumerate(found) if marks != NOISE and marks & MAIN]
    article = [k for k, (marks, _) in enumerate(found) if marks != NOISE and marks & ARTICLE and not marks & MAIN]
    named = [k for k, (marks, _) in enumerate(found) if marks != NOISE and marks & NAMED and not marks & MAIN]
    if article:
        headings = [k for k in named if found[k][0] & HEADING]
        article = sorted({*article, *headings})
    return [x for x in (main, article, named) if x] or [[k for k, (marks, _) in enumerate(found) if marks != NOISE]]


_HASHES = WordHashes(200_000)


def suffixes(host: str, stream: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a stream of blocks: the suffixes (named by the host and their first
    ``least`` tokens), the block of each token, and the tokens of each block.
    Blocks are parted by a token of their own."""
    gap = b"\n"
    tokens: list[bytes] = []
    owner: list[int] = []
    for i, block in enumerate(stream):
        words = block.encode("utf-8", "surrogatepass").split()
        tokens += [*words, gap]
        owner += [i] * (len(words) + 1)
    if len(tokens) < least:
        return np.empty(0, np.int64), np.array(owner, np.int64), np.empty(0, np.int64)
    names = Rolling(_HASHES.of(tokens)).windows(least) ^ np.uint64(_HASHES[host.encode("utf-8", "surrogatepass")])
    return names.view(np.int64), np.array(owner, np.int64), np.arange(len(names))


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()),
                   ("marks", pa.list_(pa.int32())), ("stream", pa.string())])
_COUNT = pa.schema([("host", pa.string()), ("s", pa.int64()), ("n", pa.int64())])

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: the marks of its blocks, and their texts, a line each. Pages
    of one host with equal blocks outside the noise are one page; a task names it
    once, by ``page``, which is null in its copies and in pages without text."""
    import xxhash

    sent: set[tuple[str, int]] = set()
    for batch in batches:
        ids, urls, hosts, pages = batch.columns
        for s in range(0, batch.num_rows, 500):
            rows = []
            for i in range(s, min(s + 500, batch.num_rows)):
                host, found = hosts[i].as_py(), blocks(pages[i].as_py() or "")
                own = "\n".join(text for marks, text in found if marks != NOISE)
                page = None
                if own:
                    page = xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) - (1 << 63)
                    if (host, page) in sent:
                        page = None
                    else:
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add((host, page))
                rows.append((ids[i].as_py(), urls[i].as_py(), host, page, [marks for marks, _ in found],
                             "\n".join(text for _, text in found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE)], schema=_PAGE)


def _counts(least: int, share: float, most: int = 4 << 20):
    """Of rows sorted by host, part and page: how many distinct pages there are
    (s null), and how many have each suffix; rows without a page are passed over. A host that is one part is decided
    here. The parts of a larger one are random, so a suffix is named where a
    quarter of the asked share has it, and in parts of few pages always."""
    def told(host: str, pages: list[np.ndarray], whole: bool) -> pa.RecordBatch:
        names, n = np.unique(np.concatenate(pages), return_counts=True)
        least_n = max(2, share * len(pages)) if whole else share / 4 * len(pages) if len(pages) >= 32 else 1
        names, n = names[n >= least_n], n[n >= least_n]
        return pa.RecordBatch.from_arrays([pa.array([host] * (len(names) + 1), pa.string()), pa.array([None, *names.tolist()], pa.int64()),
                                           pa.array([len(pages), *n.tolist()], pa.int64())], schema=_COUNT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, pages, weight, cut = None, None, [], 0, False
        for batch in batches:
            hosts, parts, part, ids, streams = (batch.column(c) for c in ("host", "parts", "part", "page", "stream"))
            for i in range(batch.num_rows):
                if not ids[i].is_valid:
                    continue
                now = (hosts[i].as_py(), part[i].as_py(), parts[i].as_py())
                if now != at or weight >= most:
                    if pages:
                        yield told(at[0], pages, at[2] == 1 and not cut and now != at)
                    cut = now == at
                    last = last if cut else None
                    at, pages, weight = now, [], 0
                if ids[i].as_py() == last:
                    continue
                last = ids[i].as_py()
                pages.append(np.unique(suffixes(at[0], streams[i].as_py().split("\n"), least)[0]))
                weight += len(pages[-1])
        if pages:
            yield told(at[0], pages, at[2] == 1 and not cut)

    return run


def _covered(names: np.ndarray, owner: np.ndarray, n: int, shared: list[int], least: int) -> np.ndarray:
    """The share of each of ``n`` blocks that lies in shared runs."""
    edge = np.zeros(len(owner) + 1, dtype=np.int64)
    hit = np.flatnonzero(np.isin(names, np.array(shared, dtype=np.int64)))
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    return np.bincount(owner, weights=np.cumsum(edge[:-1]) > 0, minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))


def main_text(found: list[tuple[int, str]], host: str, shared: list[int], firm: list[int], least: int, covered: float) -> str:
    """The container with the most text that does not repeat on the host, less
    its repeated blocks; where all of them repeat, they stay."""
    choice = scopes(found)
    marked = len(choice) > 1 or any(found[k][0] & (NAMED | MAIN | ARTICLE) for k in choice[0])
    shared = firm if marked else shared
    gone = np.zeros(len(found), dtype=bool)
    if shared:
        names, owner, _ = suffixes(host, [text for _, text in found], least)
        if len(names):
            gone = _covered(names, owner, len(found), shared, least) >= covered
    own, seen = [], set()
    for scope in choice:  # a block speaks for the first container that has it
        own.append(sum(len(found[k][1].split()) for k in scope if not gone[k] and k not in seen))
        seen.update(scope)
    scope = choice[own.index(max(own))]
    return "\n\n".join(found[k][1] for k in ([k for k in scope if not gone[k]] or scope))


def _texts(least: int, covered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, marks, streams, shared, firm = (batch.column(c) for c in ("host", "marks", "stream", "shared", "firm"))
            texts = []
            for i in range(batch.num_rows):
                found = marks[i].as_py()
                found = list(zip(found, streams[i].as_py().split("\n"))) if found else []
                texts.append(main_text(found, hosts[i].as_py(), shared[i].as_py() or [], firm[i].as_py() or [], least, covered))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, least: int = LEAST, covered: float = COVERED, share: float = SHARE, firm: int = FIRM,
            part_pages: int = 128) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text, as do pages without text. White
    space inside a block becomes one space; blocks are joined by two line
    ends. Pages without a host share the host ''. Pages of a host with equal
    blocks count as one, so copies never mark each other's text as boilerplate.
    An empty table gives no rows; other columns are ignored.

    Hosts of over ``part_pages`` pages are counted in parts, so none is one
    task; the table of their numbers of parts is broadcast. A page is parsed
    once and its blocks are dealt once: counting and cutting read the same
    exchange, for which both take all of its columns.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), "html")
    large = (rows.groupBy("host").count().where(F.col("count") > part_pages)
             .select("host", F.ceil(F.col("count") / part_pages).cast("long").alias("parts")))
    # rows that are not counted are dealt by row, so that many copies of a page do not meet
    key = F.coalesce("page", F.xxhash64("page_id", "url"))
    dealt = (rows.mapInArrow(_streams, "page_id bigint, url string, host string, page bigint, marks array<int>, stream string")
             .join(F.broadcast(large), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
             .withColumn("part", F.pmod(key, "parts"))
             .select("page_id", "url", "host", "parts", "part", "page", "marks", "stream").repartition("host", "part"))
    counts = (dealt.sortWithinPartitions("host", "part", "page").mapInArrow(_counts(least, share), "host string, s bigint, n bigint")
              .groupBy("host", "s").agg(F.sum("n").alias("n")))
    # the row without a suffix holds the number of pages
    total = F.max(F.when(F.col("s").isNull(), F.col("n"))).over(Window.partitionBy("host"))
    shared = (counts.withColumn("total", total).where("s is not null and n >= 2").where(F.col("n") >= F.col("total") * share)
              .groupBy("host").agg(F.collect_list("s").alias("shared"),
                                   F.collect_list(F.when(F.col("n") >= firm, F.col("s"))).alias("firm")))
    # a large host's runs meet its pages in as many parts
    shared = (shared.join(F.broadcast(large), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
              .select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "shared", "firm"))
    return dealt.join(shared, ["host", "part"], "left").mapInArrow(
        _texts(least, covered), "page_id bigint, url string, text string")
