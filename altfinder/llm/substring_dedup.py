"""Removal of long word sequences that already stand in an earlier document.

The suffixes of all texts are split by prefixes of variable length, and only
subtrees that hold suffixes of two documents are taken deeper:

1. Prefix of ``PREFIX`` words. Of the suffixes that begin inside any window of
   ``WINDOW`` words the one with the smallest prefix hash stands for the window
   (equal windows choose alike), so about one suffix in twenty is posted. A
   prefix that occurs in one text only is a leaf and ends here.
2. Prefix as long as the stretch of consecutive windows that one posted suffix
   stands for. Equal stretches meet in one node; all but its smallest document
   lose the whole stretch, and the smallest one alone goes on.
3. Prefix of ``WINDOW`` words: one node for each different window left. It is
   an internal node of depth ``WINDOW`` if two documents have it; all but the
   smallest lose it. The union of a document's windows is its maximal repeats.

Nodes are named by two hashes of their path. Node minima are aggregated before
the shuffle, so a passage in a third of all texts is no large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, written

WINDOW = 50
PREFIX = 12
_HASHES = WordHashes()
_SECOND = 0xD6E8FEB86659FD93


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def posted(prefixes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` prefixes the place of its smallest one
    (leftmost of equals)."""
    at = np.arange(len(prefixes), dtype=np.int64)
    span = 1
    while span * 2 <= width:
        left, right = at[:-span], at[span:]
        at = np.where(prefixes[left] <= prefixes[right], left, right)
        span *= 2
    if span < width:
        left, right = at[:len(at) - (width - span)], at[width - span:]
        at = np.where(prefixes[left] <= prefixes[right], left, right)
    return at


def stretches(hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(prefix hash, first window, last window) of each stretch of windows that
    one posted suffix stands for."""
    rolling = Rolling(hashes)
    grams = rolling.windows(prefix)
    at = posted(grams, window - prefix + 1)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate((np.zeros(1, np.int64), cut))
    last = np.concatenate((cut - 1, np.array([len(at) - 1], np.int64)))
    return grams[at[first]].view(np.int64), first, last, rolling


def _arrow(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for size, row in rows:
        held.append(row)
        weight += size
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SCAN = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()),
                   ("prefixes", pa.list_(pa.int64()))])
_STRETCH = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("first", pa.int32()), ("node", pa.int64()),
                      ("node2", pa.int64()), ("windows", pa.list_(pa.int64())), ("windows2", pa.list_(pa.int32()))])
_CUT = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("kept", pa.string())])


def _scan(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, twins, texts = batch.columns
                for i in range(batch.num_rows):
                    words = words_of(texts[i].as_py())
                    found = []
                    if len(words) >= window:
                        found = np.unique(stretches(_HASHES.of(words), window, prefix)[0])
                    yield 8 + len(found), (ids[i].as_py(), twins[i].as_py(), len(words),
                                           hashlib.sha256(b" ".join(words)).hexdigest(), found)

        yield from _arrow(rows(), _SCAN, 200_000)

    return run


def _deepen(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, twins, texts, shared = batch.columns
                for i in range(batch.num_rows):
                    doc_id, twin = ids[i].as_py(), twins[i].as_py()
                    hashes = _HASHES.of(words_of(texts[i].as_py()))
                    name, first, last, rolling = stretches(hashes, window, prefix)
                    wanted = np.isin(name, shared[i].values.to_numpy(zero_copy_only=False))
                    first, last = first[wanted], last[wanted]
                    second = Rolling(hashes, _SECOND)
                    a, b = rolling.runs(first, last + window).view(np.int64), second.runs(first, last + window).view(np.int64)
                    w = rolling.windows(window).view(np.int64)
                    w2 = second.windows(window).view(np.int64).astype(np.int32)
                    for s, e, x, y in zip(first.tolist(), last.tolist(), a.tolist(), b.tolist()):
                        yield 6 + e - s, (doc_id, twin, s, x, y, w[s:e + 1], w2[s:e + 1])

        yield from _arrow(rows(), _STRETCH, 200_000)

    return run


def covered(n: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins in one of ``spans``
    (first, last)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1] + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, twins, texts, spans = batch.columns
                for i in range(batch.num_rows):
                    words = words_of(texts[i].as_py())
                    pairs = spans[i].values.flatten()
                    at = np.stack([p.to_numpy(zero_copy_only=False) for p in pairs], axis=1).astype(np.int64)
                    gone = covered(len(words), at, window)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    yield 100 + len(kept), (ids[i].as_py(), twins[i].as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                                            kept.decode("utf-8", "surrogatepass") if with_text else None)

        yield from _arrow(rows(), _CUT, 8 << 20)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) per row of ``docs``.

    A word goes if a window of ``window`` consecutive words covers it whose
    word sequence also begins in a document with a smaller doc_id; windows are
    those of the input. kept_sha256 is of the kept words joined by one space;
    ``with_text`` adds that text itself.

    Null and empty texts have no words. Rows of one doc_id are judged alone
    and never remove each other's words; a row with a null doc_id loses
    nothing and removes nothing. An empty table gives no rows; other columns
    are ignored.
    """
    key = ["doc_id", "twin"]  # a row's id and text; repeated rows are one
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("twin"), "text")
    scanned = written(rows.mapInArrow(
        _scan(window, prefix), "doc_id bigint, twin bigint, n_words bigint, sha string, prefixes array<bigint>"), "repeats-scan")
    # 0. whole copies of a text in an earlier document
    firsts = scanned.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("origin"))
    heads = written(scanned.select(*key, "n_words", "sha").join(firsts, "sha", "left"), "repeats-heads")
    live = heads.where(f"doc_id = origin and n_words >= {int(window)}").select(*key).distinct()
    # 1. short prefixes that two different texts have
    posts = scanned.where("doc_id is not null").select(*key, F.xxhash64("sha").alias("body"), F.explode("prefixes").alias("p"))
    shared = posts.groupBy("p").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo < hi").select("p")
    hits = posts.select(*key, "p").join(shared, "p").groupBy(*key).agg(F.collect_set("p").alias("shared"))
    deep = written(rows.join(hits.join(live, key), key).dropDuplicates(key), "repeats-texts")
    found = written(deep.select(*key, "text", "shared").mapInArrow(
        _deepen(window, prefix), "doc_id bigint, twin bigint, first int, node bigint, node2 bigint, "
        "windows array<bigint>, windows2 array<int>"), "repeats-stretches")
    # 2. equal stretches
    node = ["node", "node2"]
    placed = found.join(found.groupBy(*node).agg(F.min("doc_id").alias("low")), node)
    whole = placed.where("doc_id > low").select(*key, "first", (F.col("first") + F.size("windows") - 1).alias("last"))
    # 3. the windows of the stretches left, one document each
    each = (placed.where("doc_id = low")
            .select(*key, "first", F.posexplode(F.arrays_zip("windows", "windows2")).alias("i", "w"))
            .select(*key, (F.col("first") + F.col("i")).alias("at"), F.col("w.windows").alias("w"), F.col("w.windows2").alias("w2")))
    nodes = (each.groupBy("w", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
             .where("low < high").drop("high"))
    single = each.join(nodes, ["w", "w2"]).where("doc_id > low").select(*key, F.col("at").alias("first"), F.col("at").alias("last"))
    spans = whole.union(single).groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    cut = deep.select(*key, "text").join(spans, key).select(*key, "text", "spans").mapInArrow(
        _cut(window, with_text), "doc_id bigint, twin bigint, n_removed bigint, kept_sha256 string, kept string")
    copy = F.coalesce((F.col("doc_id") > F.col("origin")) & (F.col("n_words") >= window), F.lit(False))
    judged = (heads.dropDuplicates(key) if with_text else heads).join(cut, key, "left").select(
        *key, "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    if not with_text:
        return judged.drop("twin", "kept")
    one_space = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    same = (F.col("a.twin") == F.col("b.twin")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    return rows.alias("a").join(judged.alias("b"), same).select(
        "a.doc_id", "b.n_words", "b.n_removed", "b.kept_sha256", F.coalesce("b.kept", one_space).alias("kept"))
