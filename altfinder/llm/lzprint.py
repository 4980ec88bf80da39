"""Lempel-Ziv phrase fingerprints.

A text is a row of symbols: its words, and of a word of more than
``LONG_WORD`` bytes (scripts without spaces, encoded data) its characters. It
is parsed into dictionary phrases: each phrase is the shortest run of symbols
not yet in the dictionary, which it then joins. The set of phrases is hashed,
and the minima of the hashes under fixed keyed permutations are the
fingerprint. The share of equal minima estimates how much of their phrase
dictionaries two texts have in common, as a compressor would find it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, written

K = 32
LONG_WORD = 48
_BASE = 0x9E3779B97F4A7C15
_SALTS = mix64(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def symbols(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").split()
    if not words or max(map(len, words)) <= LONG_WORD:
        return words
    out: list[bytes] = []
    for w in words:
        if len(w) <= LONG_WORD:
            out.append(w)
        else:
            out.extend(c.encode("utf-8", "surrogatepass") for c in w.decode("utf-8", "surrogatepass"))
    return out


def parse(row: list[bytes]) -> list[int]:
    """Ends of the phrases; a last phrase may be one that is known."""
    root: dict = {}
    here, ends, i = root, [], 0
    for i, symbol in enumerate(row, 1):
        after = here.get(symbol)
        if after is None:
            here[symbol] = {}
            ends.append(i)
            here = root
        else:
            here = after
    if here is not root:
        ends.append(i)
    return ends


def _powers(n: int, held: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """B^i and B^-i modulo 2^64 for i below ``n``; the tables grow by doubling
    with the longest text seen."""
    if not held or len(held[0]) < n:
        size = 1 << max(14, n.bit_length())
        held[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            held.append(np.multiply.accumulate(p))
    return held[0], held[1]


def phrase_hashes(row: list[bytes], ends: list[int], step: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of each phrase, told by its symbols alone; ``step``
    phrases at a time, so a long text needs no long tables."""
    out = np.empty(len(ends), np.uint64)
    first = 0
    for s in range(0, len(ends), step):
        stop = np.array(ends[s:s + step], dtype=np.int64)
        part = row[first:ends[min(s + step, len(ends)) - 1]]
        size = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        begin_of = np.concatenate((np.zeros(1, np.int64), np.cumsum(size + 1)))
        bytes_ = np.frombuffer(b" ".join(part), dtype=np.uint8)
        power, back = _powers(len(bytes_) + 1)
        sums = np.zeros(len(bytes_) + 1, dtype=np.uint64)
        np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * power[:len(bytes_)], out=sums[1:])
        stop -= first
        begin = np.concatenate((np.zeros(1, np.int64), stop[:-1]))
        lo, hi = begin_of[begin], begin_of[stop] - 1
        out[s:s + step] = mix64((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))
        first += int(stop[-1])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """K minima (32 bits each); all ones for an empty set."""
    out = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(hashes), 1 << 14):
        keyed = (hashes[s:s + (1 << 14), None] ^ _SALTS[None, :]) * np.uint64(0xC4CEB9FE1A85EC53)
        keyed ^= keyed >> np.uint64(29)
        keyed *= np.uint64(0xFF51AFD7ED558CCD)
        out = np.minimum(out, (keyed.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return out


def fingerprint(text: str) -> np.ndarray:
    row = symbols(text)
    return signature(phrase_hashes(row, parse(row)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / K


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The text with its last quarter of characters replaced by the first as
    many characters, or all, of the following text."""
    m = len(text) // 4
    return text[:len(text) - m] + following[:m]


_PAIR = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                   ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                   ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_PAIR_SQL = ("kind int, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
             "edited_fingerprint binary, near_edited double, near_next double, text string")
PAIR, FIRST, LAST = 0, 1, 2


def _packed(sig: np.ndarray) -> bytes:
    return sig.astype(">u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=">u4")


def _pair(doc_id: int, text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    edited = edit(text, following)
    other = fingerprint(edited)
    return (PAIR, None, doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            _packed(own), _packed(other), likeness(own, other), likeness(own, next_print), None)


def _batched(rows: Iterator[tuple], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PAIR)], schema=_PAIR)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PAIR)], schema=_PAIR)


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of consecutive rows of a task, and its first and last document."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = fingerprint(text)
                if last is None:
                    yield (FIRST, part, doc_id, None, None, _packed(own), None, None, None, text)
                else:
                    yield _pair(*last, text, own)
                last = (doc_id, text, own)
        if last is not None:
            yield (LAST, part, last[0], None, None, _packed(last[2]), None, None, None, last[1])

    yield from _batched(rows())


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _pair(r["doc_id"], r["text"], _unpacked(r["own"]), r["next_text"], _unpacked(r["next_print"]))

    yield from _batched(rows())


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row of ``docs`` (doc_id, text), fingerprints
    as binary. The next document is the one with the next doc_id; the last
    one's is the first.

    Null texts are empty; an empty text has the fingerprint of no phrases,
    which is like itself alone. Rows of one doc_id are ordered by text hash, a
    null doc_id comes first; a single row is its own next; an empty table
    gives no rows; other columns are ignored.

    The texts move once, range-sorted by id. Each task pairs what it has and
    passes on its first and last document; these two rows a task are joined.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    found = written(ordered.mapInArrow(_stretch, _PAIR_SQL), "lz-pairs")
    firsts = found.where(F.col("kind") == FIRST).select("part", "text", "fingerprint")
    parts = firsts.select("part")  # one row per task that had documents
    every = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(
        Window.partitionBy(F.lit(0)))).alias("next_part"))
    heads = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                          F.col("fingerprint").alias("next_print"))
    seams = (found.where(F.col("kind") == LAST).select("part", "doc_id", "text", F.col("fingerprint").alias("own"))
             .join(after, "part").join(heads, "next_part")
             .select("doc_id", "text", "own", "next_text", "next_print").mapInArrow(_seams, _PAIR_SQL))
    return found.where(F.col("kind") == PAIR).unionByName(seams).drop("kind", "part", "text")
