"""Collocations from a weighted de Bruijn graph of words.

Every word of a piece starts one edge of the graph: the ``LONGEST`` words from
there on, the overlap of two nodes of ``LONGEST`` - 1 words. Where the piece
ends sooner the edge is filled up with an end mark (0); these edges are the
piece-end corrections. Only edges are counted over the corpus. The count of a
shorter phrase is the flow of its node: the weights of all edges that begin
with it, end-marked ones included.

0. Sketch: words are counted into ``CELLS`` cells by hash. A word whose cell
   stays below ``min_count`` is certainly rarer than that, so no candidate holds
   it. It ends a piece like a delimiter does: the flow of the nodes before it is
   the same. The sketch has a fixed size; when many words share its cells it
   spares less and loses nothing.
1. Scan: an Arrow task turns words into numbers of its own, counts its edges by
   one sort, and deals them in packets, one for each bucket of the first two
   words: a word list and columns of numbers, compressed.
2. A task that reads a bucket with more edges than it should sort deals them
   again instead, packet by packet: by more bits of the first two words, then
   by three, then by four words. So a pair that starts a third of all edges is
   spread over many tasks. Nothing is dropped.
3. Merge: a task sorts the edges of one bucket and reads flows off the sorted
   run. Nodes with one way on and no piece end carry the same flow as the edge
   that follows; such unary paths leave as one row (words, from length, to
   length, weight). Nodes whose edges lie in one bucket are complete and leave
   only with ``min_count`` or more; flows of single words, and of nodes split
   over buckets, leave as parts and are summed.

Phrases are told by their words, never by hashes; hashes only choose buckets
and cells.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, written

LONGEST = 4
END = 0
#: First words that choose an edge's bucket, by round of splitting.
ROUNDS = (2, 2, 3, 4)
FLUSH_WORDS = 1_500_000
BUCKET_EDGES = 4_000_000
MAX_FAN_OUT = 4096
AGAIN = 64  # buckets that a bucket is split into
CELLS = 1 << 26
CHUNKS = 256  # rows that a sketch travels in

_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Piece delimiters become 0xFF, a byte that UTF-8 never has.
_CUT = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else _TO_LOWER[b] for b in range(256))
PACKETS = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("edges", pa.int64()), ("packet", pa.binary())])
SKETCH = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("chunk", pa.int32()), ("cells", pa.binary())])
FLOWS = pa.schema([*PACKETS, ("words", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("flow", pa.int64())])


class _Numbers(dict):
    """Word -> its number from 1, in order of appearance; 0 where a piece ends."""

    def __init__(self):
        super().__init__({b"\xff": END})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def words(self) -> list[bytes]:
        return list(self)[1:]


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _seed(lang: str, level: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), level)


def _cells(words: list[bytes], lang: str) -> np.ndarray:
    return (_hashes(words, _seed(lang, 99)) % np.uint64(CELLS)).astype(np.int64)


class _Kept:
    """Words of one language that may be frequent, with numbers from 1; others
    and the piece mark have number 0. Emptied with each flush."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.lang, self.frequent = lang, frequent
        self.number: dict[bytes, int] = {b"\xff": END}
        self.words: list[bytes] = []

    def row(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.number))
        if new:
            cells = _cells(new, self.lang)
            may = (self.frequent[cells >> 3] >> (cells & 7)) & 1
            for word, kept in zip(new, may.tolist(), strict=True):
                if kept:
                    self.words.append(word)
                    self.number[word] = len(self.words)
                else:
                    self.number[word] = END
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words))


def piece_words(text: str) -> list[bytes]:
    """Words of a text, lower-cased A-Z, with b'\\xff' wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_CUT).replace(b"\xff", b" \xff ").split()


def _grouped(columns: list[np.ndarray], size: int) -> np.ndarray:
    """An order that puts equal rows of ``columns`` (numbers below ``size``)
    side by side and equal beginnings too."""
    if size ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * size + c
        return np.argsort(key, kind="stable")
    return np.lexsort(columns[::-1])


def _new(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Per depth d the rows (of sorted columns) where the first d+1 differ
    from the row before."""
    out, seen = [], None
    for c in columns:
        differs = np.empty(len(c), dtype=bool)
        differs[:1] = True
        np.not_equal(c[1:], c[:-1], out=differs[1:])
        seen = differs if seen is None else seen | differs
        out.append(seen)
    return out


def edges_of(row: np.ndarray) -> list[np.ndarray]:
    """The edges that the words of ``row`` (0 where a piece ends) start."""
    padded = np.concatenate([row, np.zeros(LONGEST, dtype=row.dtype)])
    at = np.flatnonzero(row)
    columns, going = [padded[at]], np.ones(len(at), dtype=bool)
    for d in range(1, LONGEST):
        following = np.where(going, padded[at + d], END)
        going = following != END
        columns.append(following)
    return columns


def summed(columns: list[np.ndarray], weights: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct edges, sorted, and their weights (each row 1 if none given)."""
    order = _grouped(columns, size)
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(_new(columns)[-1]) if len(order) else order
    if weights is None:
        weights = np.diff(np.append(starts, len(order)))
    elif len(order):
        weights = np.add.reduceat(weights[order], starts)
    return [c[starts] for c in columns], weights.astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: small
    numbers leave runs of zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(raw: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n) if n else np.zeros((np.dtype(kind).itemsize, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(words: list[bytes], columns: list[np.ndarray], weights: np.ndarray) -> bytes:
    """A packet: its own sorted word list, then the columns in its own
    numbers, in order, so that a column's numbers differ little."""
    used, inside = np.unique(np.concatenate([np.zeros(1, dtype=np.int32), *columns]), return_inverse=True)
    listed = sorted((words[i - 1], at) for at, i in enumerate(used.tolist()) if at)
    to = np.zeros(len(used), dtype=np.uint32)
    to[[at for _, at in listed]] = np.arange(1, len(used), dtype=np.uint32)
    rows = to[inside[1:]].reshape(LONGEST, -1)
    order = _grouped(list(rows), len(used))
    names = b"\n".join([w for w, _ in listed])
    head = np.array([len(names), len(weights)], dtype=np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join([head, names, *(_planes(c[order]) for c in rows), _planes(weights[order])]))


def _unpack(packet: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, columns, weights); word i has number i + 1."""
    raw = zstandard.ZstdDecompressor().decompress(packet)
    n_bytes, n = (int(x) for x in np.frombuffer(raw, dtype=np.uint64, count=2))
    at = 16 + n_bytes
    columns = [_values(raw[at + 4 * n * i:at + 4 * n * (i + 1)], n, np.uint32).astype(np.int32) for i in range(LONGEST)]
    return raw[16:at].split(b"\n"), np.stack(columns), _values(raw[at + 4 * n * LONGEST:], n, np.int64)


def _dealt(words: list[bytes], columns: list[np.ndarray], weights: np.ndarray, level: int, fan_out: int, parent: int,
           lang: str) -> Iterator[tuple]:
    """Packets (bucket, lang, edges, packet) of the edges, by the hash of
    their first words. A bucket's number holds its parent's."""
    hashes = np.concatenate([np.zeros(1, dtype=np.uint64), _hashes(words, level)])
    key = np.full(len(weights), _seed(lang, level), dtype=np.uint64)
    for c in columns[:ROUNDS[level]]:
        key = mix64(key ^ hashes[c])
    bucket = (key % np.uint64(fan_out)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = order[lo:hi]
        yield (parent * MAX_FAN_OUT + int(bucket[rows[0]]), lang, hi - lo,
               _pack(words, [c[rows] for c in columns], weights[rows]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, held: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of packets as batches of about ``held`` bytes."""
    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), PACKETS.types, strict=True)]
        columns += [pa.nulls(len(some), t) for t in schema.types[len(columns):]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[3])
        if size >= held:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


def _sketch(flush: int):
    """mapInArrow: texts (lang, text) to (lang, words, chunk, cells), counts of
    cells by chunk, and once a flush each language's number of words."""
    width = CELLS // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, collections.Counter] = {}
        n = 0

        def emptied() -> pa.RecordBatch:
            rows, cells, counts = [], [], []
            for lang, counter in held.items():
                total = sum(counter.values()) - counter.pop(b"\xff", 0)
                rows.append((lang, total, None, None))
                cells.append(_cells(list(counter), lang))
                counts.append(np.fromiter(counter.values(), dtype=np.int64, count=len(counter)))
            held.clear()
            cells, counts = np.concatenate(cells), np.concatenate(counts)
            order = np.argsort(cells)
            cells, starts = np.unique(cells[order], return_index=True)
            counts = np.minimum(np.add.reduceat(counts[order], starts), 1 << 30).astype(np.uint32) if len(starts) else counts
            cuts = np.searchsorted(cells, np.arange(0, CELLS + 1, width)).tolist()
            pack = zstandard.ZstdCompressor(level=1).compress
            for chunk, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if hi > lo:
                    steps = np.diff(cells[lo:hi], prepend=chunk * width).astype(np.uint32)
                    rows.append((None, None, chunk, pack(_planes(np.concatenate([steps, counts[lo:hi]])))))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SKETCH.types, strict=True)], schema=SKETCH)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = piece_words(text.as_py())
                held.setdefault(lang, collections.Counter()).update(words)
                n += len(words)
                if n >= flush:
                    yield emptied()
                    n = 0
        if held:
            yield emptied()

    return run


def _chunk_bits(min_count: int):
    """applyInArrow: the parts of a chunk to one bit a cell: it may hold a word
    of ``min_count`` or more."""
    width = CELLS // CHUNKS

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("cells"):
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
                steps, more = np.split(_values(raw, len(raw) // 4, np.uint32), 2)
                counts[np.cumsum(steps.astype(np.int64))] += more
        bits = np.packbits(counts >= min_count, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bits"])

    return run


def frequent_cells(texts: DataFrame, min_count: int, flush: int) -> tuple[np.ndarray, DataFrame]:
    """(a bit for each cell that may hold a frequent word, in CELLS / 8 bytes;
    (lang, n), the words of each language)."""
    parts = written(texts.mapInArrow(_sketch(flush), "lang string, words long, chunk int, cells binary"), "phrases-sketch")
    bits = np.zeros(CELLS // 8, dtype=np.uint8)
    width = len(bits) // CHUNKS
    chunks = parts.where("chunk is not null").select("chunk", "cells")
    for row in chunks.groupBy("chunk").applyInArrow(_chunk_bits(min_count), "chunk int, bits binary").collect():
        bits[row["chunk"] * width:(row["chunk"] + 1) * width] = np.frombuffer(row["bits"], dtype=np.uint8)
    totals = parts.where("chunk is null").groupBy("lang").agg(F.sum("words").alias("n"))
    return bits, totals


def _scan(frequent, fan_out: int, flush: int):
    """mapInArrow: texts (lang, text) to packets of counted edges."""
    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[str, tuple[_Kept, list[np.ndarray]]] = {}
        n = 0
        end = np.zeros(1, dtype=np.int32)

        def emptied() -> Iterator[tuple]:
            for lang, (kept, rows) in held.items():
                columns, weights = summed(edges_of(np.concatenate(rows)), None, len(kept.words) + 1)
                if len(weights):
                    yield from _dealt(kept.words, columns, weights, 0, fan_out, 1, lang)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = piece_words(text.as_py())
                if lang not in held:
                    held[lang] = (_Kept(lang, frequent.value), [])
                kept, rows = held[lang]
                rows += (kept.row(words), end)
                n += len(words)
                if n >= flush:
                    yield from emptied()
                    n = 0
        yield from emptied()

    return lambda batches: _batches(packets(batches), PACKETS)


def _flows(packets: list[bytes], whole: int, min_count: int) -> tuple[list[str], list[int], list[int], np.ndarray]:
    """(words, from length, to length, flow) of the nodes of one bucket; nodes
    of ``whole`` words or more are complete in it."""
    numbers, all_columns, all_weights = _Numbers(), [], []
    while packets:
        words, columns, weights = _unpack(packets.pop())
        to = np.concatenate([np.zeros(1, dtype=np.int32),
                             np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))])
        all_columns.append(to[columns])
        all_weights.append(weights)
    columns, weights = summed(list(np.concatenate(all_columns, axis=1)), np.concatenate(all_weights), len(numbers))
    words = [b"", *numbers.words()]
    begins, flows = _new(columns), []
    for begin in begins:  # flow of each node at its first edge
        starts = np.flatnonzero(begin)
        f = np.zeros(len(weights), dtype=np.int64)
        f[starts] = np.add.reduceat(weights, starts)
        flows.append(f)
    texts, lows, highs, counts = [], [], [], []

    def leave(at: np.ndarray, lo: int, hi: int) -> None:
        listed = zip(*(columns[d][at].tolist() for d in range(hi)), strict=True)
        texts.extend(b" ".join([words[i] for i in w]).decode("utf-8", "surrogatepass") for w in listed)
        lows.extend([lo] * len(at))
        highs.extend([hi] * len(at))
        counts.append(flows[lo - 1][at])

    for d in range(1, whole):  # parts
        leave(np.flatnonzero(begins[d - 1] & (columns[d - 1] != END)), d, d)
    for lo in range(whole, LONGEST + 1):  # unary paths over complete nodes
        head = begins[lo - 1] & (columns[lo - 1] != END) & (flows[lo - 1] >= min_count)
        if lo > whole:
            head &= ~(begins[lo - 2] & (flows[lo - 2] == flows[lo - 1]))
        for hi in range(lo, LONGEST + 1):
            if hi > lo:  # the path goes on while the one edge carries all of the flow
                head &= (columns[hi - 1] != END) & (flows[hi - 1] == flows[lo - 1])
            stops = head if hi == LONGEST else head & ((columns[hi] == END) | (flows[hi] != flows[lo - 1]))
            leave(np.flatnonzero(stops), lo, hi)
    return texts, lows, highs, np.concatenate(counts)


def _merge(level: int, min_count: int, bucket_edges: int):
    """applyInArrow: one bucket's packets to flows; if they hold more than
    ``bucket_edges`` edges, to the packets of smaller buckets."""
    def again(held: list[bytes], batches: Iterator[pa.RecordBatch], bucket: int, lang: str) -> Iterator[tuple]:
        def every() -> Iterator[bytes]:
            while held:
                yield held.pop()
            for batch in batches:
                yield from (p.as_py() for p in batch.column("packet"))
        for packet in every():
            words, columns, weights = _unpack(packet)
            yield from _dealt(words, list(columns), weights, level + 1, AGAIN, bucket, lang)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, lang = (k.as_py() for k in key)
        held, edges = [], 0
        for batch in batches:
            held += batch.column("packet").to_pylist()
            edges += sum(batch.column("edges").to_pylist())
            if edges > bucket_edges and level + 1 < len(ROUNDS):
                yield from _batches(again(held, batches, bucket, lang), FLOWS)
                return
        texts, lows, highs, counts = _flows(held, ROUNDS[level], min_count)
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array([lang] * n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
             pa.array(texts, pa.string()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(counts, pa.int64())],
            schema=FLOWS)

    return run


def phrase_counts(docs: DataFrame, min_count: int = 30, bucket_edges: int = BUCKET_EDGES, flush: int = FLUSH_WORDS
                  ) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, count): every phrase of 1 to 4 words that stands
    ``min_count`` times or more in the pieces of its language; (lang, n): its
    words). Null texts count as empty, a null lang is 'und'."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    bits, totals = frequent_cells(texts, min_count, flush)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes some six bytes
    fan_out = int(min(MAX_FAN_OUT, max(1, -(-size // (6 * (bucket_edges // 3))))))
    frequent = docs.sparkSession.sparkContext.broadcast(bits)
    packets = texts.mapInArrow(_scan(frequent, fan_out, flush), "bucket long, lang string, edges long, packet binary")
    merged = None
    for level in range(len(ROUNDS)):
        out = written(packets.groupBy("bucket", "lang").applyInArrow(
            _merge(level, min_count, bucket_edges),
            "bucket long, lang string, edges long, packet binary, words string, lo int, hi int, flow long"), "phrases-flows")
        flows = out.where("packet is null").select("lang", "words", "lo", "hi", "flow")
        merged = flows if merged is None else merged.unionByName(flows)
        packets = out.where("packet is not null").select("bucket", "lang", "edges", "packet")
        if not packets.limit(1).count():
            break
    phrases = merged.select("lang", F.explode(F.sequence("lo", "hi")).alias("words"), F.col("words").alias("path"), "flow").select(
        "lang", F.expr("substring_index(path, ' ', words)").alias("phrase"), "words", "flow")
    counted = phrases.groupBy("lang", "phrase", "words").agg(F.sum("flow").alias("count"))
    return counted.where(F.col("count") >= min_count), totals


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, covered_percent: int = 80, scale: int = 2_000_000,
                 bucket_edges: int = BUCKET_EDGES, flush: int = FLUSH_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) for the ``top`` phrases a language.

    A phrase of 2 to 4 words with a = count >= ``min_count`` is cut after each
    of its words into parts of counts l and r; its score is the least of
    floor(scale * a / (l + r)), ties to the first cut. It goes if a longer
    candidate that holds its words side by side has ``covered_percent`` or more
    of its count. Ranked by score, then a, descending, then phrase by bytes.
    n counts the language's words. Arithmetic is in whole decimals.

    Null and empty texts and pieces have no words; a null lang is 'und';
    repeated rows count each time; an empty table gives no rows; other columns
    are ignored. Words may hold any character but blanks and delimiters.
    """
    counts, totals = phrase_counts(docs, min_count, bucket_edges, flush)
    frequent = written(counts, "phrases-counts")
    candidates = frequent.where("words > 1").withColumnRenamed("count", "a")

    whole = lambda c: F.col(c).cast("decimal(20,0)")
    # the counts of the parts of every cut
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.expr("substring_index(phrase, ' ', k)").alias("part")),
        F.struct(F.lit(False).alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("part")))).alias("s"))
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"))
    met = sides.select("lang", "phrase", "a", "k", "s.first", "s.part").join(parts, ["lang", "part"])
    scored = met.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    scored = scored.withColumn("score", F.expr(
        f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # the largest count of a longer candidate around each phrase
    inside = candidates.where("words > 2").select("lang", "words", F.col("a").alias("longer"), F.split("phrase", " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    around = (inside.select("lang", "longer", F.explode(spans).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered_percent))
    place = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                                              F.col("cut.score").alias("score"))
