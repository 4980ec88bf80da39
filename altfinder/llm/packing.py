"""Packing documents into fixed windows by lexical retrieval.

A document is tokenized and ends with id 0. Its full windows are sequences of
their own; what is left over is packed, and stands for the whole document's
terms. Documents are dealt to shards of bounded size by content: a tree of
balanced cuts through their weighted terms, so that neighbours meet. A shard's
inverted index is scored by BM25 with the corpus's document frequencies: a seed
asks its shard for unused neighbours, best first, and they fill its window
greedily. The neighbour that does not fit is cut; its rest
seeds the next window. The last tokens of a shard become sequences of
power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 1024
SPECIAL = "<|endoftext|>"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: PATTERN without its look ahead, which only matters inside a run of white
#: space. Cut such runs before their last character if a word follows, and this
#: cuts the parts as PATTERN does the text, in one pass; ASCII texts need few classes.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(rf"[{SPACE}](?=[{SPACE}][^{SPACE}])")
FAST = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoding(cuts: str, ranks: dict[bytes, int]):
    import tiktoken

    class Encoding(tiktoken.Encoding):
        def encode_ordinary(self, text: str) -> list[int]:
            ends = [run.end() for run in CUT.finditer(text)]
            if not ends:
                return super().encode_ordinary(text)
            return [i for b, e in zip([0, *ends], [*ends, len(text)]) for i in super(Encoding, self).encode_ordinary(text[b:e])]

    return Encoding("whole", pat_str=cuts, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Encodes whole texts, each in one call but for runs of white space;
    loaded once per worker."""

    _loaded: dict[str, Tokens] = {}

    def __init__(self, path: str):
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        self.plain, self.ascii = _encoding(FAST, ranks), _encoding(ASCII, ranks)

    @classmethod
    def at(cls, path: str) -> Tokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str) -> np.ndarray:
        """The ids that the tokenizer file gives to the whole text."""
        if SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u2")
        encoding = self.ascii if text.isascii() else self.plain
        return np.frombuffer(array("H", encoding.encode_ordinary(text)), dtype=np.uint16)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_DOC = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("crcs", pa.list_(pa.int64())),
                  ("rest", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary())])


def _tokenized(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, weight = Tokens.at(path), [], 0
        for batch in batches:
            docs, texts = batch.columns
            for i in range(batch.num_rows):
                ids = np.append(tokens.encode(texts[i].as_py() or ""), np.uint16(0))
                full = len(ids) // window
                rest = ids[full * window:]
                held.append((docs[i].as_py(), len(ids), [crc(ids[k * window:(k + 1) * window]) for k in range(full)],
                             rest.astype("<u2").tobytes(), *bag_bytes(ids if len(rest) else rest[:0])))
                weight += 8 * len(rest) + 8 * full
                if weight >= 4 << 20 or len(held) >= 5_000:
                    yield _rows(held, _DOC)
                    held, weight = [], 0
        if held:
            yield _rows(held, _DOC)

    return run


def bag_bytes(ids: np.ndarray) -> tuple[bytes | None, bytes | None]:
    if not len(ids):
        return None, None
    ids = np.sort(ids, kind="stable")  # by digits, as these are 16 bits
    at = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
    return ids[at].astype("<u2").tobytes(), np.diff(at, append=len(ids)).astype("<u4").tobytes()


def bag(rest: bytes, terms: bytes | None, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document with a left-over, and how often it has each."""
    if terms is None:
        return np.unique(np.frombuffer(rest, dtype="<u2"), return_counts=True)
    return np.frombuffer(terms, dtype="<u2"), np.frombuffer(counts, dtype="<u4").astype(np.int64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents with a left-over have each id in this task; id -1:
    how many there are, and their tokens."""
    df, docs, tokens = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for batch in batches:
        for rest, terms, counts in zip(*(batch.column(c) for c in ("rest", "terms", "counts"))):
            ids, n = bag(rest.as_py(), terms.as_py(), counts.as_py())
            df[ids] += 1
            docs += bool(len(ids))
            tokens += int(n.sum())
    has = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1).astype(np.int32)), pa.array(np.append(df[has], docs)),
                                      pa.array(np.append(np.zeros(len(has), np.int64), tokens))], names=["id", "n", "tokens"])


K1, B = 1.2, 0.75


def weighed(term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a document that have weight, and their BM25 weights."""
    size, worth = tf.sum(), idf[term]
    has = worth > 0
    term, tf, worth = term[has], tf[has], worth[has]
    return term, worth * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


DIMENSIONS = 128


@functools.cache
def _directions() -> np.ndarray:
    """A fixed row of random signs per id, a byte each."""
    return np.random.default_rng(8).choice(np.array([-1, 1], dtype=np.int8), (1 << 16, DIMENSIONS))


def point(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted terms as a vector of length 1 (in expectation), projected."""
    size = float(np.sqrt((weight ** 2).sum()))
    if not size:
        return np.zeros(DIMENSIONS, dtype=np.float32)
    return (weight.astype(np.float32) / size) @ _directions()[term].astype(np.float32) / np.float32(np.sqrt(DIMENSIONS))


def tree(points: np.ndarray, sizes: np.ndarray, most: float, least: int = 8) -> list[tuple[np.ndarray, float, int, int]]:
    """Nodes (direction, cut, below, above) of balanced cuts between two means,
    down to cells of ``most`` in size or under ``least`` sampled points. A child
    under 0 is a cell; cells are numbered -1, -2, ... in the tree's order."""
    nodes: list[tuple[np.ndarray, float, int, int]] = []
    cells = 0

    def split(at: np.ndarray) -> int:
        nonlocal cells
        if len(at) >= least and sizes[at].sum() > most:
            x = points[at]
            centre = x[np.random.default_rng(len(at)).choice(len(at), 2, replace=False)]
            for _ in range(8):
                side = x @ (centre[0] - centre[1]) > ((centre[0] ** 2).sum() - (centre[1] ** 2).sum()) / 2
                if side.all() or not side.any():
                    break
                centre = np.stack([x[side].mean(0), x[~side].mean(0)])
            along = x @ (centre[0] - centre[1])
            order = np.argsort(along, kind="stable")
            held = np.cumsum(sizes[at][order])
            middle = min(max(1, int(np.searchsorted(held, held[-1] / 2))), len(at) - 1)
            cut = float(along[order[middle]])
            below = along < cut
            if below.any():
                me = len(nodes)
                nodes.append((centre[0] - centre[1], cut, 0, 0))
                nodes[me] = (*nodes[me][:2], split(at[below]), split(at[~below]))
                return me
        cells += 1
        return -cells

    split(np.arange(len(points)))
    return nodes


FINE = 8


def _cells(nodes: list[tuple[np.ndarray, float, int, int]], idf: np.ndarray, mean: float):
    """With the content key of each document as ``mark``: its cell, then the
    sides of ``FINE`` fixed directions on which it lies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for rest, terms, counts in zip(*(batch.column(c) for c in ("rest", "terms", "counts"))):
                x = point(*weighed(*bag(rest.as_py(), terms.as_py(), counts.as_py()), idf, mean))
                at = 0 if nodes else -1
                while at >= 0:
                    direction, cut, below, above = nodes[at]
                    at = above if float(x @ direction) >= cut else below
                marks.append((-1 - at) << FINE | int((x[:FINE] > 0) @ (1 << np.arange(FINE))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int32())], names=[*batch.schema.names, "mark"])

    return run


class Index:
    """BM25 over the documents of one shard; ids in more than half of all
    documents have no weight."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        self.size, self.terms = len(docs), []
        doc_of, weights = [], []
        for i, (ids, counts) in enumerate(docs):
            term, weight = weighed(ids, counts, idf, mean)
            self.terms.append(term)
            doc_of.append(np.full(len(term), i, dtype=np.int64))
            weights.append(weight)
        term = np.concatenate(self.terms) if docs else np.empty(0, np.uint16)
        order = np.argsort(term, kind="stable")
        self.doc_of = np.concatenate(doc_of)[order] if docs else np.empty(0, np.int64)
        self.weight = np.concatenate(weights)[order] if docs else np.empty(0)
        self.at = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, doc: int) -> np.ndarray:
        terms = self.terms[doc]
        begin, end = self.at[terms], self.at[terms.astype(np.int64) + 1]
        n = end - begin
        place = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(terms) else np.empty(0, np.int64)
        return np.bincount(self.doc_of[place], weights=self.weight[place], minlength=self.size)


NEAR = 64


def ranked(scores: np.ndarray) -> Iterator[int]:
    """Places by falling score, equal ones in order. Few are asked for, so the
    best come first from a part of the scores, the others if need be."""
    seen = 0
    if len(scores) > 2 * NEAR:
        best = np.flatnonzero(scores >= np.partition(scores, -NEAR)[-NEAR])
        yield from best[np.argsort(-scores[best], kind="stable")]
        seen = len(best)
    yield from np.argsort(-scores, kind="stable")[seen:]


def fill(docs: list[np.ndarray], bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float,
         window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (doc, begin, end) pieces; all but the last are full."""
    index = Index(bags, idf, mean)
    free = np.ones(len(docs), dtype=bool)
    seed, begin, upto = -1, 0, 0  # a cut neighbour's rest seeds the next window
    while True:
        if seed < 0:
            while upto < len(docs) and not free[upto]:
                upto += 1
            if upto == len(docs):
                return
            seed, begin = upto, 0
            free[seed] = False
        pieces, room = [(seed, begin, len(docs[seed]))], window - (len(docs[seed]) - begin)
        best = None
        rest = -1
        while room > 0:
            if best is None:
                best = ranked(np.where(free, index.scores(seed), -1.0))
            near = next(best, None)
            if near is None or not free[near]:
                break
            free[near] = False
            take = min(room, len(docs[near]))
            pieces.append((int(near), 0, take))
            room -= take
            if take < len(docs[near]):
                rest = int(near)
                left = take
        yield pieces
        if rest >= 0:
            seed, begin = rest, left
        else:
            seed = -1


def halves(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces re-cut into runs whose lengths are powers of two."""
    left = sum(e - b for _, b, e in pieces)
    pieces = list(pieces)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        run = []
        while room:
            doc, b, e = pieces[0]
            take = min(room, e - b)
            run.append((doc, b, b + take))
            room -= take
            if b + take == e:
                pieces.pop(0)
            else:
                pieces[0] = (doc, b + take, e)
        yield run


_OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(idf: np.ndarray, mean: float, window: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "uid"], na_position="first")
        base, at, out = int(shard["shard"].iloc[0]) << 32, 0, []
        ids, count = shard["doc_id"].tolist(), shard["tokens"].tolist()
        for doc, n, crcs in zip(ids, count, shard["crcs"]):
            for k, c in enumerate(crcs):
                out.append((doc, k * window, window, c, n, base + at, 0))
                at += 1
        rests = [np.frombuffer(r, dtype="<u2") for r in shard["rest"]]
        has = [i for i, r in enumerate(rests) if len(r)]
        bags = [bag(*x) for x in zip(shard["rest"], shard["terms"], shard["counts"])]
        for pieces in fill([rests[i] for i in has], [bags[i] for i in has], idf, mean, window):
            whole = sum(e - b for _, b, e in pieces) == window
            for part in [pieces] if whole else halves(pieces):
                offset = 0
                for doc, b, e in part:
                    i = has[doc]
                    head = count[i] - len(rests[i])
                    out.append((ids[i], head + b, e - b, crc(rests[i][b:e]), count[i], base + at, offset))
                    offset += e - b
                at += 1
        columns = [c.split()[0] for c in _OUT.split(", ")]
        return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in zip(columns, zip(*out))}, columns=columns)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = 400_000,
         sample: int = 4_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per
    piece; the pieces of a document are its ids, each once.

    Null and empty texts are the one id 0. Rows repeated with one doc_id are
    packed each for itself; a null doc_id stays null; an empty table gives no
    rows; other columns are ignored.

    Shards: a tree of balanced cuts is grown on the driver from ``sample``
    documents (smallest hashed id and left-over), and its cells are parted by a few fixed
    directions. Small parts next to each other share a shard; only what lies in
    one part and is too large is split by hash, so no shard holds much over
    ``shard_tokens``. The tables on the driver, document frequencies, sample and
    shard plan, have a bounded number of rows.
    """
    path = tokenizer or default_tokenizer()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _tokenized(path, window), "doc_id bigint, tokens bigint, crcs array<bigint>, rest binary, terms binary, counts binary")
    held = written(read.select(F.monotonically_increasing_id().alias("uid"), "*"), "pack-tokens")
    stats = (held.select("rest", "terms", "counts").mapInArrow(_frequencies, "id int, n bigint, tokens bigint")
             .groupBy("id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).toPandas())
    total = stats[stats["id"] == -1]
    n_docs, n_tokens = (int(total["n"].iloc[0]), int(total["tokens"].iloc[0])) if len(total) else (0, 0)
    df = np.zeros(1 << 16)
    known = stats[stats["id"] >= 0]
    df[known["id"].to_numpy(np.int64)] = known["n"].to_numpy()
    idf = np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5))) * (df > 0)
    mean = n_tokens / max(1, n_docs)
    # a cutoff first, so that what the tasks send does not grow with their number
    place, span = F.pmod(F.xxhash64("doc_id", "rest"), F.lit(1 << 30)), min(1 << 30, math.ceil((1 << 30) * 2 * sample / max(1, n_docs)))
    seen = (held.where(F.octet_length("rest") > 0).select(place.alias("at"), "rest", "terms", "counts").where(F.col("at") < span)
            .orderBy("at", "rest").limit(sample).collect())
    points = np.array([point(*weighed(*bag(r.rest, r.terms, r.counts), idf, mean)) for r in seen]).reshape(-1, DIMENSIONS)
    in_rest = np.array([len(r.rest) / 2 for r in seen])
    per_row = n_docs / max(1, len(seen))
    nodes = tree(points, in_rest * per_row, shard_tokens)
    keys = held.select("uid", "doc_id", "tokens", "crcs", "rest", "terms", "counts")
    held = written(keys.mapInArrow(_cells(nodes, idf, mean), "uid bigint, doc_id bigint, tokens bigint, crcs array<bigint>, "
                                   "rest binary, terms binary, counts binary, mark int"), "pack-cells")
    sizes = (held.groupBy("mark").agg(F.sum(F.octet_length("rest") / 2 + F.size("crcs")).alias("tokens")).orderBy("mark").toPandas())
    plan, shard, room = [], 0, shard_tokens
    for mark, tokens in zip(sizes["mark"].tolist(), sizes["tokens"].tolist()):
        if tokens > shard_tokens:
            parts = int(-(-tokens // shard_tokens))
            plan.append((mark, shard + 1, parts))
            shard, room = shard + parts, 0
            continue
        if tokens > room:
            shard, room = shard + 1, shard_tokens
        plan.append((mark, shard, 1))
        room -= tokens
    spark = docs.sparkSession
    where = spark.createDataFrame(plan, "mark int, base bigint, parts int")
    dealt = held.join(F.broadcast(where), "mark").withColumn(
        "shard", F.col("base") + F.pmod(F.xxhash64("uid"), F.col("parts")))
    return dealt.select("shard", "uid", "doc_id", "tokens", "crcs", "rest", "terms", "counts").groupBy("shard").applyInPandas(
        _packed(idf, mean, window), _OUT)
