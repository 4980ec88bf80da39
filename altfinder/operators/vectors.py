"""Vectors: embedding (V1, V2), dimension checks and bookkeeping (V5, V6),
exact cosine k-NN (V3) and approximate k-NN over k-means cells (V4).

Exact k-NN never materialises query x vector pairs as rows: queries and
vectors are dealt into packed blocks of bounded size, each row once, and a task
takes a block of queries past all blocks of vectors, scored in numpy. Blocks are
bounded no matter how the data is skewed, and nothing goes through the driver.

It ends in a per-query row_number() window whose partial limit runs before
the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altfinder.functions import text as tx
from altfinder.operators import blocks as bk
from altfinder.operators.blocks import NO_ID

DEFAULT_DIM = 64
TERMS_AT_ONCE = 1 << 17
COS_DECIMALS = 6


# --------------------------------------------------------------------------- checks

def _norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def check_dimension(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """V5: rows get ``reject_reason`` when the vector is missing, has the
    wrong size, or is all zeros (no cosine exists for it)."""
    v = F.col(col)
    reason = (F.when(v.isNull(), F.lit("no_vector"))
              .when(F.size(v) != dim, F.lit("wrong_dimension"))
              .when(_norm(v) == 0, F.lit("zero_vector")))
    return df.withColumn("reject_reason", reason)


def valid_vectors(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    return check_dimension(df, dim, col).where(F.col("reject_reason").isNull()).drop("reject_reason")


def bookkeeping(df: DataFrame, col: str = "embedding", text_col: str = "text_combined") -> DataFrame:
    """V6: embedding dimension and text length per row."""
    return df.withColumn("embedding_dimension", F.size(col).cast("int")) \
             .withColumn("text_length", F.length(text_col).cast("int"))


# --------------------------------------------------------------------------- embedding

def term_bucket(t: Column, dim: int) -> Column:
    """Hash bucket of a term: first 32 bits of its MD5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bucket_counts_to_unit(buckets: pd.Series, dims: pd.Series) -> pd.Series:
    # vectorised counts of a bounded number of terms at once (a batch may hold
    # millions), then l2 normalisation
    n = len(buckets)
    if n == 0:
        return pd.Series([], dtype=object)
    dim = int(dims.iloc[0])
    lens = np.fromiter((len(b) for b in buckets), dtype=np.int64, count=n)
    mat = np.zeros((n, dim), dtype=np.float64)
    cuts = np.flatnonzero(np.diff(np.cumsum(lens) // TERMS_AT_ONCE)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, n]):
        part = [b for b in buckets.iloc[lo:hi] if len(b)]
        if part:
            cells = np.repeat(np.arange(hi - lo) * dim, lens[lo:hi]) + np.concatenate(part)
            mat[lo:hi] = np.bincount(cells, minlength=(hi - lo) * dim).reshape(hi - lo, dim)
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    np.divide(mat, norms, out=mat, where=norms > 0)
    return pd.Series(list(mat))


def hashed_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Default lexical embedder: term counts hashed into ``dim`` buckets,
    unit length, in double precision. Deterministic and model-free; a stand-in for a neural model,
    which plugs in through ``embed(..., embedder=fn)``."""
    buckets = F.transform(tx.standard_terms(text), lambda t: term_bucket(t, dim).cast("int"))
    # marked so that a filter on the vector does not embed every row once more
    return _bucket_counts_to_unit.asNondeterministic()(buckets, F.lit(dim))


def embed(df: DataFrame, text_col: str = "text_combined", dim: int = DEFAULT_DIM,
          embedder: Callable[[list[str]], np.ndarray] | None = None,
          out_col: str = "embedding") -> DataFrame:
    """V1/V2: add a vector for every row with text; rows with blank text get
    no vector and a ``reject_reason``. ``embedder`` maps a list of texts to
    an (n, dim) array; it runs once per Arrow batch inside the tasks (load
    the model lazily inside it; it must be idempotent, tasks can be retried)."""
    blank = F.col(text_col).isNull() | (tx.strip_ws(F.col(text_col)) == "")
    if embedder is None:
        out = df.withColumn(out_col, F.when(~blank, hashed_embedding(F.col(text_col), dim)))
    else:
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def run(batches):
            for pdf in batches:
                texts = pdf[text_col].fillna("").astype(str)
                keep = texts.str.strip() != ""
                vecs = [None] * len(pdf)
                if keep.any():
                    arr = np.asarray(embedder(texts[keep].tolist()), dtype=np.float32)
                    for j, i in enumerate(np.flatnonzero(keep.values)):
                        vecs[i] = arr[j]
                pdf[out_col] = vecs
                yield pdf
        out = df.mapInPandas(run, schema)
    return out.withColumn("reject_reason", F.when(blank, F.lit("no_text")).when(
        F.col(out_col).isNull(), F.lit("embedding_failed")))


# --------------------------------------------------------------------------- exact k-NN

def _unit(mat: np.ndarray) -> np.ndarray:
    mat = mat.astype(np.float64, copy=False)
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, n, out=np.zeros_like(mat), where=n > 0)


PAIRS_PER_CHUNK = 1 << 20   # similarity entries held at once (4 MiB of floats)
BLOCK_WIDTH = 2048          # vectors scored before a query's k-th best is looked at again
TILE_QUERIES = 8192         # rows of a block, about, where there are more than that
TILE_VECTORS = 8192
LEAST_ROWS = 512            # fewer queries than that are not parted to keep all cores busy
MOST_FOUND = 1 << 15        # pairs that wait to be ranked
NO_PAIR = np.iinfo(np.int64).max


class _Best:
    """The k best vectors of each query of a block: rounded cosine desc, then id
    asc. Vectors come block by block. Pairs are scored in single precision and
    those that cannot pass the query's k-th best, with the most that this can be
    off, are passed over; the others are scored again in double precision. So the
    answer is that of scoring all pairs in double precision, and memory holds k
    pairs a query and a chunk of scores."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int, probed: np.ndarray | None = None):
        self.ids, self.mat, self.k, self.probed = ids, mat, k, probed
        self.half = mat.astype(np.float32)
        self.key = np.full((len(ids), k), NO_PAIR)
        self.id, self.sim = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k))
        self.floor = np.full(len(ids), -np.inf)  # what a score has to reach

    def meet(self, ids: np.ndarray, mat: np.ndarray, half: np.ndarray | None = None, cells: np.ndarray | None = None,
             q_rows: int | None = None, v_rows: int | None = None) -> None:
        """A block of vectors; with ``cells`` only queries that probe a vector's cell meet it."""
        half = mat.astype(np.float32) if half is None else half
        if self.probed is None:
            return self._meet(None, ids, mat, half, q_rows, v_rows)
        order = np.argsort(cells, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            rows = np.flatnonzero(self.probed[:, cells[part[0]]])
            if len(rows):
                self._meet(rows, ids[part], mat[part], half[part], q_rows, v_rows)

    def _meet(self, rows: np.ndarray | None, ids: np.ndarray, mat: np.ndarray, half: np.ndarray, q_rows: int | None,
              v_rows: int | None) -> None:
        # the most that a score in single precision is off (queries are of unit length)
        off = (mat.shape[1] + 8) * 2.0 ** -24 * max(1.0, np.sqrt((mat ** 2).sum(1).max(initial=0)))
        rows = np.arange(len(self.ids)) if rows is None else rows
        width = max(1, min(v_rows or BLOCK_WIDTH, BLOCK_WIDTH, len(ids)))
        step = max(1, min(q_rows or len(rows), PAIRS_PER_CHUNK // width))
        for lo in range(0, len(rows), step):
            mine = rows[lo:lo + step]
            block, row, col, sim, n = self.half[mine], [], [], [], 0
            for at in range(0, len(ids), width):
                s = block @ half[at:at + width].T
                if s.shape[1] >= self.k and (self.floor[mine] == -np.inf).any():  # k of these reach the k-th of them
                    kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                    self.floor[mine] = np.maximum(self.floor[mine], kth - off - 10.0 ** -COS_DECIMALS)
                need = (self.floor[mine] - off).astype(np.float32)
                found = np.flatnonzero(s >= need[:, None])
                if len(found):
                    r, c = np.divmod(found, s.shape[1])
                    row.append(mine[r])
                    col.append(c + at)
                    sim.append(self._exact(mine, mat[at:at + width], r, c))
                    n += len(r)
                if n > MOST_FOUND or n and at + width >= len(ids):
                    self._add(np.concatenate(row), ids[np.concatenate(col)], np.concatenate(sim))
                    row, col, sim, n = [], [], [], 0

    def _exact(self, mine: np.ndarray, mat: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The pairs (r, c) of a chunk in double precision."""
        if len(r) * 32 > len(mine) * len(mat):  # many, as with equal vectors
            return (self.mat[mine] @ mat.T)[r, c]
        return self.score(mine[r], mat, c)

    def score(self, rows: np.ndarray, mat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs of a query's row and a vector's in double precision."""
        parts = [np.einsum("ij,ij->i", self.mat[rows[lo:lo + MOST_FOUND]], mat[at[lo:lo + MOST_FOUND]])
                 for lo in range(0, len(rows), MOST_FOUND)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _add(self, row: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        scale = 10 ** COS_DECIMALS
        key = scale - np.rint(sim * scale).astype(np.int64)
        worst = self.key[row, -1]
        kept = (key < worst) | ((key == worst) & (ids < self.id[row, -1]))
        row, key, ids, sim = row[kept], key[kept], ids[kept], sim[kept]
        if not len(row):
            return
        touched, place = np.unique(row, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        key = np.concatenate([self.key[touched].ravel(), key])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        sim = np.concatenate([self.sim[touched].ravel(), sim])
        order = np.lexsort((ids, key, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(touched)))
        order = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.key[touched] = key[order].reshape(-1, self.k)
        self.id[touched], self.sim[touched] = ids[order].reshape(-1, self.k), sim[order].reshape(-1, self.k)
        worst = self.key[touched, -1]
        # a score that may still round to the k-th best
        self.floor[touched] = np.maximum(self.floor[touched], np.where(worst == NO_PAIR, -np.inf, (scale - worst - 0.5) / scale))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.key != NO_PAIR)
        return self.ids[row], self.id[row, col], self.sim[row, col]


def _topk_tile(qids: np.ndarray, qmat: np.ndarray, vids: np.ndarray, vmat: np.ndarray, k: int,
               q_block_rows: int, v_block_rows: int, probed: np.ndarray | None = None,
               cells: np.ndarray | None = None):
    """Top k of every query of one block among the vectors of one block."""
    best = _Best(qids, qmat, k, probed)
    best.meet(vids, vmat, None, cells, q_block_rows, v_block_rows)
    return best.pairs()


def _finish(pairs: DataFrame, k: int) -> DataFrame:
    pairs = pairs.withColumn("cosine", F.round("cosine", COS_DECIMALS))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("id"))
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("score", (F.lit(1.0) + F.col("cosine")) / 2)
            .select("query_id", "rank", "id", "cosine", "score"))


PAIR_SCHEMA = "query_id long, id long, cosine double"


def _blocks(queries: DataFrame, vectors: DataFrame, q_block_rows: int, v_block_rows: int) -> tuple[int, int]:
    """Blocks of each side. Fewer queries are parted to keep the cores busy."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq, nv = queries.count(), vectors.count()
    few = min(2 * cores, math.ceil(nq / max(q_block_rows, LEAST_ROWS)))
    return max(math.ceil(nq / max(q_block_rows, TILE_QUERIES)), few, 1), max(math.ceil(nv / max(v_block_rows, TILE_VECTORS)), 1)


def _tiles(queries: DataFrame, vectors: DataFrame, q_block_rows: int, v_block_rows: int,
           sizes: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks of about as many rows, each row once: a
    partition is a block."""
    nqb, nvb = sizes or _blocks(queries, vectors, q_block_rows, v_block_rows)
    return queries.repartition(nqb, "query_id"), vectors.repartition(nvb, "id")


def _met(queries: DataFrame, vectors: DataFrame, sizes: tuple[int, int], begin: Callable, ready: Callable) -> DataFrame:
    """PAIR_SCHEMA: blocks of queries go past the blocks of vectors."""
    return bk.met(queries, vectors, sizes, begin, ready, PAIR_SCHEMA, 2 * max(TILE_QUERIES, TILE_VECTORS))


def _unit_block(block: dict[str, np.ndarray]) -> tuple:
    unit = _unit(block["vec"])
    return block["id"], unit, unit.astype(np.float32), block.get("cell")


def _knn_blocked(queries: DataFrame, vectors: DataFrame, k: int, q_block_rows: int, v_block_rows: int,
                 ready: Callable = _unit_block) -> DataFrame:
    """Top-k by dot product, all against all, by blocks of bounded size.
    ``ready`` gives what queries meet of a block (ids, vectors, the same in
    single precision, cells)."""
    sizes = _blocks(queries, vectors, q_block_rows, v_block_rows)
    return _met(*_tiles(queries, vectors, q_block_rows, v_block_rows, sizes), sizes,
                lambda q: _Best(q["query_id"], _unit(q["vec"]), k), ready)


def _probed_blocks(queries: DataFrame, vectors: DataFrame, centres: np.ndarray, nprobe: int, q_block_rows: int,
                   v_block_rows: int, sizes: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, vec) with a bit per cell, set for their ``nprobe``
    nearest ones, and vectors (id, vec, cell) dealt into blocks, each row once.

    Neighbouring cells share a block of at most ``v_block_rows`` rows, a larger
    cell is cut into several."""
    spark = queries.sparkSession
    nqb, _ = sizes or _blocks(queries, vectors, q_block_rows, v_block_rows)
    held = {r["cell"]: r["n"] for r in vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, block, room = [], -1, 0  # (cell, first block, blocks); at most one row per centre
    for cell in sorted(held):
        n = held[cell]
        if n > room:
            block, room = block + 1, v_block_rows
        parts = math.ceil(n / v_block_rows)
        plan.append((cell, block, parts))
        block, room = (block, room - n) if parts == 1 else (block + parts - 1, 0)
    bc = spark.sparkContext.broadcast(_unit(centres))

    def probes(batches):
        for pdf in batches:
            if len(pdf):
                bits = np.zeros((len(pdf), len(bc.value)), dtype=bool)
                np.put_along_axis(bits, _nearest(pdf, bc.value, nprobe), True, axis=1)
                yield pdf.assign(probes=[row.tobytes() for row in np.packbits(bits, axis=1)])

    schema = T.StructType([*queries.select("query_id", "vec").schema.fields, T.StructField("probes", T.BinaryType())])
    places = F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int"))
    v = (vectors.join(places, "cell").withColumn("vb", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
         .repartition(max(1, block + 1), "vb").sortWithinPartitions("vb").select("id", "vec", "cell"))
    return queries.select("query_id", "vec").repartition(nqb, "query_id").mapInPandas(probes, schema), v


def _knn_probed(queries: DataFrame, vectors: DataFrame, centres: np.ndarray, nprobe: int, k: int, q_block_rows: int,
                v_block_rows: int, ready: Callable = _unit_block) -> DataFrame:
    """Top-k by dot product of each query among the vectors of its ``nprobe``
    nearest cells."""
    def begin(q: dict[str, np.ndarray]) -> _Best:
        return _Best(q["query_id"], _unit(q["vec"]), k, np.unpackbits(q["probes"], axis=1).astype(bool))
    sizes = _blocks(queries, vectors, q_block_rows, v_block_rows)
    return _met(*_probed_blocks(queries, vectors, centres, nprobe, q_block_rows, v_block_rows, sizes), sizes, begin, ready)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, query_id: str = "query_id",
        query_vec: str = "embedding", vec_id: str = "id", vec_col: str = "embedding",
        q_block_rows: int = 2048, v_block_rows: int = 16384) -> DataFrame:
    """V3: exact cosine top-k per query: query_id, rank, id, cosine, score.

    Queries and vectors meet in blocks of bounded size; each row is sent once, and
    only k rows per query leave a task. cosine is rounded to
    6 decimals before ranking; ties go to the lower id; score is
    (1 + cosine) / 2. Vectors are expected to be checked (V5)."""
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("vec"))
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return _finish(_knn_blocked(q, v, k, q_block_rows, v_block_rows), k)


# --------------------------------------------------------------------------- approximate k-NN

MAX_CELLS = 4096       # most centres of a cell index; they go to every task
PROBED = 0.7           # share of the cells a query is scored in, unless told


def sample_centres(vectors: DataFrame, n_cells: int | None = None, vec_id: str = "id",
                   vec_col: str = "embedding") -> DataFrame:
    """Centres for ``knn_ivf``: (cell, centre), the vectors whose ids have the
    smallest MD5, a sample that needs no training and is the same on every
    run. As many as the square root of the rows, at most MAX_CELLS, unless
    ``n_cells`` says so."""
    if n_cells is None:
        n_cells = math.ceil(math.sqrt(vectors.count()))
    n_cells = max(1, min(n_cells, MAX_CELLS))
    key = F.md5(F.col(vec_id).cast("string"))
    chosen = vectors.orderBy(key, vec_id).limit(n_cells)  # a bounded table, so one window over it is too
    place = Window.orderBy(F.md5(F.col(vec_id).cast("string")), vec_id)
    return chosen.select((F.row_number().over(place) - 1).alias("cell"), F.col(vec_col).alias("centre"))


def train_centres(vectors: DataFrame, n_cells: int, vec_col: str = "embedding", seed: int = 7,
                  max_iter: int = 20) -> DataFrame:
    """Centres by k-means over unit vectors (spherical, by normalising first)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.select(array_to_vector(F.transform(F.col(vec_col), lambda x: x.cast("double")
                                                       / _norm(F.col(vec_col)))).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    return vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")


def _nearest(pdf: pd.DataFrame, unit_centres: np.ndarray, nprobe: int) -> np.ndarray:
    """The ``nprobe`` nearest cells of each row, by rounded cosine, ties to the lower cell."""
    far = -np.rint(_unit(np.stack(pdf["vec"].to_numpy())) @ unit_centres.T * 10 ** COS_DECIMALS).astype(np.int64)
    return np.argsort(far, axis=1, kind="stable")[:, :nprobe]


def _in_cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each vector (id, vec) with the cell of its nearest centre."""
    bc = df.sparkSession.sparkContext.broadcast(_unit(centres))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_nearest(pdf, bc.value, 1)[:, 0].astype(np.int32))

    schema = T.StructType([*df.select("id", "vec").schema.fields, T.StructField("cell", T.IntegerType())])
    return df.select("id", "vec").mapInPandas(run, schema)


def knn_ivf(queries: DataFrame, vectors: DataFrame, k: int = 10, centres: DataFrame | None = None,
            nprobe: int | None = None, query_id: str = "query_id", query_vec: str = "embedding",
            vec_id: str = "id", vec_col: str = "embedding", q_block_rows: int = 4096,
            v_block_rows: int = 16384) -> DataFrame:
    """V4: approximate k-NN. Every vector lives in the cell of its nearest
    centre; a query is scored exactly against the vectors of its ``nprobe``
    nearest cells. ``centres`` (cell, centre; at most MAX_CELLS rows, checked)
    come from ``sample_centres`` or ``train_centres`` and are the only thing
    broadcast. Vectors travel with their cell, in blocks of whole cells; hot
    cells are split into several."""
    if centres is None:
        centres = sample_centres(vectors, vec_id=vec_id, vec_col=vec_col)
    rows = centres.orderBy("cell").limit(MAX_CELLS + 1).collect()
    if not rows:
        raise ValueError("no centres")
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} centres")
    matrix = np.array([r["centre"] for r in rows], dtype=np.float64)
    nprobe = nprobe or max(1, math.ceil(PROBED * len(rows)))
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("vec"))
    return _finish(_knn_probed(q, _in_cells(v, matrix), matrix, nprobe, k, q_block_rows, v_block_rows), k)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k found by the approximate search, per query and
    overall (one row per query plus the mean in every row)."""
    hit = exact.select("query_id", "id").join(approx.select("query_id", "id", F.lit(1).alias("h")),
                                              ["query_id", "id"], "left")
    per_q = hit.groupBy("query_id").agg((F.sum(F.coalesce("h", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    mean = per_q.agg(F.round(F.avg("recall"), 6).alias("mean_recall")).withColumn("_k", F.lit(1))
    return per_q.withColumn("_k", F.lit(1)).join(F.broadcast(mean), "_k").drop("_k")
