"""Near duplicates by an inverted join over MinHash coordinates.

Every text is a set of word shingles with a signature of ``COORDINATES``
minima. Texts with equal sets are one node from the start. A node is posted
under (coordinate, value) pairs; two nodes are candidates when they agree in
at least ``MATCHES`` coordinates, and a candidate is a link when the Jaccard
similarity of the full sets says so.

Prefix merging: nodes that agree in ``MATCHES`` of ``COORDINATES`` pairs share
one among the first ``COORDINATES - MATCHES + 1`` of each in any common order.
The order puts values that many texts have last, so long posting lists are
skipped in the merge and probed only when collisions are counted.

No list is expanded into all its pairs at once. First every node of a list is
tried against the list's smallest node, which is linear and links the bulk of
a large group; then only nodes of one list that are still in different
components, and whose set sizes allow a link, are tried with each other, and
in long lists only those whose rare shingles leave room for a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, components, mix64, written

SHINGLE = 5
COORDINATES = 64
MATCHES = 30  # a pair at 0.75 agrees in fewer with a chance of about 5e-7
PERCENT = 75
_HASHES = WordHashes()
_SALTS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word runs of the text in
    lower case (A-Z only); of fewer words, of the whole row; of none, empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    rolling = Rolling(_HASHES.of(words))
    return np.unique(rolling.windows(min(size, len(words))))


def signature(items: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(items), 1 << 13):
        keyed = (items[s:s + (1 << 13), None] ^ _SALTS[None, :]) * np.uint64(0xC4CEB9FE1A85EC53)
        keyed ^= keyed >> np.uint64(32)
        keyed *= np.uint64(0xFF51AFD7ED558CCD)
        out = np.minimum(out, (keyed.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return out


def _send(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()),
                   ("signature", pa.list_(pa.int32()))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            ids, texts = batch.columns
            for i in range(batch.num_rows):
                items = shingles(texts[i].as_py() or "")
                key = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), dtype=np.int64)
                yield (ids[i].as_py(), len(items), int(key[0]), int(key[1]), signature(items).view(np.int32))

    yield from _send(rows(), _SETS)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, coordinates) names of the (coordinate, value) pairs."""
    values = batch.column("signature").values.to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, COORDINATES)
    return mix64((values.astype(np.uint64) << np.uint64(8)) | np.arange(COORDINATES, dtype=np.uint64)[None, :]).view(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names that come up again inside a batch, with their counts there."""
    for batch in batches:
        if batch.num_rows:
            names, counts = np.unique(_keys(batch), return_counts=True)
            again = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(names[again]), pa.array(counts[again].astype(np.int64))], names=["name", "n"])


def _posts(common: np.ndarray, counts: np.ndarray, prefix: int):
    """Rows (name, node) of the first ``prefix`` pairs of each node: those not
    among the common names first, then the common ones from rare to frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = _keys(batch)
            weight = np.zeros(names.shape, dtype=np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, names), len(common) - 1)
                weight = np.where(common[at] == names, counts[at], 0)
            order = np.lexsort((names, weight), axis=1)[:, :prefix]
            nodes = np.repeat(batch.column("node").to_numpy(), prefix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.take_along_axis(names, order, axis=1).ravel()), pa.array(nodes)], names=["name", "node"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of the two texts of each row."""
    held: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        a, b, text_a, text_b = batch.columns
        keep = []
        for i in range(batch.num_rows):
            other = b[i].as_py()
            if held[0] != other:
                held = (other, shingles(text_b[i].as_py()))
            mine, theirs = shingles(text_a[i].as_py()), held[1]
            common = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * common >= PERCENT * (len(mine) + len(theirs) - common) and common:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])


def _agreeing(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``matches`` coordinates."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return (pairs.join(left, "a").join(right, "b").where(_sizes_allow(F.col("na"), F.col("nb")))
            .where(agree >= matches).select("a", "b"))


def _sizes_allow(na: Column, nb: Column) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has one
    text for each node that a pair may name."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a bigint, b bigint")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            items = shingles(batch.column("text")[i].as_py())
            n = len(items)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column("node")[i].as_py())), pa.array(np.full(n, batch.column("component")[i].as_py())),
                 pa.array(np.full(n, n)), pa.array(items.view(np.int64))], names=["node", "component", "n", "item"])


def _crowded(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components of ``crowd`` (node,
    component, n_shingles) that can be linked, by a prefix join over the full
    shingle sets.

    A link of sizes p <= q shares at least 3/7 (p + q) shingles, so at least
    6/7 p and 3/4 q: in any common order the first p - 6p/7 + 1 of the one and
    q - 3q/4 + 1 of the other meet, and from the places where they first meet
    on enough must be left. The order has rare shingles first: a copy whose
    own edits are more than a link allows posts nothing that others have.
    In a list the nodes outside its largest component are tried with all, so
    the members of one large group are not tried with each other.
    """
    held = crowd.join(texts, "node").select("node", "component", "text")
    items = written(held.mapInArrow(_items, "node bigint, component bigint, n bigint, item bigint"), "neardup-crowd")
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    ordered = (items.join(often, "item").groupBy("node", "component", "n")
               .agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("order")))
    least = F.ceil(F.col("n") * F.lit(PERCENT / 100.0))
    posted = ordered.select("node", "component", "n", F.posexplode(
        F.slice("order", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("at", "i"))
    posted = posted.where("i.df > 1").select("node", "component", "n", "at", F.col("i.item").alias("item"))
    posted = written(posted, "neardup-prefixes")
    sizes = posted.groupBy("item", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("item").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("groups"))
    few = posted.join(main.where("groups > 1"), "item").where("component <> main").drop("main", "groups")
    x, y = few.alias("x"), posted.alias("y")
    p, q = F.least(F.col("x.n"), F.col("y.n")), F.greatest(F.col("x.n"), F.col("y.n"))
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    smaller_at = F.when(F.col("x.n") <= F.col("y.n"), F.col("x.at")).otherwise(F.col("y.at"))
    return (x.join(y, F.col("x.item") == F.col("y.item"))
            .where((F.col("x.component") != F.col("y.component")) & _sizes_allow(p, q)
                   & (left * (100 + PERCENT) >= (p + q) * PERCENT)
                   & (smaller_at * (100 + PERCENT) <= p * (100 - PERCENT) + (100 + PERCENT)))
            .select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct())


def link(docs: DataFrame, matches: int = MATCHES, common_names: int = 100_000, short_list: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    component_id is the smallest doc_id that links lead to, itself included;
    kept tells the document that is its component's smallest. Null and empty
    texts have no shingles and link to nothing. Rows repeated with one doc_id
    are one document; rows of one doc_id with different texts share its node.
    A null doc_id keeps a null component and is kept, links to nothing. An
    empty table gives no rows; other columns are ignored. ``common_names``
    bounds the table of frequent values that goes to every task; it only
    orders the prefixes, so no bound changes the result. ``short_list`` tells
    which lists try their remaining pairs one by one (linear in the postings);
    longer ones go through a prefix join over full sets, which is exact too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(rows.mapInArrow(_sets, "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, signature array<int>"), "neardup-sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    nodes = written(full.groupBy("set1", "set2", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "neardup-nodes")
    # nodes whose id names several texts stand under one id; equal sets are linked by their smallest id
    spark = docs.sparkSession
    frequent = (nodes.select("signature").mapInArrow(_frequent, "name bigint, n bigint")
                .groupBy("name").agg(F.sum("n").alias("n")).where("n > 4")
                .orderBy(F.desc("n"), "name").limit(common_names).toPandas().sort_values("name"))
    common, counts = frequent["name"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)
    posts = nodes.select("node", "signature").mapInArrow(
        _posts(common, counts, COORDINATES - matches + 1), "name bigint, node bigint")
    lists = posts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1")
    merged = written(posts.join(lists, "name"), "neardup-lists")
    stars = merged.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    tried = written(_agreeing(stars, nodes, matches), "neardup-stars")
    involved = merged.select("node").distinct()
    texts = written(rows.join(involved, F.col("doc_id") == F.col("node")).groupBy("node").agg(
        F.first("text", ignorenulls=True).alias("text")), "neardup-texts")
    links = written(_confirmed(tried, texts), "neardup-links")
    groups = components(links)
    # what the stars left apart, list by list
    placed = merged.join(groups, "node", "left").select("name", "n", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("name").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("name")
    apart = written(placed.join(mixed, "name").join(nodes.select("node", "n_shingles"), "node"), "neardup-apart")
    short = apart.where(F.col("n") <= short_list)
    one, two = short.alias("x"), short.alias("y")
    more = (one.join(two, F.col("x.name") == F.col("y.name"))
            .where((F.col("x.component") > F.col("y.component")) & _sizes_allow(F.col("x.n_shingles"), F.col("y.n_shingles")))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    crowd = apart.where(F.col("n") > short_list).select("node", "component", "n_shingles").distinct()
    more = _agreeing(more, nodes, matches).union(_crowded(crowd, texts)).distinct()
    late = written(_confirmed(more, texts), "neardup-late")
    groups = components(links.union(late))
    by_set = nodes.select("set1", "set2", "n_shingles", "node").join(groups, "node", "left").select(
        "set1", "set2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return sets.drop("signature").join(by_set, ["set1", "set2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **knobs) -> DataFrame:
    """One row of each group of near duplicates, the one of smallest doc_id,
    with all its columns; of rows repeated with that id one stays."""
    kept = link(docs, **knobs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return rows.union(docs.where("doc_id is null"))
