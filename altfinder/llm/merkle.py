"""A Merkle tree over a table and every row's proof, by pointer jumping.

Rows of one language, in order of doc_id, are the leaves of a tree with runs
of ``FANOUT`` children; the roots of these trees are the leaves of one more
tree. Digests are lowercase hex SHA-256; a node is the digest of its children's
digests as text.

Each inner node starts with a pointer to its parent and one segment: the
siblings left and right of it. A round of pointer jumping joins the nodes with
themselves: a node takes its ancestor's pointer and appends its ancestor's
segments, so the distance doubles. After log2(height) rounds every node holds
its whole way to the root. A leaf needs one more step only, to its parent: the
eight leaves of a run share all segments but the first, so long proofs are
built for an eighth of the nodes and never stored per leaf.

A round joins at most 8^distance nodes with one ancestor. From distance 8 on
there are few ancestors left (one in 8^9 of the leaves); they are broadcast
while there are at most ``BROADCAST_NODES`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""           # name of the tree over the languages; those are "0" (null) or "1" + lang
TOP_LEVEL = 1000   # its levels are counted from here
BROADCAST_NODES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = ["tree", "level", "at"]


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row: each field as '-' if null, else its bytes, ':', value."""
    parts = []
    for c in FIELDS:
        value = F.col(c).cast("string") if c != "text" or text is None else text
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _levels(leaves: DataFrame, base: int, most: int, fanout: int) -> list[DataFrame]:
    """The inner nodes of the trees of ``leaves`` (tree, at, digest, n), one
    table a level: tree, level, at, digest, n (nodes of its tree on its level)
    and run, the children's digests in order as bytes."""
    out, below = [], leaves.select("tree", "at", "digest", "n")
    level = base
    while most > 1:
        level, most = level + 1, -(-most // fanout)
        children = F.array_sort(F.collect_list(F.struct("at", "digest")))
        text = F.array_join(F.transform(children, lambda c: c["digest"]), "")
        up = (below.where("n > 1").groupBy("tree", F.floor(F.col("at") / fanout).cast("long").alias("at"))
              .agg(text.alias("text"), F.ceil(F.first("n") / fanout).cast("long").alias("n")))
        below = written(up.select("tree", F.lit(level).alias("level"), "at", F.sha2("text", 256).alias("digest"), "n",
                                  F.unhex("text").alias("run")), "merkle-level")
        out.append(below)
    return out


def _segment(run: Column, place: Column) -> Column:
    """The siblings of the child at ``place`` of a run."""
    cut = (place * 32).cast("int")
    return F.struct(F.substring(run, F.lit(1), cut).alias("left"),
                    F.substring(run, cut + 33, F.octet_length(run)).alias("right"))


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the way up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_text(s["left"]), h, _text(s["right"])), 256))


def _jump(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` (node, up_tree, up_level, up_at, path), pointers doubled until
    every path reaches the root (a null pointer)."""
    distance = 1
    while distance < height:
        away = nodes.where("up_tree is not null")
        # an ancestor ``distance`` above an inner node
        over = nodes.where(F.col("level") > distance).select(
            *[F.col(c).alias(f"a_{c}") for c in NODE], F.col("up_tree").alias("b_tree"), F.col("up_level").alias("b_level"),
            F.col("up_at").alias("b_at"), F.col("path").alias("more"))
        few = distance >= 8 and over.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        met = away.join(F.broadcast(over) if few else over,
                        (F.col("up_tree") == F.col("a_tree")) & (F.col("up_level") == F.col("a_level"))
                        & (F.col("up_at") == F.col("a_at")))
        jumped = met.select(*NODE, F.col("b_tree").alias("up_tree"), F.col("b_level").alias("up_level"),
                            F.col("b_at").alias("up_at"), F.concat("path", "more").alias("path"))
        nodes = written(nodes.where("up_tree is null").unionByName(jumped), "merkle-paths")
        distance *= 2
    return nodes


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, tampered) per row of ``docs``.

    ``path`` is the row's proof: for each step up to the root the digests left
    and right of it, as bytes (empty if it has no siblings there). ``tampered``
    is the digest of the row after the fixed tampering: text's A-Z lower-cased
    where 3 divides the CRC-32 of the decimal doc_id, else the row's own.

    Leaves of a language stand by doc_id (null first), ties by digest; equal
    rows are leaves of their own with the same digest. A null language is a
    language, before all others. Nulls are told from empty values. A table of
    one row has a leaf as its root and no siblings; an empty table gives no
    rows. Columns other than the five hashed ones are ignored.
    """
    tamper = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"), leaf_digest().alias("leaf"),
                       F.when(tamper, leaf_digest(F.translate("text", UPPER, LOWER))).alias("changed"))
    rows = written(rows, "merkle-rows")  # hashed once; the numbering reads them twice
    leaves = written(numbered(rows, ["tree"], [F.col("doc_id"), F.col("leaf")], "at"), "merkle-leaves")
    counts = written(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    most, trees = counts.agg(F.max("n"), F.count(F.lit(1))).first()
    if not trees:
        return leaves.select("doc_id", "leaf", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root")],
                             F.array().cast("array<struct<left:binary,right:binary>>").alias("path"),
                             F.lit(None).cast("string").alias("tampered"))
    base = leaves.join(counts, "tree").withColumnRenamed("leaf", "digest")
    lower = _levels(base, 0, most, fanout)

    # the tree over the languages
    subroots = base.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")
    for t in lower:
        subroots = subroots.unionByName(t.where("n = 1").select("tree", "level", "digest"))
    subroots = written(numbered(subroots.withColumn("_all", F.lit(0)), ["_all"], [F.col("tree")], "place").drop("_all"), "merkle-subroots")
    tops = _levels(subroots.select(F.lit(TOP).alias("tree"), F.col("place").alias("at"), "digest", F.lit(trees).cast("long").alias("n")),
                   TOP_LEVEL, trees, fanout)
    root_level = TOP_LEVEL + len(tops) if tops else len(lower)
    root = (tops[-1] if tops else subroots).first()["digest"]

    # each node's parent
    per_tree = subroots.select("tree", F.col("level").alias("sub_level"), F.col("digest").alias("subroot"), "place")
    in_tree, topped = F.col("level") < F.coalesce(F.col("sub_level"), F.lit(TOP_LEVEL * 2)), F.lit(bool(tops))
    step = F.when(in_tree, F.col("at")).otherwise(F.col("place"))
    linked = F.when(in_tree, F.col("level") < root_level).otherwise(topped)  # the root has no parent

    def with_parent(nodes: DataFrame) -> DataFrame:
        return (nodes.join(per_tree, "tree", "left")
                .withColumn("up_tree", F.when(linked, F.when(in_tree, F.col("tree")).otherwise(F.lit(TOP))))
                .withColumn("up_level", F.when(linked, F.when(in_tree, F.col("level")).otherwise(F.lit(TOP_LEVEL)) + 1))
                .withColumn("up_at", F.when(linked, F.floor(step / fanout).cast("long")))
                .withColumn("child", F.when(linked, step % fanout)))

    up = [f"up_{c}" for c in NODE]
    inner = None
    for t in [*lower, *tops]:
        inner = t.select(*NODE, "run") if inner is None else inner.unionByName(t.select(*NODE, "run"))
    leaves = with_parent(leaves.withColumn("level", F.lit(0)))
    if inner is None:  # one row
        paths = leaves.withColumn("path", F.array().cast("array<struct<left:binary,right:binary>>"))
    else:
        runs = inner.select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("run").alias("up_run"))
        own = with_parent(inner.drop("run")).join(runs, up, "left")
        is_root = (F.col("up_level") == root_level) & (F.col("up_tree") == (TOP if tops else F.col("tree")))
        none = F.array().cast("array<struct<left:binary,right:binary>>")
        first = own.select(*NODE, *[F.when(~is_root, F.col(c)).alias(c) for c in up],
                           F.when(F.col("up_run").isNull(), none).otherwise(
                               F.array(_segment(F.col("up_run"), F.col("child")))).alias("path"))
        height = len(lower) + len(tops)
        nodes = _jump(written(first, "merkle-paths"), height)
        above = nodes.join(inner, NODE).select(*[F.col(c).alias(f"up_{c}") for c in NODE], "run", F.col("path").alias("rest"))
        paths = leaves.join(above, up, "left").withColumn("path", F.when(F.col("run").isNull(), none).otherwise(
            F.concat(F.array(_segment(F.col("run"), F.col("child"))), F.col("rest"))))
    return paths.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "path",
                        F.coalesce("changed", "leaf").alias("tampered"))
