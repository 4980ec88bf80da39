"""Keyword search: term statistics, BM25 over one or many fields, fuzzy and
prefix matching, top-k per query.

Set-at-a-time: a DataFrame of queries is answered by one plan. The postings
table is the inverted index: one row per (field, id, term) with the term
count and the field length of the document. Queries are analysed the same
way and joined to postings on (field, term).

Two ways to the same hits. With total hit counts every matching pair is
scored (``top_k_with_totals``, in tiles; over a single field ``score_pairs``).
Without them ``pruned_top_k`` scores each distinct
field value once per distinct field query, and only those that can still
reach the top k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altfinder.functions import text as tx
from altfinder.operators import blocks as bk
from altfinder.operators.blocks import NO_ID
from altfinder.session import materialize

K1 = 1.2
B = 0.75
EDGE_SUFFIX = ".edge"
DOCS_PER_TASK = 4096
PAIRS_PER_TASK = 1 << 20
MAX_TOP_K = 100  # fixed value: the most hits a query may ask for


# --------------------------------------------------------------------------- index

def _analysed(docs: DataFrame, id_col: str, fields: list[str], edge: bool) -> DataFrame:
    """(field, id, terms) for every non-null field; one scan, one explode of a
    fixed-size array of per-field structs (no union, no second scan)."""
    items = []
    for f in fields:
        items.append(F.struct(F.lit(f).alias("field"), tx.standard_terms(F.col(f)).alias("terms")))
        if edge:
            items.append(F.struct(F.lit(f + EDGE_SUFFIX).alias("field"), tx.edge_grams(F.col(f)).alias("terms")))
    return (
        docs.select(F.col(id_col).alias("id"), F.explode(F.array(*items)).alias("x"))
        .select("x.field", "id", "x.terms")
        .withColumn("dl", F.size("terms"))
        .where(F.col("dl") > 0)
    )


def _tasks_for(spark: SparkSession, n: int, each: int) -> int:
    """Tasks for ``n`` rows, about ``each`` to a task and one to a core at least."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n / each))


def _term_counts(docs: DataFrame, fields: list[str], id_col: str, edge: bool) -> DataFrame:
    # the counts of a task's documents are held while they are summed, so the
    # number of tasks follows the number of documents
    tasks = _tasks_for(docs.sparkSession, docs.count(), DOCS_PER_TASK)
    analysed = _analysed(docs.repartition(tasks, F.col(id_col)), id_col, fields, edge)
    return (analysed.select("field", "id", "dl", F.explode("terms").alias("term"))
            .groupBy("field", "term", "id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf")))


def _weighed(counts: DataFrame, terms: DataFrame, field_stats: DataFrame, k1: float, b: float) -> DataFrame:
    return (counts.join(terms, ["field", "term"]).join(F.broadcast(field_stats), "field")
            .select("field", "term", "id", "tf", "dl",
                    bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("df"),
                                F.col("n_docs"), k1, b).alias("w")))


@dataclass
class KeywordIndex:
    """An impact index (K1): every posting carries its BM25 weight.

    ``postings``: field, term, id, tf, dl, w  -- w = idf x tf part, so a
    query only multiplies by its term weights and sums
    ``terms``: field, term, df               -- the vocabulary (fuzzy expansion)
    ``field_stats``: field, n_docs, avgdl    -- one row per field; bounded by
    the number of fields, so it is always safe to broadcast
    ``counts``: field, term, id, dl, tf      -- what the others derive from

    A term found in a third of all documents is a skewed key of the df join
    at build time, which AQE splits.
    """

    postings: DataFrame
    terms: DataFrame
    field_stats: DataFrame
    counts: DataFrame
    k1: float = K1
    b: float = B

    @staticmethod
    def build(docs: DataFrame, fields: list[str], id_col: str = "id", edge: bool = False,
              k1: float = K1, b: float = B) -> "KeywordIndex":
        """Term counts per document aggregate where the documents are
        partitioned by id (no shuffle of postings). They are written once to
        the shared checkpoint folder, because the vocabulary, the field
        statistics and the postings all read them. The vocabulary (df per
        term) is a partial aggregation; its join back is left to the planner,
        which broadcasts it by its measured size or splits frequent terms."""
        return KeywordIndex.of_counts(materialize(_term_counts(docs, fields, id_col, edge)), k1, b)

    def refresh(self, docs: DataFrame, changed: DataFrame, fields: list[str], id_col: str = "id",
                edge: bool = False) -> "KeywordIndex":
        """B2: the index after a change. The counts of the documents named by
        ``changed`` (column id) are replaced by those of ``docs``, the changed
        documents that are still there; only these are analysed."""
        kept = self.counts.join(changed.select("id").distinct(), "id", "left_anti")
        counts = kept.unionByName(_term_counts(docs, fields, id_col, edge))
        return KeywordIndex.of_counts(materialize(counts), self.k1, self.b)

    @staticmethod
    def of_counts(raw: DataFrame, k1: float = K1, b: float = B) -> "KeywordIndex":
        """Vocabulary, statistics and weighted postings of term counts."""
        # per-document rows are local to a shard (no shuffle), then a tiny
        # per-field aggregation
        field_stats = (raw.groupBy("field", "id").agg(F.first("dl").alias("dl"))
                       .groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))
        terms = raw.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        return KeywordIndex(_weighed(raw, terms, field_stats, k1, b), terms, field_stats, raw, k1, b)

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms (field, term, df) alone: a join of all
        counts with few terms needs no sort of the counts."""
        return _weighed(self.counts, terms, self.field_stats, self.k1, self.b)

    def vocabulary(self) -> DataFrame:
        return self.terms.select("field", "term")


# --------------------------------------------------------------------------- query side

def validate_queries(queries: DataFrame, text_col: str = "text", top_k_col: str | None = None) -> DataFrame:
    """Blank query text and a top k outside 1..100 get an error; such
    queries are kept out of scoring."""
    blank = F.col(text_col).isNull() | (tx.strip_ws(F.col(text_col)) == "")
    error = F.when(blank, F.lit("Empty query string"))
    if top_k_col:
        asked = F.coalesce(F.col(top_k_col), F.lit(0))
        error = error.when(~asked.between(1, MAX_TOP_K), F.lit(f"top k must be 1 to {MAX_TOP_K}"))
    return queries.withColumn("error", error)


def query_terms(queries: DataFrame, fields: list[str], edge: bool = False,
                qid: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, field, term, qtf): the query analysed once per searched
    field -- standard analysis for plain fields, words + folding (no stop
    words, no n-grams) for prefix fields. A repeated query word counts twice."""
    items = []
    for f in fields:
        items.append(F.struct(F.lit(f).alias("field"), tx.standard_terms(F.col(text_col)).alias("terms")))
        if edge:
            items.append(F.struct(F.lit(f + EDGE_SUFFIX).alias("field"),
                                  tx.folded_terms(F.col(text_col)).alias("terms")))
    valid = validate_queries(queries, text_col).where(F.col("error").isNull())
    return (
        valid.select(F.col(qid).alias("query_id"), F.explode(F.array(*items)).alias("x"))
        .select("query_id", F.col("x.field").alias("field"), F.explode("x.terms").alias("term"))
        .groupBy("query_id", "field", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def auto_edits(length: Column) -> Column:
    """Fuzziness AUTO: 0 edits up to 2 characters, 1 up to 5, else 2."""
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


# Longer terms (after the prefix) are cut into parts; shorter ones get deletion keys,
# of which a term of n characters has about n * n / 2.
LONG_TERM = 20


PARTS = 5  # two edits touch at most four parts: a swap may lie across two


def _part(n: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of part ``i`` of a term of ``n`` characters."""
    start = F.floor(n * i / PARTS)
    return start, F.floor(n * (i + 1) / PARTS) - start


def _part_keys(s: Column) -> Column:
    """The parts of a long term, with its length and their number."""
    n = F.length(s)

    def key(i: Column) -> Column:
        start, length = _part(n, i)
        return F.concat_ws("|", n, i, s.substr((start + 1).cast("int"), length.cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), key)


def _part_probes(s: Column) -> Column:
    """Keys that meet those of every long term within 2 edits: two edits leave
    one of its parts as it is and move it by at most 2."""
    n = F.length(s)

    def probes(m: Column, i: Column) -> Column:
        start, length = _part(m, i)
        at = F.filter(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda move: start + move),
                      lambda a: (a >= 0) & (a + length <= n))
        return F.transform(at, lambda a: F.concat_ws("|", m, i, s.substr((a + 1).cast("int"), length.cast("int"))))
    lengths = F.filter(F.sequence(n - 2, n + 2), lambda m: m > LONG_TERM)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda m: F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: probes(m, i))))))


def _deletions(s: Column, max_d: int) -> Column:
    """All strings reachable from s by deleting up to max_d characters."""
    def one(x: Column) -> Column:
        return F.when(
            F.length(x) >= 1,
            F.transform(F.sequence(F.lit(1), F.length(x)),
                        lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x)))),
        ).otherwise(F.array().cast("array<string>"))
    out = F.array(s)
    d1 = one(s)
    if max_d >= 1:
        out = F.concat(out, d1)
    if max_d >= 2:
        out = F.concat(out, F.flatten(F.transform(d1, one)))
    return F.array_distinct(out)


def fuzzy_expand(terms: DataFrame, vocabulary: DataFrame, prefix_length: int = 2,
                 max_expansions: int = 50) -> DataFrame:
    """Expand (field, term) to vocabulary terms within AUTO edits.

    Exact at any scale: candidates are found by an equi-join on symmetric
    deletion keys (two strings within k edits, adjacent swaps among them, share
    a string reachable by at most k deletions from each), behind a fixed prefix
    when ``prefix_length`` is set, then checked with the edit distance that
    counts a swap once (optimal string alignment). Long vocabulary
    terms are found by their parts instead, so the keys of a term stay linear
    in its length. No band join, no pairs beyond real neighbours. Returns field, term, match_term, edits,
    boost = 1 - edits / min(len); at most ``max_expansions`` per term, best
    boost first, then by term.
    """
    def keyed(df: DataFrame, term_col: str, max_d: Column | int, vocab_side: bool) -> DataFrame:
        t = F.col(term_col)
        pre = t.substr(F.lit(1), F.lit(prefix_length)) if prefix_length else F.lit("")
        suf = t.substr(F.lit(prefix_length + 1), F.length(t)) if prefix_length else t
        if vocab_side:
            variants = F.when(F.length(suf) > LONG_TERM, _part_keys(suf)).otherwise(_deletions(suf, 2))
            # a variant of d deletions only pairs with query terms allowing >= d
            return df.select("field", term_col, pre.alias("pre"), F.explode(variants).alias("key"))
        none = F.array().cast("array<string>")
        near = F.when(F.length(suf) <= LONG_TERM + 2, F.when(max_d == 0, F.array(suf)).when(
            max_d == 1, _deletions(suf, 1)).otherwise(_deletions(suf, 2))).otherwise(none)
        var = F.concat(near, F.when(F.length(suf) > LONG_TERM - 2, _part_probes(suf)).otherwise(none))
        return df.select("field", term_col, "max_d", pre.alias("pre"), F.explode(var).alias("key"))

    q = terms.select("field", "term").distinct().withColumn("max_d", auto_edits(F.length("term")))
    v = vocabulary.select("field", F.col("term").alias("match_term"))
    # Only vocabulary terms that can be within 2 edits of some query term of
    # the same field (same fixed prefix, length within the query lengths +-2)
    # get deletion keys: the vocabulary side grows with the corpus, the query
    # side does not.
    pre_q = (F.col("term").substr(F.lit(1), F.lit(prefix_length)) if prefix_length else F.lit(""))
    pre_v = (F.col("match_term").substr(F.lit(1), F.lit(prefix_length)) if prefix_length else F.lit(""))
    reach = q.groupBy("field", pre_q.alias("_pre")).agg(F.min(F.length("term")).alias("_lo"),
                                                          F.max(F.length("term")).alias("_hi"))
    v = (v.withColumn("_pre", pre_v).join(reach, ["field", "_pre"])
         .where((F.length("match_term") >= F.col("_lo") - 2) & (F.length("match_term") <= F.col("_hi") + 2))
         .select("field", "match_term"))
    qk = keyed(q, "term", F.col("max_d"), vocab_side=False)
    vk = keyed(v, "match_term", 2, vocab_side=True)
    cand = qk.join(vk, ["field", "pre", "key"]).select("field", "term", "max_d", "match_term").distinct()
    scored = (
        cand.withColumn("edits", tx.edits_with_swaps(F.col("term"), F.col("match_term")))
        .where((F.col("edits") >= 0) & (F.col("edits") <= F.col("max_d")))
        .withColumn("boost", F.lit(1.0) - F.col("edits")
                    / F.least(F.length("term"), F.length("match_term")).cast("double"))
    )
    w = Window.partitionBy("field", "term").orderBy(F.desc("boost"), F.asc("match_term"))
    return (scored.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= max_expansions)
            .select("field", "term", "match_term", "edits", "boost"))


def exact_expand(terms: DataFrame) -> DataFrame:
    return (terms.select("field", "term").distinct()
            .select("field", "term", F.col("term").alias("match_term"),
                    F.lit(0).alias("edits"), F.lit(1.0).alias("boost")))


# --------------------------------------------------------------------------- scoring

def bm25_weight(tf: Column, dl: Column, avgdl: Column, df: Column, n: Column,
                k1: float = K1, b: float = B) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    tfw = tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))
    return idf * tfw


def weighted_terms(index: KeywordIndex, qterms: DataFrame, fuzzy: bool = True, prefix_length: int = 2,
                   max_expansions: int = 50) -> DataFrame:
    """(query_id, field, term, qw): vocabulary terms of each query with their
    weight (count in the query x fuzzy boost)."""
    expansions = (fuzzy_expand(qterms, index.vocabulary(), prefix_length, max_expansions)
                  if fuzzy else exact_expand(qterms))
    return (qterms.join(expansions, ["field", "term"])
            .groupBy("query_id", "field", "match_term")
            .agg(F.sum(F.col("qtf") * F.col("boost")).alias("qw"))
            .withColumnRenamed("match_term", "term"))


def score_pairs(index: KeywordIndex, weighted: DataFrame, fields: list[str]) -> DataFrame:
    """Per (query_id, id) with a common term: best-field BM25 score and the
    field that gave it.

    Scores inside a field sum over query terms (operator OR); across fields
    the best field wins (best_fields, no tie breaker)."""
    # dealt out by pair before they are summed: a task that holds a frequent
    # term meets most pairs once, and its partial sums would only fill memory.
    # Many pairs are dealt by number, as the planner would merge them into a task
    # for each core, whose sums grow with the documents
    weighted = materialize(weighted)
    asked = weighted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"))
    found = materialize(index.counts.select("field", "term").join(asked, ["field", "term"])
                        .groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.first("n").alias("n")))
    n = found.agg(F.sum(F.col("df") * F.col("n"))).first()[0] or 0
    spark = index.counts.sparkSession
    tasks = _tasks_for(spark, n, PAIRS_PER_TASK)
    by = (tasks, "query_id", "id") if tasks > spark.sparkContext.defaultParallelism else ("query_id", "id")
    contrib = (index.postings_of(found.drop("n")).join(weighted, ["field", "term"])
               .select("query_id", "id", "field", (F.col("qw") * F.col("w")).alias("w")).repartition(*by))
    if len(fields) == 1:
        agg = contrib.groupBy("query_id", "id").agg(F.sum("w").alias("score"))
        return agg.select("query_id", "id", "score", F.lit(fields[0]).alias("best_field"))
    # One aggregation per (query, id): a conditional sum per field, then the
    # best one -- a single shuffle instead of one per grouping level.
    sums = [F.sum(F.when(F.col("field") == f, F.col("w"))).alias(f"s{i}") for i, f in enumerate(fields)]
    agg = contrib.groupBy("query_id", "id").agg(*sums)
    # compared at 9 decimals so float summation order cannot pick the field
    per_field = F.array(*[F.struct(F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 9).alias("score"),
                                   F.lit(f).alias("field")) for i, f in enumerate(fields)])
    best = F.array_max(per_field)
    return agg.select("query_id", "id", best["score"].alias("score"), best["field"].alias("best_field"))


def top_k(pairs: DataFrame, k: int, part: str = "query_id", score: str = "score",
          tie: str = "id", rank_col: str = "rank") -> DataFrame:
    """K5: rank within each group by score desc then id; keep k. Kept as
    row_number() <= k so Spark inserts a partial top-k before the shuffle."""
    w = Window.partitionBy(part).orderBy(F.desc(score), F.asc(tie))
    return pairs.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def _groups(rows: DataFrame, member: str, group: str, weight: str) -> DataFrame:
    """(field, member, group): members of a field with the same terms and
    weights form one group, named by its smallest member. Grouped by a
    SHA-256 of the sorted list, so a value that a third of all rows share
    moves as partial minima."""
    listed = rows.groupBy("field", member).agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("term", weight)))), 256).alias("_sig"))
    first = listed.groupBy("field", "_sig").agg(F.min(member).alias(group))
    return listed.join(first, ["field", "_sig"]).select("field", member, group)


def _best_values(scored: DataFrame, k: int, score: str) -> DataFrame:
    """Per (sq, field) the values that can hold one of its k best documents:
    among the k best values (ties by smallest id), those with fewer than k
    documents above them. ``score`` is a whole number."""
    by = Window.partitionBy("sq", "field")
    first = scored.withColumn("_rn", F.row_number().over(by.orderBy(F.desc(score), F.asc("vid")))).where(F.col("_rn") <= k)
    above = F.sum("n").over(by.orderBy(-F.col(score)).rangeBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_above", F.coalesce(above, F.lit(0))).where(F.col("_above") < k).drop("_rn", "_above")


# Most field queries, field values and rows of either that meet in one tile (on
# average: they are dealt by hash).
TILE_QUERIES, TILE_VALUES, TILE_ROWS = 512, 4096, 200_000


def _grouped(members: np.ndarray, terms: np.ndarray, weight: np.ndarray, n_terms: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members and weights ordered by term, and where each term begins; rows
    that repeat a member and term are added up."""
    order = np.lexsort((members, terms))
    order = order[np.searchsorted(terms[order], 0):]  # terms under 0 are unknown
    members, terms, weight = members[order], terms[order], weight[order]
    first = np.flatnonzero(np.r_[True, (members[1:] != members[:-1]) | (terms[1:] != terms[:-1])][:len(order)])
    weight = np.add.reduceat(weight, first) if len(first) else weight
    return members[first], weight, np.searchsorted(terms[first], np.arange(n_terms + 1))


DENSE = 64     # a term that more than one in so many pairs share is multiplied densely,
TERMS = 256    # so many at once


def _added(scores: np.ndarray, rows: np.ndarray, qw: np.ndarray, q_at: np.ndarray, cols: np.ndarray, w: np.ndarray,
           v_at: np.ndarray, hit: np.ndarray) -> None:
    """Adds the products of the terms that both sides have, and marks the pairs
    in ``hit``. A weight can be negative: documents that repeat an id count
    once, their terms as often as they come."""
    shared = np.diff(q_at) * np.diff(v_at)
    dense = np.flatnonzero(shared > scores.size // DENSE)
    positive = (qw > 0).all() and (w > 0).all()
    for lo in range(0, len(dense), TERMS):
        part = dense[lo:lo + TERMS]
        q, v = np.zeros((scores.shape[0], len(part))), np.zeros((scores.shape[1], len(part)))
        has_q, has_v = np.zeros(q.shape, np.float32), np.zeros(v.shape, np.float32)
        for i, t in enumerate(part):
            a, b = slice(q_at[t], q_at[t + 1]), slice(v_at[t], v_at[t + 1])
            q[rows[a], i], v[cols[b], i] = qw[a], w[b]
            has_q[rows[a], i], has_v[cols[b], i] = 1, 1
        here = q @ v.T
        scores += here
        hit |= here > 0 if positive else has_q @ has_v.T > 0
    for t in np.flatnonzero((shared > 0) & (shared <= scores.size // DENSE)):
        a, b = slice(q_at[t], q_at[t + 1]), slice(v_at[t], v_at[t + 1])
        pairs = np.ix_(rows[a], cols[b])
        scores[pairs] += np.outer(qw[a], w[b])
        hit[pairs] = True


def _kth(scores: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per row the score of its k-th best document, -inf if there are fewer;
    ``n``: documents of each column. Pairs that are no hits have -inf."""
    most = min(k, scores.shape[1])  # the k best documents are of the k best columns
    best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    held = np.take_along_axis(scores, best, axis=1)
    order = np.argsort(-held, axis=1, kind="stable")
    held, best = np.take_along_axis(held, order, axis=1), np.take_along_axis(best, order, axis=1)
    enough = np.cumsum(np.where(held > -np.inf, n[best], 0), axis=1) >= k
    return np.where(enough.any(axis=1), held[np.arange(len(held)), enough.argmax(axis=1)], -np.inf)


def _tile(k: int, scale: float, margin: float, columns: list[str]):
    """Of a block of field queries and a block of field values: the pairs that
    can still be among a query's k best documents of the block."""
    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame(columns=columns)
        sq, queries = pd.factorize(q["sq"])
        vid, values = pd.factorize(v["vid"])
        v_term, terms = pd.factorize(v["term"])
        rows, qw, q_at = _grouped(sq, pd.Index(terms).get_indexer(q["term"]), q["qw"].to_numpy(np.float64), len(terms))
        cols, w, v_at = _grouped(vid, v_term, v["w"].to_numpy(np.float64), len(terms))
        scores = np.zeros((len(queries), len(values)))
        hit = np.zeros(scores.shape, bool)
        _added(scores, rows, qw, q_at, cols, w, v_at, hit)
        scores[~hit] = -np.inf
        n, left = np.zeros(len(values), np.int64), np.zeros(len(queries))
        n[vid], left[sq] = v["n"], q["left"]
        kth = _kth(scores, n, k)
        kept = hit & (scores + left[:, None] + margin >= (np.floor(kth * scale) / scale)[:, None])
        r, c = np.nonzero(kept)
        return pd.DataFrame({"field": q["field"].iloc[0], "sq": queries[r], "vid": values[c], "part": scores[r, c], "n": n[c]},
                            columns=columns)

    return run


def _partial_scores(postings: DataFrame, marked: DataFrame, left: DataFrame, k: int, scale: float, margin: float) -> DataFrame:
    """(field, sq, vid, part, n): sums over the needed terms, of the pairs that
    can still be hits. Blocks of field queries meet blocks of field values in
    tiles, which sum and rank their pairs where they arise: what is sent are
    rows of terms, and what is written are pairs near a tile's k best. The
    driver holds the numbers of blocks, a row per field."""
    spark = postings.sparkSession
    needed = marked.where("needed").join(left, ["field", "sq"], "left").select(
        "field", "sq", "term", "qw", F.coalesce("left", F.lit(0.0)).alias("left"))
    values = postings.join(needed.select("field", "term").distinct(), ["field", "term"], "left_semi")

    def blocks(rows: DataFrame, member: str, most: int, name: str) -> DataFrame:
        return rows.groupBy("field").agg(F.greatest(F.ceil(F.approx_count_distinct(member) / most),
                                                    F.ceil(F.count(F.lit(1)) / TILE_ROWS)).cast("int").alias(name))
    sizes = blocks(needed, "sq", TILE_QUERIES, "qs").join(blocks(values, "vid", TILE_VALUES, "vs"), "field").collect()
    grid = F.broadcast(spark.createDataFrame([tuple(r) for r in sizes], "field string, qs int, vs int"))
    tasks = max(1, min(2 * sum(r.qs * r.vs for r in sizes), 16 * spark.sparkContext.defaultParallelism))

    def dealt(rows: DataFrame, member: str, own: str, of: str, other: str, others: str) -> DataFrame:
        return (rows.join(grid, "field").withColumn(own, F.pmod(F.xxhash64(member), F.col(of)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("qs", "vs")
                .repartition(tasks, "field", "qb", "vb"))
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("sq", needed.schema["sq"].dataType),
                           T.StructField("vid", values.schema["vid"].dataType), T.StructField("part", T.DoubleType()),
                           T.StructField("n", T.LongType())])
    return (dealt(needed, "sq", "qb", "qs", "vb", "vs").groupBy("field", "qb", "vb")
            .cogroup(dealt(values, "vid", "vb", "vs", "qb", "qs").groupBy("field", "qb", "vb"))
            .applyInPandas(_tile(k, scale, margin, schema.names), schema))


def pruned_candidates(index: KeywordIndex, weighted: DataFrame, k: int, decimals: int = 4
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, queries, values): partial scores of the (field query,
    field value) pairs that share a term which the top k cannot do without.

    Documents with the same terms in a field are one value there, queries with
    the same weighted terms in a field one field query (``sq``); a pair is
    scored once for all of them. Of a field query's terms, in order of the
    most they can add, the first ones whose sum stays below the k-th best
    score are left out: documents with these alone cannot be hits. The k-th
    best score is at least the k-th largest weight of any one of its terms.
    """
    margin = 2 * 10.0 ** -decimals  # two scores this far apart never round to one
    values = materialize(_groups(index.postings, "id", "vid", "tf"))
    sized = values.groupBy("field", "vid").agg(F.count(F.lit(1)).alias("n"))
    postings = materialize(index.postings.withColumnRenamed("id", "vid").join(sized, ["field", "vid"])
                           .select("field", "term", "vid", "n", "w"))
    weighted = materialize(weighted)
    queries = materialize(_groups(weighted, "query_id", "sq", "qw"))
    reps = queries.where(F.col("query_id") == F.col("sq")).select("field", "query_id")
    terms = weighted.join(reps, ["field", "query_id"]).withColumnRenamed("query_id", "sq")

    # most and k-th largest weight of each term, over documents
    of_term = Window.partitionBy("field", "term")
    top = (postings.withColumn("_rn", F.row_number().over(of_term.orderBy(F.desc("w"), F.asc("vid"))))
           .where(F.col("_rn") <= k)
           .withColumn("_upto", F.sum("n").over(of_term.orderBy("_rn"))))
    bounds = top.groupBy("field", "term").agg(
        F.max("w").alias("most"), F.max(F.when(F.col("_upto") >= k, F.col("w"))).alias("kth"))
    bounded = terms.join(bounds, ["field", "term"]).withColumn("add", F.col("qw") * F.col("most"))
    of_query = Window.partitionBy("field", "sq")
    sums = F.sum("add").over(of_query.orderBy("add", "term").rowsBetween(Window.unboundedPreceding, 0))
    least = F.coalesce(F.max(F.col("qw") * F.col("kth")).over(of_query), F.lit(0.0))
    marked = materialize(bounded.withColumn("needed", sums + margin >= least)
                         .select("field", "sq", "term", "qw", "add", "needed"))
    rest = marked.where(~F.col("needed"))
    left = rest.groupBy("field", "sq").agg(F.sum("add").alias("left"))
    scale = 10.0 ** decimals
    partial = materialize(_partial_scores(postings, marked, left, k, scale, margin))

    # a better k-th score from the partial sums; what cannot reach it goes
    best = _best_values(partial.withColumn("_s", F.floor(F.col("part") * scale).cast("long")), k, "_s")
    least = best.groupBy("field", "sq").agg(F.sum("n").alias("held"), F.min("_s").alias("_s"))
    kept = (partial.join(least, ["field", "sq"]).join(left, ["field", "sq"], "left")
            .withColumn("most", F.col("part") + F.coalesce("left", F.lit(0.0)))
            .where((F.col("held") < k) | (F.col("most") + margin >= F.col("_s") / scale))
            .select("field", "sq", "vid", "n", "part"))
    more = (kept.join(rest.select("field", "sq", "term", "qw"), ["field", "sq"])
            .join(postings.select("field", "term", "vid", "w"), ["field", "term", "vid"])
            .select("field", "sq", "vid", "n", (F.col("qw") * F.col("w")).alias("part")))
    whole = kept.unionByName(more).groupBy("field", "sq", "vid").agg(
        F.sum("part").alias("score"), F.first("n").alias("n"))
    return whole, queries, values


def pruned_top_k(index: KeywordIndex, weighted: DataFrame, k: int, decimals: int = 4) -> DataFrame:
    """The hits of ``top_k(score_pairs(..))``, without scoring every pair.

    A document among a query's k best is also among the k best of the field
    that gives its score: whatever is ahead of it there is ahead of it
    overall. So each field query keeps its k best documents, and the queries
    choose among those.
    """
    whole, queries, values = pruned_candidates(index, weighted, k, decimals)
    scored = whole.withColumn("score", F.round("score", 9))
    scored = scored.withColumn("_s", F.round(F.round("score", decimals) * 10.0 ** decimals).cast("long"))
    of_value = Window.partitionBy("field", "vid").orderBy("id")
    members = values.withColumn("_m", F.row_number().over(of_value)).where(F.col("_m") <= k).drop("_m")
    best = _best_values(scored, k, "_s").join(members, ["field", "vid"])
    by = Window.partitionBy("sq", "field").orderBy(F.desc("_s"), F.asc("id"))
    best = best.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= k)
    best = materialize(best)
    # a query's k-th best score is at least the best of its fields' k-th ones; what is
    # below that is not sent on
    kth = best.where(F.col("_rn") == k).select("field", "sq", F.col("_s").alias("_kth"))
    least = F.coalesce(F.max("_kth").over(Window.partitionBy("query_id")), F.lit(-(1 << 62)))
    asked = materialize(queries.join(kth, ["field", "sq"], "left").withColumn("_least", least).select("query_id", "field", "sq", "_least"))
    found = asked.join(best.select("field", "sq", "id", "score", "_s"), ["field", "sq"]).where(F.col("_s") >= F.col("_least"))
    per = found.groupBy("query_id", "id").agg(F.max(F.struct("score", "field")).alias("best"))
    return top_k(per.select("query_id", "id", F.round("best.score", decimals).alias("score"),
                            F.col("best.field").alias("best_field")), k)


class _Totals:
    """Of a block of query classes: the number of documents hit, and the classes
    of documents that can be among a query's k best, by the best field's score.
    Blocks of document classes come one after another (``vid``: numbers in order
    of the classes' smallest documents)."""

    def __init__(self, q: dict[str, np.ndarray], k: int, margin: float):
        self.k, self.margin = k, margin
        self.row, self.sq = pd.factorize(q["sq"])
        self.q = q
        self.total = np.zeros(len(self.sq), np.int64)
        # of the pairs kept: query, class, score, field, documents
        self.kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int32, np.int64)]

    def meet(self, v: dict[str, np.ndarray], col: np.ndarray, vid: np.ndarray) -> None:
        n = np.zeros(len(vid), np.int64)
        n[col] = v["n"]
        best, rounded = (np.full((len(self.sq), len(vid)), -np.inf) for _ in range(2))
        of, hit = np.zeros(best.shape, np.int32), np.zeros(best.shape, bool)
        # in ascending order: the last of equal fields wins; a field without common terms gives 0
        for field in range(int(max(self.q["f"].max(), v["f"].max())) + 1):
            here, there = self.q["f"] == field, v["f"] == field
            v_term, terms = pd.factorize(v["t"][there])
            q_term = pd.Index(terms).get_indexer(self.q["t"][here])
            scores = np.zeros(best.shape)
            _added(scores, *_grouped(self.row[here], q_term, self.q["qw"][here], len(terms)),
                   *_grouped(col[there], v_term, v["w"][there], len(terms)), hit)
            # compared at 9 decimals so float summation order cannot pick the field
            now = np.round(scores, 9)
            more = now >= rounded
            best[more], rounded[more], of[more] = scores[more], now[more], field
        best[~hit] = -np.inf
        self.total += hit @ n
        r, c = np.nonzero(hit & (best + self.margin >= _kth(best, n, self.k)[:, None]))
        self._keep(*(np.concatenate(x) for x in zip(self.kept, (r, vid[c], best[r, c], of[r, c], n[c]))))

    def _keep(self, row: np.ndarray, vid: np.ndarray, score: np.ndarray, of: np.ndarray, n: np.ndarray) -> None:
        """Classes under a query's k best documents go, and of equal scores all
        but the k first classes."""
        same = np.round(score, 9)
        order = np.lexsort((vid, -same, row))
        row, vid, score, of, n, same = (x[order] for x in (row, vid, score, of, n, same))
        if not len(row):
            return
        place = np.arange(len(row))
        new = np.r_[True, (row[1:] != row[:-1]) | (same[1:] != same[:-1])]
        first = np.r_[True, row[1:] != row[:-1]]
        held = np.cumsum(n)
        start = np.repeat((held - n)[first], np.diff(np.r_[np.flatnonzero(first), len(row)]))
        at = np.flatnonzero(held - start >= self.k)  # the first of these in a query is its k-th
        at = at[np.r_[True, row[at][1:] != row[at][:-1]][:len(at)]]
        kth = np.full(len(self.sq), -np.inf)
        kth[row[at]] = score[at]
        kept = (score + self.margin >= kth[row]) & (place - np.maximum.accumulate(np.where(new, place, 0)) < self.k)
        self.kept = [x[kept] for x in (row, vid, score, of, n)]

    def pairs(self) -> list[np.ndarray]:
        some = np.flatnonzero(self.total)
        row, vid, score, of, n = self.kept
        rest = np.full(len(some), NO_ID), np.zeros(len(some)), np.zeros(len(some), np.int32), self.total[some]
        return [np.concatenate(x) for x in zip((self.sq[row], vid, score, of, n), (self.sq[some], *rest))]


def top_k_with_totals(index: KeywordIndex, weighted: DataFrame, fields: list[str], k: int, decimals: int) -> DataFrame:
    """The hits of ``top_k(score_pairs(..))`` with the number of all hits. Every
    pair is scored, but none is sent or written before it is among the k best
    that its task found: classes of queries meet classes of documents (equal in
    the terms that any query has) in blocks, all fields in one. Terms and classes
    travel as numbers, each class once."""
    margin = 2 * 10.0 ** -decimals
    spark = index.postings.sparkSession
    names = sorted(fields)
    weighted = weighted.where("query_id is not null")
    place = F.array_position(F.array(*[F.lit(f) for f in names]), F.col("field")) - 1
    weighted = materialize(weighted)
    asked = materialize(weighted.select("field", "term").distinct()
                        .withColumn("f", place.cast("int")).withColumn("t", F.monotonically_increasing_id()))
    weighted = materialize(weighted.join(asked, ["field", "term"]).select("f", "t", "query_id", "qw"))
    hit = materialize(index.postings.join(asked, ["field", "term"]).select("f", "t", "id", "w"))

    def classes(rows: DataFrame, member: str, weight: str) -> DataFrame:
        """(member, cls, first, n): members with equal rows share a class; its
        smallest member (null first) and size. Classes are numbered in order of
        their smallest members."""
        listed = F.sort_array(F.collect_list(F.struct("t", weight)))
        members = materialize(rows.groupBy(member).agg(F.sha2(F.to_json(listed), 256).alias("sig")))
        sized = members.groupBy("sig").agg(F.min(F.struct(member))[member].alias("first"), F.count(F.lit(1)).alias("n"))
        numbered = materialize(sized.orderBy("first").withColumn("cls", F.monotonically_increasing_id()))
        return materialize(members.join(numbered, "sig").drop("sig"))

    def of_first(rows: DataFrame, members: DataFrame, member: str, cls: str, weight: str) -> DataFrame:
        """The rows of each class's smallest member."""
        heads = members.where(F.col(member).eqNullSafe(F.col("first"))).withColumnRenamed(member, "_m")
        return (rows.join(heads, F.col(member).eqNullSafe(F.col("_m")))
                .select(F.col("cls").alias(cls), "n", "f", "t", F.col(weight).cast("double").alias(weight)))
    queries, docs = classes(weighted, "query_id", "qw"), classes(hit, "id", "w")
    q, v = of_first(weighted, queries, "query_id", "sq", "qw").drop("n"), of_first(hit, docs, "id", "vid", "w")
    sizes = [rows.agg(F.approx_count_distinct(m), F.count(F.lit(1))).first() for rows, m in ((q, "sq"), (v, "vid"))]
    qs, vs = (max(1, math.ceil(r[0] / most), math.ceil(r[1] / TILE_ROWS))
              for r, most in zip(sizes, (TILE_QUERIES, TILE_VALUES)))
    qs = max(qs, min(2 * spark.sparkContext.defaultParallelism, math.ceil(sizes[0][0] / 64)))

    def ready(block: dict[str, np.ndarray]) -> tuple:
        return block, *pd.factorize(block["vid"])
    found = materialize(bk.met(
        q.repartition(qs, "sq").sortWithinPartitions("sq"), v.repartition(vs, "vid").sortWithinPartitions("vid"), (qs, vs),
        lambda block: _Totals(block, k, margin), ready, "sq long, vid long, score double, f int, n long", 2 * TILE_ROWS,
        ("sq", "vid"))).repartition("sq")
    totals = found.where("vid is null").groupBy("sq").agg(F.sum("n").alias("total_hits"))
    score = F.col("score") if len(fields) == 1 else F.round("score", 9)
    scored = found.where("vid is not null").withColumn("score", F.round(score, decimals))
    scored = (scored.withColumn("_s", F.round(F.col("score") * 10.0 ** decimals).cast("long")).withColumn("field", F.lit(""))
              .withColumn("best_field", F.get(F.array(*[F.lit(f) for f in names]), F.col("f"))))
    members = docs.withColumn("_m", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("_m") <= k)
    best = _best_values(scored, k, "_s").join(members.select(F.col("cls").alias("vid"), "id"), "vid")
    ranked = top_k(best.select("sq", "id", "score", "best_field"), k, part="sq").join(totals, "sq")
    return (queries.select("query_id", F.col("cls").alias("sq")).join(ranked, "sq")
            .select("query_id", "id", "score", "best_field", "rank", "total_hits"))


def search(index: KeywordIndex, queries: DataFrame, fields: list[str], k: int = 10,
           edge: bool = False, fuzzy: bool = True, prefix_length: int = 2,
           max_expansions: int = 50, decimals: int = 4, with_total: bool = True,
           qid: str = "query_id", text_col: str = "text") -> DataFrame:
    """K2/K3/K4/K5: top-k hits per query with rank and, if asked for, total
    hits (which take scoring every pair).

    ``fields`` are the plain fields; ``edge=True`` adds their prefix
    sub-fields (K4). Scores are rounded before ranking so ties are broken by
    id the same way in every engine."""
    all_fields = list(fields) + ([f + EDGE_SUFFIX for f in fields] if edge else [])
    # few bytes, much work: dealt by number, as the planner would make one task of them
    queries = queries.select(qid, text_col).repartition(queries.sparkSession.sparkContext.defaultParallelism, F.col(qid))
    qt = materialize(query_terms(queries, fields, edge=edge, qid=qid, text_col=text_col))
    weighted = weighted_terms(index, qt, fuzzy, prefix_length, max_expansions)
    if not with_total:
        return pruned_top_k(index, weighted, k, decimals)
    if len(all_fields) > 1:
        return top_k_with_totals(index, weighted, all_fields, k, decimals)
    # one field is summed faster by pair than in tiles
    pairs = score_pairs(index, weighted, all_fields).withColumn("score", F.round("score", decimals))
    # counted over the score column, so that both branches read one exchange
    totals = pairs.groupBy("query_id").agg(F.count("score").alias("total_hits"))
    return top_k(pairs, k).join(totals, "query_id")


def field_search(index: KeywordIndex, queries: DataFrame, field: str, k: int = 10,
                 fields_allowed: list[str] | None = None, **kw) -> DataFrame:
    """K2: one-field search; fuzzy AUTO without a fixed prefix."""
    if fields_allowed is not None and field not in fields_allowed:
        raise ValueError(f"Invalid field name. Must be one of: {fields_allowed}")
    kw.setdefault("prefix_length", 0)
    return search(index, queries, [field], k=k, edge=False, **kw)


def answers(index: KeywordIndex, queries: DataFrame, fields: list[str], top_k_col: str = "top_k",
            qid: str = "query_id", text_col: str = "text", **how) -> tuple[DataFrame, DataFrame]:
    """(one row per query -- its error or null, and its number of hits;
    the hits). Each query asks for its own ``top_k_col``; a query in error
    gets no hits and does not stop the others."""
    checked = validate_queries(queries, text_col, top_k_col)
    good = checked.where(F.col("error").isNull())
    hits = search(index, good, fields, k=MAX_TOP_K, qid=qid, text_col=text_col, **how)
    hits = (hits.join(good.select(F.col(qid).alias("query_id"), F.col(top_k_col).alias("_k")), "query_id")
            .where(F.col("rank") <= F.col("_k")).drop("_k"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = checked.select(F.col(qid).alias("query_id"), "error").join(n, "query_id", "left")
    return rows.withColumn("hits", F.coalesce("hits", F.lit(0))), hits


def documents_by_id(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """K6: requested ids with a found flag and the stored row when present."""
    found = docs.withColumn("_found", F.lit(True))
    return (ids.select(F.col(id_col).alias(id_col)).join(found, id_col, "left")
            .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found"))


def exact_match_flag(hits: DataFrame, queries: DataFrame, docs: DataFrame, threshold: float = 20.0,
                     name_col: str = "item_name", desc_col: str = "description") -> DataFrame:
    """K7: rank-1 hit is an exact match when its score is above the threshold
    or the query equals the name or description ignoring case."""
    top = hits.where(F.col("rank") == 1).join(queries.select("query_id", "text"), "query_id") \
        .join(docs.select("id", name_col, desc_col), "id")
    q = F.lower(F.col("text"))
    flag = (F.col("score") > threshold) | (q == F.lower(F.col(name_col))) | (q == F.lower(F.col(desc_col)))
    return top.select("query_id", "id", "score", F.coalesce(flag, F.lit(False)).alias("exact_match"))
