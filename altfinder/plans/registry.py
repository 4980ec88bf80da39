"""Registered queries: each reads the driver tables at ``sf_dir`` and returns
a DataFrame; ``ORACLE`` holds the equivalent DuckDB SQL over the same tables.

Column names and types are pinned on both sides (rank int, counts bigint,
scores double rounded before ranking) so the value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from altfinder.functions import text as tx
from altfinder.operators import keyword as kw
from altfinder.operators import clean as cl
from altfinder.operators import vectors as vx
from altfinder.schemas import TEXT_FIELDS
from altfinder.session import materialize, read_stream, read_table, scratch
from altfinder.sources.catalog import INVENTORY_SQL, inventory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


WORD_RE = tx.WORD_PATTERN
STOPS = tx.stop_words_sql()


def std_terms_sql(expr: str) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '{WORD_RE}'), lambda t: NOT list_contains({STOPS}, t))"


# --------------------------------------------------------------------------- K1 K2 K5 X1

DOC_BM25_SQL = f"""
WITH d AS (
  SELECT doc_id AS id, {std_terms_sql('text')} AS terms FROM documents
), d2 AS (SELECT id, terms, len(terms) AS dl FROM d WHERE len(terms) > 0),
fs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM d2),
p AS (
  SELECT id, dl, term, count(*) AS tf
  FROM (SELECT id, dl, unnest(terms) AS term FROM d2) GROUP BY id, dl, term
),
qt AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id, unnest({std_terms_sql('text')}) AS term
    FROM benchmark WHERE text IS NOT NULL AND regexp_replace(text, '\\s', '', 'g') <> ''
  ) GROUP BY query_id, term
),
df AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM qt) GROUP BY term),
s AS (
  SELECT qt.query_id, p.id,
         round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
                   * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM qt JOIN df USING (term) JOIN p USING (term) CROSS JOIN fs
  GROUP BY qt.query_id, p.id
),
r AS (
  SELECT query_id, id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total_hits
  FROM s
)
SELECT query_id, rank, id, score, total_hits FROM r WHERE rank <= 10
"""


@register("keyword_bm25_documents", DOC_BM25_SQL)
def keyword_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 documents for every benchmark passage (single-field BM25)."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = kw.KeywordIndex.build(docs, ["text"])
    hits = kw.search(index, queries, ["text"], k=10, fuzzy=False)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score", "total_hits")


# --------------------------------------------------------------------------- SQL fragments

WS = tx.WS_CLASS


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '{tx.STRIP_PATTERN}', '', 'g')"


def clean_sql(e: str) -> str:
    s = strip_sql(e)
    return f"CASE WHEN {s} IS NULL OR lower({s}) IN ('null', 'none', 'n/a', '') THEN NULL ELSE {s} END"


def words_sql(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{WORD_RE}')"


def folded_terms_sql(e: str) -> str:
    return f"list_transform({words_sql(e)}, lambda w: {tx.fold_sql('w')})"


def edge_grams_sql(e: str) -> str:
    return (f"flatten(list_transform({words_sql(e)}, lambda w: CASE WHEN length(w) >= 2 THEN "
            f"list_transform(generate_series(2, least(length(w), 15)), lambda n: {tx.fold_sql('substr(w, 1, n)')}) "
            f"ELSE []::VARCHAR[] END))")


def combine_sql(fields) -> str:
    parts = []
    for f in fields:
        parts.append(f"CASE WHEN {f} IS NOT NULL AND {strip_sql(f)} <> '' AND lower({f}) <> 'none' "
                     f"THEN {strip_sql(f)} END")
    joined = f"concat_ws(' ', {', '.join(parts)})"
    return strip_sql(f"regexp_replace({joined}, '{tx.COLLAPSE_PATTERN}', ' ', 'g')")


def truthy_sql(fields) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {f} <> '' THEN {f} END" for f in fields) + ")"


DEFAULT_INV_CTE = f"inv AS ({INVENTORY_SQL})"


def clean_inv_sql(inv_cte: str = DEFAULT_INV_CTE) -> str:
    """CTEs ``inv`` (the catalogue, defined by ``inv_cte``), ``cinv`` and
    ``docs`` (cleaned rows)."""
    return f"""
{inv_cte},
cinv AS (
  SELECT id, {', '.join(f'{clean_sql(f)} AS {f}' for f in TEXT_FIELDS)} FROM inv WHERE id IS NOT NULL
),
docs AS (SELECT * FROM cinv WHERE coalesce({', '.join(TEXT_FIELDS)}) IS NOT NULL)
"""


CLEAN_INV_SQL = clean_inv_sql()


def clean_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after the ETL cleaner."""
    return cl.transform(inventory(spark, sf_dir))


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query text of every catalogue item -- name, description, brand as
    stored (not cleaned), non-empty ones joined."""
    return inventory(spark, sf_dir).select(
        F.col("id").alias("query_id"), tx.join_truthy(["item_name", "description", "brand"]).alias("text"))


# --------------------------------------------------------------------------- K3 K4 X2-X6

_ALL_FIELDS = TEXT_FIELDS + [f + kw.EDGE_SUFFIX for f in TEXT_FIELDS]


def _analysed_sql() -> str:
    parts = []
    for f in TEXT_FIELDS:
        parts.append(f"SELECT id, '{f}' AS field, {std_terms_sql(f)} AS terms FROM docs WHERE {f} IS NOT NULL")
        parts.append(f"SELECT id, '{f}.edge' AS field, {edge_grams_sql(f)} AS terms FROM docs WHERE {f} IS NOT NULL")
    return "\n  UNION ALL ".join(parts)


def multifield_ctes(inv_cte: str = DEFAULT_INV_CTE, src_where: str = "true") -> str:
    """CTEs up to ``kwr``: every (query, doc) with best-field score and rank;
    queries are the catalogue rows selected by ``src_where``."""
    return f"""{clean_inv_sql(inv_cte)},
a AS (
  {_analysed_sql()}
),
a2 AS (SELECT field, id, terms, len(terms) AS dl FROM a WHERE len(terms) > 0),
fs AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM a2 GROUP BY field),
p AS (
  SELECT field, id, dl, term, count(*) AS tf
  FROM (SELECT field, id, dl, unnest(terms) AS term FROM a2) GROUP BY field, id, dl, term
),
vocab AS (SELECT DISTINCT field, term FROM p),
q AS (SELECT id AS query_id, {truthy_sql(['item_name', 'description', 'brand'])} AS text FROM inv WHERE {src_where}),
qv AS (SELECT * FROM q WHERE text IS NOT NULL AND {strip_sql('text')} <> ''),
flds AS (SELECT unnest([{', '.join(repr(f) for f in _ALL_FIELDS)}]) AS field),
qt AS (
  SELECT query_id, field, term, count(*) AS qtf FROM (
    SELECT query_id, flds.field,
           unnest(CASE WHEN flds.field LIKE '%.edge' THEN {folded_terms_sql('text')}
                       ELSE {std_terms_sql('text')} END) AS term
    FROM qv CROSS JOIN flds
  ) GROUP BY query_id, field, term
),
ex0 AS (
  SELECT t.field, t.term, v.term AS match_term, damerau_levenshtein(t.term, v.term) AS edits,
         CASE WHEN length(t.term) <= 2 THEN 0 WHEN length(t.term) <= 5 THEN 1 ELSE 2 END AS max_d
  FROM (SELECT DISTINCT field, term FROM qt) t
  JOIN vocab v ON v.field = t.field AND substr(v.term, 1, 2) = substr(t.term, 1, 2)
),
ex1 AS (
  SELECT field, term, match_term, 1.0 - edits / least(length(term), length(match_term)) AS boost
  FROM ex0 WHERE edits <= max_d
),
ex AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY field, term ORDER BY boost DESC, match_term) AS rn FROM ex1
  ) WHERE rn <= 50
),
pdf AS (
  SELECT p.field, p.term, count(*) AS df FROM p
  WHERE (p.field, p.term) IN (SELECT (field, match_term) FROM ex) GROUP BY p.field, p.term
),
c AS (
  SELECT qt.query_id, p.id, qt.field,
         sum(qt.qtf * ex.boost * ln(1 + (fs.n_docs - pdf.df + 0.5) / (pdf.df + 0.5))
             * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / fs.avgdl))) AS s
  FROM qt JOIN ex ON ex.field = qt.field AND ex.term = qt.term
  JOIN pdf ON pdf.field = ex.field AND pdf.term = ex.match_term
  JOIN fs ON fs.field = qt.field
  JOIN p ON p.field = ex.field AND p.term = ex.match_term
  GROUP BY qt.query_id, p.id, qt.field
),
b AS (SELECT query_id, id, field, round(s, 9) AS s9 FROM c),
best AS (SELECT query_id, id, max(s9) AS s9 FROM b GROUP BY query_id, id),
bf AS (
  SELECT b.query_id, b.id, round(b.s9, 4) AS score, max(b.field) AS best_field
  FROM b JOIN best USING (query_id, id, s9) GROUP BY b.query_id, b.id, b.s9
),
kwr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total_hits
  FROM bf
)"""


MULTIFIELD_SQL = f"""WITH {multifield_ctes()}
SELECT query_id, rank, id, score, best_field, total_hits FROM kwr WHERE rank <= 10
"""


def multifield_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    docs = clean_inventory(spark, sf_dir)
    index = kw.KeywordIndex.build(docs, TEXT_FIELDS, edge=True)
    return kw.search(index, item_queries(spark, sf_dir), TEXT_FIELDS, k=k, edge=True, fuzzy=True,
                     prefix_length=2, max_expansions=50)


@register("keyword_multifield_inventory", MULTIFIELD_SQL)
def keyword_multifield_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 per catalogue item over six fields and their prefix sub-fields,
    fuzzy AUTO behind a 2-letter prefix, best field wins."""
    hits = multifield_search(spark, sf_dir)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score",
                       "best_field", "total_hits")


# --------------------------------------------------------------------------- V3 V5

EMB_DIM = 64

VEC_SQL = f"""
WITH v AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {EMB_DIM}
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
),
s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a, v b),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, cosine, (1 + cosine) / 2 AS score FROM r WHERE rank <= 10
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vx.valid_vectors(emb, EMB_DIM)


@register("vector_knn_exact", VEC_SQL)
def vector_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's 10 nearest vectors by cosine."""
    v = _vectors(spark, sf_dir)
    return vx.knn(v.withColumnRenamed("id", "query_id"), v, k=10)


@register("vector_knn_exact_blocked", VEC_SQL)
def vector_knn_exact_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same answer with small blocks, so that several meet."""
    v = _vectors(spark, sf_dir)
    return vx.knn(v.withColumnRenamed("id", "query_id"), v, k=10,
                  q_block_rows=128, v_block_rows=128)


IVF_CTES = f"""v AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {EMB_DIM}
    AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
),
n AS (SELECT least(ceil(sqrt(count(*))), {vx.MAX_CELLS}) AS cells FROM v),
c AS (SELECT * FROM (SELECT e AS ce, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS cell FROM v)
      WHERE cell < (SELECT cells FROM n)),
near AS (
  SELECT v.id, v.e, c.cell,
         row_number() OVER (PARTITION BY v.id ORDER BY round(list_cosine_similarity(v.e, c.ce), 6) DESC, c.cell) AS place
  FROM v CROSS JOIN c
),
si AS (
  SELECT q.id AS query_id, x.id, round(list_cosine_similarity(q.e, x.e), 6) AS cosine
  FROM near q JOIN near x ON q.cell = x.cell AND x.place = 1
  WHERE q.place <= (SELECT ceil({vx.PROBED} * cells) FROM n)
),
ri AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM si
)"""


@register("vector_knn_ivf", f"""WITH {IVF_CTES}
SELECT query_id, rank, id, cosine, (1 + cosine) / 2 AS score FROM ri WHERE rank <= 10""")
def vector_knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: approximate top 10 over as many cells as the square root of the
    rows, 0.7 of them probed per query."""
    v = _vectors(spark, sf_dir)
    return vx.knn_ivf(v.withColumnRenamed("id", "query_id"), v, k=10)


@register("vector_ivf_recall", f"""WITH {IVF_CTES},
se AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a, v b),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM se),
h AS (
  SELECT re.query_id, count(ri.id) / count(*) AS recall
  FROM re LEFT JOIN ri ON ri.query_id = re.query_id AND ri.id = re.id AND ri.rank <= 10
  WHERE re.rank <= 10 GROUP BY re.query_id
)
SELECT query_id, recall, (SELECT round(avg(recall), 6) FROM h) AS mean_recall FROM h""")
def vector_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 quality: recall@10 of the approximate search against the exact one."""
    v = _vectors(spark, sf_dir)
    q = v.withColumnRenamed("id", "query_id")
    return vx.recall_at_k(vx.knn_ivf(q, v, k=10), vx.knn(q, v, k=10))


# --------------------------------------------------------------------------- H1-H5, P5-P7, V1, V2

from altfinder.operators import hybrid as hy  # noqa: E402
from altfinder.plans import substitutes as sb  # noqa: E402

HYBRID_TOP_K = 20
HYBRID_DIM = 128


def hybrid_candidates(spark: SparkSession, sf_dir: str, top_k: int = HYBRID_TOP_K,
                      dim: int = HYBRID_DIM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates with payload, sources, clean catalogue) for every item of
    the catalogue as a source: keyword leg (2 x top_k), vector leg (2 x top_k)
    over the lexical embedding of the combined text, merged by id."""
    raw = materialize(inventory(spark, sf_dir))  # read by both legs and the size checks
    legs = sb.Legs.build(raw, dim)
    sources = hy.source_query_text(hy.source_lookup(raw, raw.select("item_number")))
    sources = sources.where("found").withColumnRenamed("id", "query_id")
    cands = sb.candidates(raw, legs, sources.select("query_id", "query_text"), top_k, dim)
    return cands, sources, legs.clean


def _hybrid_vec_ctes(dim: int) -> str:
    bucket = f"(('0x' || substr(md5(term), 1, 8))::BIGINT) % {dim}"
    return f"""vdoc AS (SELECT id, {combine_sql(TEXT_FIELDS)} AS t FROM inv),
vterm AS (SELECT id, unnest({std_terms_sql('t')}) AS term FROM vdoc WHERE t <> ''),
vb AS (SELECT id, {bucket} AS b, count(*) AS c FROM vterm GROUP BY ALL),
vn AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM vb GROUP BY id),
qterm AS (SELECT query_id, unnest({std_terms_sql('text')}) AS term FROM qv),
qb AS (SELECT query_id, {bucket} AS b, count(*) AS c FROM qterm GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(c * c)) AS nrm FROM qb GROUP BY query_id),
dot AS (SELECT qb.query_id, vb.id, sum(qb.c * vb.c) AS d FROM qb JOIN vb USING (b) GROUP BY ALL),
vs AS (
  SELECT qn.query_id, vn.id, round(coalesce(dot.d, 0) / (qn.nrm * vn.nrm), 6) AS cosine
  FROM qn CROSS JOIN vn LEFT JOIN dot ON dot.query_id = qn.query_id AND dot.id = vn.id
),
vr AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM vs)"""


def hybrid_ctes(top_k: int = HYBRID_TOP_K, dim: int = HYBRID_DIM, inv_cte: str = DEFAULT_INV_CTE,
                src_where: str = "true") -> str:
    k2 = 2 * top_k
    payload_k = ", ".join(f"d.{f} AS _k_{f}" for f in TEXT_FIELDS)
    payload_v = ", ".join(f"i.{f} AS _v_{f}" for f in TEXT_FIELDS)
    pick = ", ".join(f"CASE WHEN in_keyword THEN _k_{f} ELSE _v_{f} END AS {f}" for f in TEXT_FIELDS)
    return f"""{multifield_ctes(inv_cte, src_where)},
{_hybrid_vec_ctes(dim)},
vh AS (SELECT query_id, id, rank AS vec_rank, (1 + cosine) / 2 AS vec_score FROM vr WHERE rank <= {k2}),
kh AS (SELECT query_id, id, rank AS kw_rank, score AS kw_score FROM kwr WHERE rank <= {k2}),
withvec AS (SELECT DISTINCT query_id FROM qn),
m AS (
  SELECT coalesce(kh.query_id, vh.query_id) AS query_id, coalesce(kh.id, vh.id) AS id,
         kw_rank, kw_score, vec_rank, vec_score
  FROM (SELECT * FROM kh WHERE query_id IN (SELECT query_id FROM withvec)) kh
  FULL OUTER JOIN vh ON kh.query_id = vh.query_id AND kh.id = vh.id
),
mm AS (
  SELECT query_id, id, coalesce(kw_score, 0.0) AS keyword_score, coalesce(vec_score, 0.0) AS vector_score,
         kw_rank IS NOT NULL AS in_keyword, vec_rank IS NOT NULL AS in_vector,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY kw_rank IS NULL, kw_rank, vec_rank) AS INTEGER)
           AS position
  FROM m
  UNION ALL
  SELECT query_id, id, kw_score, 0.0, true, false, CAST(kw_rank AS INTEGER)
  FROM kh WHERE query_id NOT IN (SELECT query_id FROM withvec) AND kw_rank <= {top_k}
),
cand AS (
  SELECT mm.*, {pick} FROM (
    SELECT mm.*, {payload_k}, {payload_v}
    FROM mm LEFT JOIN docs d ON d.id = mm.id LEFT JOIN inv i ON i.id = mm.id
  ) mm
)"""


HYBRID_SQL = f"""WITH {hybrid_ctes()}
SELECT query_id, id, position, keyword_score, vector_score, in_keyword, in_vector,
       {truthy_sql(TEXT_FIELDS)} AS text_combined
FROM cand
"""


@register("hybrid_candidates_inventory", HYBRID_SQL)
def hybrid_candidates_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged keyword + vector candidates (2 x 20 each) for every item."""
    cands, _, _ = hybrid_candidates(spark, sf_dir)
    return cands.select("query_id", "id", F.col("position").cast("int").alias("position"), "keyword_score",
                        "vector_score", "in_keyword", "in_vector", "text_combined")


# --------------------------------------------------------------------------- C1-C8 over the event-derived table

from altfinder.operators import crossref as xr  # noqa: E402
from altfinder.operators import feedback as fbk  # noqa: E402
from altfinder.sources import derived as dv  # noqa: E402

RUN_TS = "2025-01-01 00:00:00"


def parsed_entries_sql(src: str, bad_score: int) -> str:
    """SQL for M6 over (item_number, pos, r) rows of ``src``."""
    st = lambda e: strip_sql(e)
    return f"""(
  SELECT item_number, pos, r, {st('parts[1]')} AS item,
         coalesce(CASE WHEN regexp_matches({st('parts[2]')}, '^[+-]?[0-9]+$')
                       THEN TRY_CAST({st('parts[2]')} AS INTEGER) END, {bad_score}) AS score,
         CASE WHEN len(parts) >= 3 AND parts[3] <> ''
              THEN list_filter(list_transform(string_split(parts[3], ','), lambda a: {st('a')}), lambda a: a <> '')
              ELSE []::VARCHAR[] END AS attrs
  FROM (SELECT *, string_split(r, '|') AS parts FROM {src}) WHERE r IS NOT NULL AND r <> '' AND len(parts) >= 2
)"""


BEST_ALT_SQL = f"""WITH {dv.CROSSREF_ENTRIES_SQL},
pe AS {parsed_entries_sql('xr', 0)},
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_number ORDER BY score DESC, pos) AS rn
  FROM pe WHERE item <> item_number
)
SELECT item_number, item AS alt_item_number, score AS match_score,
       array_to_string(attrs, ',') AS varying_attributes
FROM r WHERE rn = 1
"""


@register("crossref_best_alternative", BEST_ALT_SQL)
def crossref_best_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 (+ M6 with bad score 0): best non-self alternative per source."""
    b = xr.best_alternative(dv.crossref_from_events(spark, sf_dir))
    return b.withColumn("varying_attributes", F.array_join("varying_attributes", ","))


LOOKUP_SQL = f"""WITH {dv.CROSSREF_ENTRIES_SQL},
req AS (SELECT DISTINCT source_item AS item_number FROM ({dv.FEEDBACK_SQL})),
pe AS {parsed_entries_sql('xr', 50)},
r AS (
  SELECT pe.*, CAST(row_number() OVER (PARTITION BY item_number ORDER BY score DESC, pos) AS INTEGER) AS rank
  FROM pe JOIN req USING (item_number) WHERE item <> item_number
)
SELECT item_number, rank, item AS matched_item, score AS match_score,
       array_to_string(attrs, ',') AS varying_attributes, 0 AS likes, 0 AS dislikes
FROM r WHERE rank <= 3
"""


@register("crossref_lookup_top3", LOOKUP_SQL)
def crossref_lookup_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 + C5: stored matches of every source that received feedback, sorted
    by score (stable), source removed, cut to 3 (no enrichment: the event
    table's items are not catalogue items)."""
    req = dv.match_feedback(spark, sf_dir).select(F.col("source_item").alias("item_number")).distinct()
    out = xr.cross_references_for(dv.crossref_from_events(spark, sf_dir), req, None, top_k=3, enrich=False)
    return out.select("item_number", F.col("rank").cast("int").alias("rank"), "matched_item", "match_score",
                      F.array_join("varying_attributes", ",").alias("varying_attributes"), "likes", "dislikes")


def _deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion requests derived from the click events."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    return ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source_item"),
                     F.concat(F.lit("M"), (F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int") % 5)
                              .cast("string")).alias("matched_item")).distinct()


DELETIONS_SQL = """SELECT DISTINCT concat('U', CAST(user_id AS VARCHAR)) AS source_item,
       concat('M', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR)) AS matched_item
FROM events WHERE event_type = 'click'"""

DELETE_TABLE_SQL = f"""WITH {dv.CROSSREF_ENTRIES_SQL},
del AS ({DELETIONS_SQL}),
kept AS (
  SELECT xr.* FROM xr
  WHERE NOT EXISTS (
    SELECT 1 FROM del WHERE del.source_item = xr.item_number AND instr(xr.r, '|') > 0
      AND split_part(xr.r, '|', 1) = del.matched_item)
)
SELECT item_number, CAST(row_number() OVER (PARTITION BY item_number ORDER BY pos) - 1 AS INTEGER) AS pos, r
FROM kept
"""


@register("crossref_after_delete", DELETE_TABLE_SQL)
def crossref_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after removing every entry named by a deletion request."""
    new, _ = xr.delete_matches(dv.crossref_from_events(spark, sf_dir), _deletions(spark, sf_dir), RUN_TS)
    return new.select("item_number", F.posexplode("matches").alias("pos", "m")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"))


DELETE_STATUS_SQL = f"""WITH {dv.CROSSREF_ENTRIES_SQL},
del AS ({DELETIONS_SQL}),
hit AS (
  SELECT DISTINCT del.source_item, del.matched_item FROM del JOIN xr
    ON xr.item_number = del.source_item AND instr(xr.r, '|') > 0 AND split_part(xr.r, '|', 1) = del.matched_item
),
sz AS (SELECT item_number AS source_item, count(*) AS n FROM xr GROUP BY 1),
rem AS (
  SELECT sz.source_item, sz.n - coalesce(x.removed, 0) AS remaining FROM sz LEFT JOIN (
    SELECT xr.item_number AS source_item, count(*) AS removed FROM xr JOIN del
      ON del.source_item = xr.item_number AND instr(xr.r, '|') > 0 AND split_part(xr.r, '|', 1) = del.matched_item
    GROUP BY 1) x USING (source_item)
)
SELECT del.source_item, del.matched_item,
       CASE WHEN sz.n IS NULL THEN 'no_crossref' WHEN hit.source_item IS NULL THEN 'not_found' ELSE 'removed' END
         AS status,
       CAST(CASE WHEN sz.n IS NULL THEN 0 ELSE rem.remaining END AS INTEGER) AS remaining_matches
FROM del LEFT JOIN hit USING (source_item, matched_item) LEFT JOIN sz USING (source_item)
LEFT JOIN rem USING (source_item)
"""


@register("crossref_delete_status", DELETE_STATUS_SQL)
def crossref_delete_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per deletion request: removed / not_found / no_crossref and the
    number of entries left."""
    _, status = xr.delete_matches(dv.crossref_from_events(spark, sf_dir), _deletions(spark, sf_dir), RUN_TS)
    return status.select("source_item", "matched_item", "status",
                         F.col("remaining_matches").cast("int").alias("remaining_matches"))


def _bulk_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk cross-reference entries from view events, in event order."""
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")
    r = F.concat(F.lit("M"), (k % 5).cast("string"), F.lit("|"), (F.lit(40) + k % 61).cast("string"), F.lit("|view"))
    return ev.select(F.col("event_id").alias("ordinal"),
                     F.concat(F.when(F.col("value") > 25, F.lit("U")).otherwise(F.lit("N")),
                              F.col("user_id").cast("string")).alias("item_number"),
                     F.array(F.struct(r.alias("r"), F.lit(None).cast("int").alias("l"),
                                      F.lit(None).cast("int").alias("d"))).alias("matches"))


BULK_SQL_CTE = """bulk AS (
  SELECT event_id AS ordinal,
         concat(CASE WHEN value > 25 THEN 'U' ELSE 'N' END, CAST(user_id AS VARCHAR)) AS item_number,
         concat('M', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR), '|',
                CAST(40 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 61 AS VARCHAR), '|view') AS r
  FROM events WHERE event_type = 'view'
)"""

BULK_COUNTS_SQL = f"""WITH {dv.CROSSREF_ENTRIES_SQL}, {BULK_SQL_CTE},
stored AS (SELECT DISTINCT item_number FROM xr),
f AS (
  SELECT CASE WHEN item_number IN (SELECT item_number FROM stored)
                OR row_number() OVER (PARTITION BY item_number ORDER BY ordinal) > 1
              THEN 'updated' ELSE 'saved' END AS outcome
  FROM bulk
)
SELECT outcome, count(*) AS n FROM f GROUP BY outcome
"""


@register("crossref_bulk_upsert_counts", BULK_COUNTS_SQL)
def crossref_bulk_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved / updated counts of a bulk save (repeats count as updates)."""
    _, counts = xr.bulk_upsert(dv.crossref_from_events(spark, sf_dir), _bulk_entries(spark, sf_dir), RUN_TS)
    return counts


BULK_TABLE_SQL = f"""WITH {dv.CROSSREF_ENTRIES_SQL}, {BULK_SQL_CTE},
last AS (
  SELECT item_number, r FROM (
    SELECT *, row_number() OVER (PARTITION BY item_number ORDER BY ordinal DESC) AS rn FROM bulk) WHERE rn = 1
),
merged AS (
  SELECT item_number, 0 AS pos, r, true AS changed FROM last
  UNION ALL
  SELECT item_number, pos, r, false AS changed FROM xr WHERE item_number NOT IN (SELECT item_number FROM last)
)
SELECT item_number, CAST(pos AS INTEGER) AS pos, r, changed FROM merged
"""


@register("crossref_bulk_upsert_table", BULK_TABLE_SQL)
def crossref_bulk_upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2 + C8: the table after the bulk save; ``changed`` marks rows
    whose updated_at was set by this run (created_at is kept)."""
    new, _ = xr.bulk_upsert(dv.crossref_from_events(spark, sf_dir), _bulk_entries(spark, sf_dir), RUN_TS)
    return new.select("item_number", F.posexplode("matches").alias("pos", "m"),
                      (F.col("updated_at") == F.lit(RUN_TS).cast("timestamp")).alias("changed")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"), "changed")


# --------------------------------------------------------------------------- F1-F4

FOLD_CTES = f"""{dv.CROSSREF_ENTRIES_SQL},
fb AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM ({dv.FEEDBACK_SQL})),
ent AS (
  SELECT item_number AS source_item, pos, r,
         CASE WHEN instr(r, '|') > 0 THEN split_part(r, '|', 1) END AS matched_item
  FROM xr
),
j AS (
  SELECT fb.event_id, fb.o, fb.source_item, fb.matched_item, ent.pos, ent.r,
         CASE WHEN feedback = 'like' THEN 1 ELSE 0 END AS is_like,
         CASE WHEN feedback = 'dislike' THEN 1 ELSE 0 END AS is_dislike
  FROM fb JOIN ent USING (source_item, matched_item)
),
rj AS (
  SELECT *, sum(is_like) OVER w AS cum_l, sum(is_dislike) OVER w AS cum_d FROM j
  WINDOW w AS (PARTITION BY source_item, pos ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
rm AS (SELECT source_item, pos, min(o) AS rm_o FROM rj WHERE cum_d > 5 GROUP BY source_item, pos),
ja AS (
  SELECT rj.*, (rm.rm_o IS NULL OR rj.o <= rm.rm_o) AS applied, coalesce(rj.o = rm.rm_o, false) AS removed_here
  FROM rj LEFT JOIN rm USING (source_item, pos)
),
sizes AS (SELECT item_number AS source_item, count(*) AS size FROM xr GROUP BY 1),
emptied AS (
  SELECT rm.source_item, max(rm.rm_o) AS empty_o FROM rm JOIN sizes USING (source_item)
  GROUP BY rm.source_item, sizes.size HAVING count(*) = sizes.size
),
st AS (
  SELECT source_item, pos, max(cum_l) AS l, max(cum_d) AS d, bool_or(removed_here) AS removed
  FROM ja WHERE applied GROUP BY source_item, pos
)"""

FOLD_REPLIES_SQL = f"""WITH {FOLD_CTES},
pe AS (
  SELECT event_id, arg_max(cum_l, pos) AS cl, arg_max(cum_d, pos) AS cd, bool_or(removed_here) AS removed
  FROM ja WHERE applied GROUP BY event_id
),
x AS (
  SELECT fb.event_id, fb.source_item, fb.matched_item,
         CASE WHEN coalesce(sizes.size, 0) = 0 OR (emptied.empty_o IS NOT NULL AND fb.o > emptied.empty_o)
              THEN 'no_crossref' WHEN pe.event_id IS NULL THEN 'not_found' ELSE 'updated' END AS status,
         pe.cl, pe.cd, pe.removed
  FROM fb LEFT JOIN sizes USING (source_item) LEFT JOIN emptied USING (source_item) LEFT JOIN pe USING (event_id)
)
SELECT event_id, source_item, matched_item, status,
       CAST(CASE WHEN status = 'updated' THEN cl ELSE 0 END AS INTEGER) AS likes,
       CAST(CASE WHEN status = 'updated' THEN cd ELSE 0 END AS INTEGER) AS dislikes,
       CASE WHEN status = 'updated' THEN removed ELSE false END AS removed
FROM x
"""


@register("feedback_replies", FOLD_REPLIES_SQL)
def feedback_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2 + F4: one reply per like / dislike event, folded in time order
    (removal above 5 dislikes; emptied lists answer no_crossref)."""
    _, replies = fbk.fold(dv.crossref_from_events(spark, sf_dir), dv.match_feedback(spark, sf_dir))
    return replies


FOLD_TABLE_SQL = f"""WITH {FOLD_CTES},
nt AS (
  SELECT xr.item_number, xr.pos AS old_pos, xr.r, st.l, st.d
  FROM xr LEFT JOIN st ON st.source_item = xr.item_number AND st.pos = xr.pos
  WHERE NOT coalesce(st.removed, false)
)
SELECT item_number, CAST(row_number() OVER (PARTITION BY item_number ORDER BY old_pos) - 1 AS INTEGER) AS pos,
       r, CAST(l AS INTEGER) AS likes, CAST(d AS INTEGER) AS dislikes
FROM nt
"""


@register("feedback_table_after", FOLD_TABLE_SQL)
def feedback_table_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + F2: the cross-reference table after all feedback (touched entries
    carry counts, removed entries are gone)."""
    new, _ = fbk.fold(dv.crossref_from_events(spark, sf_dir), dv.match_feedback(spark, sf_dir))
    return new.select("item_number", F.posexplode("matches").alias("pos", "m")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"),
        F.col("m.l").alias("likes"), F.col("m.d").alias("dislikes"))


FEEDBACK_COUNTS_SQL = f"""WITH {FOLD_CTES},
pairs AS (SELECT DISTINCT source_item, matched_item FROM fb),
nt AS (
  SELECT xr.item_number AS source_item, xr.pos, CASE WHEN instr(xr.r, '|') > 0 THEN split_part(xr.r, '|', 1) END
           AS matched_item, coalesce(st.l, 0) AS l, coalesce(st.d, 0) AS d
  FROM xr LEFT JOIN st ON st.source_item = xr.item_number AND st.pos = xr.pos
  WHERE NOT coalesce(st.removed, false)
),
first AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_item, matched_item ORDER BY pos) AS rn FROM nt) WHERE rn = 1
)
SELECT p.source_item, p.matched_item, f.source_item IS NOT NULL AS success,
       CAST(coalesce(f.l, 0) AS INTEGER) AS likes, CAST(coalesce(f.d, 0) AS INTEGER) AS dislikes
FROM pairs p LEFT JOIN first f USING (source_item, matched_item)
"""


@register("feedback_read_counts", FEEDBACK_COUNTS_SQL)
def feedback_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts of every (source, item) pair that got feedback, read from
    the table after the fold."""
    new, _ = fbk.fold(dv.crossref_from_events(spark, sf_dir), dv.match_feedback(spark, sf_dir))
    pairs = dv.match_feedback(spark, sf_dir)
    return fbk.read_counts(new, pairs)


# --------------------------------------------------------------------------- lifecycle A: substitutes

from altfinder.operators import matching as mt  # noqa: E402
from altfinder.plans import substitutes as sb  # noqa: E402


def substitutes(spark: SparkSession, sf_dir: str, top_k: int = 20):
    # the catalogue is derived from three tables; written once, it is read by
    # both search legs, the size checks and the enrichment
    raw = materialize(inventory(spark, sf_dir))
    return sb.find_substitutes(raw, raw.select("item_number"), top_k=top_k, dim=HYBRID_DIM, run_ts=RUN_TS)


@register("substitutes_inventory")
def substitutes_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: top 20 substitutes for every catalogue item -- hybrid
    candidates, rule scores, cut at 50, ranked, enriched."""
    res = substitutes(spark, sf_dir).results
    return res.select("source_item", F.col("match_rank").cast("int").alias("match_rank"), "item_number",
                      "match_score", F.array_join("varying_attributes", ",").alias("varying_attributes"),
                      F.col("id").alias("matched_id"), "from_cache")


@register("substitutes_source_counts")
def substitutes_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: per source keyword / vector / merged candidate counts and matches."""
    return substitutes(spark, sf_dir).counts


@register("substitutes_crossref_lists")
def substitutes_crossref_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + C1: the compact lists written to the cross-reference table."""
    t = substitutes(spark, sf_dir).crossref
    return t.select("item_number", F.posexplode("matches").alias("pos", "m")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"))


FLAGSHIP = "substitutes_inventory"


# --------------------------------------------------------------------------- P1-P5, P9, V1, V6

@register("clean_catalog_rows", f"""WITH {CLEAN_INV_SQL}
SELECT id, {', '.join(TEXT_FIELDS)} FROM docs""")
def clean_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2: cleaned catalogue rows (id kept, all-null rows dropped)."""
    return clean_inventory(spark, sf_dir).select("id", *TEXT_FIELDS)


@register("clean_outcome_counts", f"""WITH {CLEAN_INV_SQL},
r AS (
  SELECT CASE WHEN id IS NULL THEN 'missing_id'
              WHEN coalesce({', '.join(TEXT_FIELDS)}) IS NULL THEN 'all_fields_null' ELSE 'valid' END AS outcome
  FROM (SELECT id, {', '.join(f'{clean_sql(f)} AS {f}' for f in TEXT_FIELDS)} FROM inv)
)
SELECT outcome, count(*) AS n_rows FROM r GROUP BY outcome""")
def clean_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + B5: rows kept and skipped, by reason."""
    return cl.transform_counts(inventory(spark, sf_dir))


_COMPLETENESS_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count({clean_sql(f)}) AS non_null, count(*) AS total FROM inv" for f in TEXT_FIELDS)


@register("field_completeness", f"""WITH inv AS ({INVENTORY_SQL}), s AS ({_COMPLETENESS_ROWS})
SELECT field, non_null, total - non_null AS null_count,
       CASE WHEN total > 0 THEN round(non_null * 100.0 / total, 4) ELSE 0.0 END AS completeness,
       total AS total_records
FROM s""")
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field non-null, null and completeness percent."""
    return cl.field_completeness(inventory(spark, sf_dir))


@register("combined_text_catalog", f"""WITH inv AS ({INVENTORY_SQL}),
t AS (SELECT id, {combine_sql(TEXT_FIELDS)} AS text_combined FROM inv)
SELECT id, text_combined, CAST(length(text_combined) AS INTEGER) AS text_length,
       CASE WHEN text_combined = '' THEN 'no_text' END AS reject_reason
FROM t""")
def combined_text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + P9 + V6: combined text per row, its length, and the failure
    reason for rows without any text."""
    t = cl.with_combined_text(inventory(spark, sf_dir))
    return t.select("id", "text_combined", F.length("text_combined").cast("int").alias("text_length"),
                    "reject_reason")


@register("embedding_bookkeeping", f"""WITH inv AS ({INVENTORY_SQL}),
vdoc AS (SELECT id, {combine_sql(TEXT_FIELDS)} AS t FROM inv),
vterm AS (SELECT id, unnest({std_terms_sql('t')}) AS term FROM vdoc WHERE t <> ''),
vb AS (SELECT DISTINCT id, (('0x' || substr(md5(term), 1, 8))::BIGINT) % {HYBRID_DIM} AS b FROM vterm)
SELECT vdoc.id, CAST({HYBRID_DIM} AS INTEGER) AS embedding_dimension, CAST(length(vdoc.t) AS INTEGER) AS text_length,
       count(vb.b) AS nonzero
FROM vdoc JOIN vb USING (id) GROUP BY vdoc.id, vdoc.t""")
def embedding_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 + V5 + V6: lexical embedding of every catalogue row with text:
    dimension, text length and number of non-zero components."""
    raw = inventory(spark, sf_dir).withColumn("text_combined", tx.combine_fields(TEXT_FIELDS))
    e = vx.embed(raw, dim=HYBRID_DIM)
    e = vx.valid_vectors(e.where(F.col("reject_reason").isNull()).drop("reject_reason"), HYBRID_DIM)
    return vx.bookkeeping(e).select("id", "embedding_dimension", "text_length",
                                    F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"))


# --------------------------------------------------------------------------- S2, S3

@register("catalog_profile", """SELECT CAST(column_index AS INTEGER) AS position, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
                 WHEN 'DOUBLE' THEN 'double' ELSE lower(data_type) END AS data_type,
  (SELECT count(*) FROM part) AS row_count
FROM duckdb_columns() WHERE table_name = 'part'""")
def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: columns, types and row count of a source table."""
    from altfinder.sources.catalog import profile
    return profile(read_table(spark, sf_dir, "part"))


# --------------------------------------------------------------------------- I1-I5 over documents

from altfinder.operators import ingest as ing  # noqa: E402


def _first_run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress after a first run that embedded the English and French
    documents (completed when the text has words, failed otherwise) and
    skipped the others."""
    docs = read_table(spark, sf_dir, "documents")
    ok = F.col("lang").isin("en", "fr") & (F.size(tx.standard_terms(F.col("text"))) > 0)
    rows = docs.select(F.col("doc_id").alias("product_id"),
                       F.when(~F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False)), F.lit("skipped"))
                       .when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
                       F.when(ok, F.lit(EMB_DIM)).alias("embedding_dimension"),
                       F.length("text").alias("text_length"))
    empty = spark.createDataFrame([], ing.PROGRESS_SCHEMA)
    return ing.record(empty, rows, RUN_TS)


_PROGRESS_SQL = f"""prog AS (
  SELECT doc_id AS product_id,
         CASE WHEN NOT coalesce(lang IN ('en', 'fr'), false) THEN 'skipped'
              WHEN len({std_terms_sql('text')}) > 0 THEN 'completed' ELSE 'failed' END AS status
  FROM documents
)"""


@register("progress_stats", f"""WITH {_PROGRESS_SQL}
SELECT count(*) AS total_processed, count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
       max(product_id) FILTER (WHERE status = 'completed') AS last_processed_id
FROM prog""")
def progress_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I3 + I4: counts by status and the high-water mark."""
    return ing.progress_stats(_first_run_progress(spark, sf_dir))


@register("progress_is_processed", f"""WITH {_PROGRESS_SQL}
SELECT d.doc_id AS product_id, coalesce(p.status = 'completed', false) AS processed
FROM documents d LEFT JOIN prog p ON p.product_id = d.doc_id""")
def progress_is_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed flag for every document id."""
    ids = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"))
    return ing.is_processed(_first_run_progress(spark, sf_dir), ids)


@register("resume_pending", f"""WITH {_PROGRESS_SQL}
SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT product_id FROM prog WHERE status = 'completed')""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 (default): documents still to embed -- every row not completed."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return ing.pending(docs, _first_run_progress(spark, sf_dir), mode="anti")


@register("resume_next_batch", f"""WITH {_PROGRESS_SQL}
SELECT doc_id AS id, lang FROM documents
WHERE doc_id > (SELECT coalesce(max(product_id), -1) FROM prog WHERE status = 'completed')
ORDER BY doc_id LIMIT 100""")
def resume_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 (reference mode) + S2: the next batch of 100 rows above the
    high-water mark, in id order (a key-range scan; the limit is the batch)."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return ing.pending(docs, _first_run_progress(spark, sf_dir), mode="mark", limit=100)


# --------------------------------------------------------------------------- B1, R1-R5

from altfinder.operators import browse as br  # noqa: E402
from altfinder.operators import upload as upl  # noqa: E402


def _upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload built from the part table: most rows update stored items,
    some are new items (a few of them repeated), some have no item number,
    some no item number, name and brand, and some cells are blank."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    item = F.when(k % 60 == 11, F.lit("")).when(k % 50 == 7, F.lit("")) \
        .when(k % 40 == 3, F.concat(F.lit("NW"), (k % 31).cast("string"))) \
        .otherwise(F.concat(F.lit("IT"), F.lpad(k.cast("string"), 6, "0")))
    return upl.valid_rows(p.select(
        (k + 1).alias("ordinal"), item.alias("item_number"),
        F.when((F.col("p_size") > 40) | (k % 60 == 11), F.lit("")).otherwise(F.concat("p_name", F.lit(" v2"))).alias("item_name"),
        F.when(k % 60 == 11, F.lit("")).when(F.col("p_retailprice") < 950, F.lit("  ")).otherwise(F.col("p_brand")).alias("brand"),
        F.lit("").alias("catalog_number"),
        F.concat("p_type", F.lit(" rev")).alias("description")))


_UPLOAD_FIELDS_SQL = ["item_name", "brand", "catalog_number", "description"]
UPLOAD_CTES = f"""inv AS ({INVENTORY_SQL}),
up0 AS (
  SELECT p_partkey + 1 AS ordinal,
         CASE WHEN p_partkey % 60 = 11 OR p_partkey % 50 = 7 THEN ''
              WHEN p_partkey % 40 = 3 THEN concat('NW', CAST(p_partkey % 31 AS VARCHAR))
              ELSE concat('IT', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) END AS item_number,
         CASE WHEN p_size > 40 OR p_partkey % 60 = 11 THEN '' ELSE concat(p_name, ' v2') END AS item_name,
         CASE WHEN p_partkey % 60 = 11 THEN '' WHEN p_retailprice < 950 THEN '  ' ELSE p_brand END AS brand,
         '' AS catalog_number, concat(p_type, ' rev') AS description
  FROM part
),
up AS (
  SELECT ordinal, item_number, {', '.join(f'{clean_sql(f)} AS {f}' for f in _UPLOAD_FIELDS_SQL)}
  FROM up0 WHERE item_number <> '' OR item_name <> '' OR brand <> ''
),
stored AS (SELECT DISTINCT item_number FROM inv WHERE item_number IS NOT NULL),
agg AS (
  SELECT item_number, min(ordinal) AS first_ord,
         {', '.join(f'arg_max({f}, ordinal) FILTER (WHERE {f} IS NOT NULL) AS n_{f}' for f in _UPLOAD_FIELDS_SQL)}
  FROM up WHERE item_number <> '' GROUP BY item_number
)"""


@register("catalog_upsert_outcomes", f"""WITH {UPLOAD_CTES},
o AS (
  SELECT CASE WHEN item_number IN (SELECT item_number FROM stored)
                OR row_number() OVER (PARTITION BY item_number ORDER BY ordinal) > 1
              THEN 'updated' ELSE 'inserted' END AS outcome
  FROM up WHERE item_number IS NOT NULL AND item_number <> ''
  UNION ALL SELECT 'error' FROM up WHERE item_number = ''
)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def catalog_upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 + B5: inserted / updated / error counts of a bulk catalogue upload."""
    _, outcome, _ = upl.upsert_catalog(inventory(spark, sf_dir), _upload_rows(spark, sf_dir))
    return outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("catalog_after_upsert", f"""WITH {UPLOAD_CTES},
merged_old AS (
  SELECT i.id, i.item_number, {', '.join(f'coalesce(a.n_{f}, i.{f}) AS {f}' for f in _UPLOAD_FIELDS_SQL)},
         i.supplier, a.item_number IS NOT NULL AS changed
  FROM inv i LEFT JOIN agg a USING (item_number)
),
newi AS (
  SELECT a.*, row_number() OVER (ORDER BY first_ord) AS rk FROM agg a
  WHERE item_number NOT IN (SELECT item_number FROM stored)
),
ins AS (
  SELECT (SELECT coalesce(max(id), 0) FROM inv) + rk AS id, item_number,
         {', '.join(f'n_{f} AS {f}' for f in _UPLOAD_FIELDS_SQL)}, CAST(NULL AS VARCHAR) AS supplier, true AS changed
  FROM newi
)
SELECT * FROM merged_old UNION ALL SELECT * FROM ins""")
def catalog_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 + B2: the catalogue after the upload; ``changed`` marks rows to
    re-embed and re-index."""
    cat, _, changed = upl.upsert_catalog(inventory(spark, sf_dir), _upload_rows(spark, sf_dir))
    ch = changed.withColumn("changed", F.lit(True))
    return (cat.join(ch, "id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
            .select("id", "item_number", *_UPLOAD_FIELDS_SQL, "supplier", "changed"))


@register("catalog_page_rows", f"""WITH {CLEAN_INV_SQL}
SELECT * FROM docs ORDER BY id LIMIT 50 OFFSET 100""")
def catalog_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 (50 rows per page) of the cleaned catalogue by id."""
    rows, _ = br.page(clean_inventory(spark, sf_dir), 3, 50)
    return rows


@register("catalog_page_meta", f"""WITH {CLEAN_INV_SQL}
SELECT count(*) AS total, 3 AS page, 50 AS page_size, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages,
       3 < CAST(ceil(count(*) / 50.0) AS BIGINT) AS has_next, true AS has_previous
FROM docs""")
def catalog_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging facts for page 3."""
    _, meta = br.page(clean_inventory(spark, sf_dir), 3, 50)
    return meta


@register("catalog_sorted_by_name", f"""WITH {CLEAN_INV_SQL}
SELECT id, item_name, coalesce(nullif(brand, ''), nullif(supplier, ''), 'N/A') AS vendor,
       row_number() OVER (ORDER BY lower(coalesce(item_name, '')) DESC, id) - 1 AS row_index
FROM docs""")
def catalog_sorted_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + R5: the whole cleaned catalogue by name (descending, case-blind,
    null as empty, ties by id) with its vendor label and position."""
    ranked = br.rank_rows(br.vendor_label(clean_inventory(spark, sf_dir)), "name_desc")
    return ranked.select("id", "item_name", "vendor", "row_index")


@register("catalog_brand_filter", f"""WITH {CLEAN_INV_SQL}
SELECT id, item_number, brand FROM docs WHERE brand = 'Brand#1'""")
def catalog_brand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact brand filter."""
    return br.brand_filter(clean_inventory(spark, sf_dir), "Brand#1").select("id", "item_number", "brand")


@register("catalog_brands", f"""WITH {CLEAN_INV_SQL}
SELECT DISTINCT brand FROM docs WHERE brand IS NOT NULL AND trim(brand) <> ''""")
def catalog_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct non-blank brands."""
    return br.brands(clean_inventory(spark, sf_dir))


# --------------------------------------------------------------------------- M5-M7, M9, M13, S8

from altfinder.functions import bands as bd  # noqa: E402
from altfinder.functions import compact as cp  # noqa: E402


@register("crossref_entries_parsed", f"""WITH {dv.CROSSREF_ENTRIES_SQL},
pe AS {parsed_entries_sql('xr', 50)}
SELECT item_number, CAST(pos AS INTEGER) AS pos, item, score, array_to_string(attrs, ',') AS attrs FROM pe""")
def crossref_entries_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + S8: every stored entry parsed (bad score 50), via the JSON form
    of the match column (written and read back)."""
    t = dv.crossref_from_events(spark, sf_dir)
    t = t.withColumn("matches", cp.matches_from_json(cp.matches_to_json(F.col("matches"))))
    e = xr.explode_matches(t).where("ok")
    return e.select("item_number", F.col("pos").cast("int").alias("pos"), "item", "score",
                    F.array_join("attrs", ",").alias("attrs"))


@register("match_replies_roundtrip", f"""WITH {dv.CROSSREF_ENTRIES_SQL},
pe AS {parsed_entries_sql('xr', 50)}
SELECT item_number AS query_id, CAST(row_number() OVER (PARTITION BY item_number ORDER BY pos) - 1 AS INTEGER) AS pos,
       concat_ws('|', item, CAST(score AS VARCHAR), array_to_string(attrs, ',')) AS r
FROM pe""")
def match_replies_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 + M6 + M7: each stored list rendered as a fenced JSON model reply,
    parsed back (fence stripped, JSON read, compact strings split) and
    written again in compact form."""
    t = dv.crossref_from_events(spark, sf_dir)
    replies = t.select(F.col("item_number").alias("query_id"), F.lit(0).alias("batch"),
                       F.concat(F.lit("```json\n"), F.to_json(F.transform("matches", lambda m: F.struct(m["r"].alias("r")))),
                                F.lit("\n```")).alias("reply"))
    parsed = mt.parse_replies(replies)
    w = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1
    return parsed.select("query_id", w.cast("int").alias("pos"),
                         cp.write_compact(F.col("item_number"), F.col("match_score"),
                                          F.col("varying_attributes")).alias("r"))


@register("match_bands", f"""WITH {dv.CROSSREF_ENTRIES_SQL},
pe AS {parsed_entries_sql('xr', 50)}
SELECT item_number, CAST(pos AS INTEGER) AS pos, score,
       CASE WHEN score >= 100 THEN '100' WHEN score >= 90 THEN '90-99' WHEN score >= 80 THEN '80-89'
            WHEN score >= 70 THEN '70-79' WHEN score >= 60 THEN '60-69' WHEN score >= 50 THEN '50-59' END AS band,
       {bd.band_sql('score', 'table')} AS table_band,
       {bd.band_sql('score', 'best_alternative')} AS alt_band,
       {bd.band_sql('score', 'vendor_list')} AS vendor_band,
       {bd.band_sql('score', 'upload')} AS upload_band
FROM pe""")
def match_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 + M13: scoring band (null below the cut) and the four display
    bands of every stored entry."""
    e = xr.explode_matches(dv.crossref_from_events(spark, sf_dir)).where("ok")
    s = F.col("score")
    return e.select("item_number", F.col("pos").cast("int").alias("pos"), "score",
                    bd.match_band(s).alias("band"), bd.display_band(s, "table").alias("table_band"),
                    bd.display_band(s, "best_alternative").alias("alt_band"),
                    bd.display_band(s, "vendor_list").alias("vendor_band"),
                    bd.display_band(s, "upload").alias("upload_band"))


# --------------------------------------------------------------------------- F5 (stream = batch fold)

from altfinder.streaming import feedback_state as fstate  # noqa: E402
from altfinder.streaming import feedback_stream as fstream  # noqa: E402


@register("feedback_stream_table", FOLD_TABLE_SQL)
def feedback_stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same fold as ``feedback_table_after``, run as a Structured
    Streaming job over the files of the event log (availableNow, checkpointed,
    state table replaced per micro-batch)."""
    xref = dv.crossref_from_events(spark, sf_dir)
    base = scratch(spark, "feedback-stream")
    events = dv.feedback_of(read_stream(spark, sf_dir, "events"))
    fstream.start(events, xref, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    new = fstream.table(spark, xref, f"{base}/state")
    return new.select("item_number", F.posexplode("matches").alias("pos", "m")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"),
        F.col("m.l").alias("likes"), F.col("m.d").alias("dislikes"))


@register("feedback_state_table", FOLD_TABLE_SQL)
def feedback_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same fold with keyed state in the state store."""
    xref = dv.crossref_from_events(spark, sf_dir)
    base = scratch(spark, "feedback-state")
    events = dv.feedback_of(read_stream(spark, sf_dir, "events"))
    fstate.start(events, xref, f"{base}/state", f"{base}/checkpoint").awaitTermination()
    new = fstate.table(spark, xref, f"{base}/state")
    return new.select("item_number", F.posexplode("matches").alias("pos", "m")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"),
        F.col("m.l").alias("likes"), F.col("m.d").alias("dislikes"))


# --------------------------------------------------------------------------- I5-I7 as a stream

from altfinder.streaming import ingest_stream as istream  # noqa: E402


@register("ingest_stream_progress", f"""SELECT doc_id AS product_id,
  CASE WHEN len({std_terms_sql('text')}) > 0 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN len({std_terms_sql('text')}) > 0 THEN {EMB_DIM} END AS embedding_dimension,
  CAST(length({combine_sql(['text'])}) AS INTEGER) AS text_length
FROM documents""")
def ingest_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I5 + I6: every document embedded by the streaming ingest over the
    files of the documents table; the progress table it leaves."""
    base = scratch(spark, "ingest-stream")
    docs = read_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    istream.start(docs, f"{base}/outcomes", f"{base}/checkpoint", EMB_DIM, RUN_TS, ["text"]).awaitTermination()
    return ing.progress(spark, f"{base}/outcomes").select("product_id", "status", "embedding_dimension", "text_length")


# --------------------------------------------------------------------------- B2-B4: match every uploaded row

from altfinder.plans import upload_job as uj  # noqa: E402


def _part_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload file: every row of ``part``, as a supplier would send it;
    some rows repeat the item before them, are new, or have no item number."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    item = F.when(k % 50 == 7, F.lit("")).when(k % 40 == 3, F.concat(F.lit("NW"), (k % 31).cast("string"))) \
        .otherwise(F.concat(F.lit("IT"), F.lpad((k - F.when(k % 30 == 4, 1).otherwise(0)).cast("string"), 6, "0")))
    return upl.valid_rows(p.select(
        (F.col("p_partkey") + 1).alias("ordinal"), item.alias("item_number"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" in.")).alias("item_name"),
        F.col("p_brand").alias("brand"), F.lit("").alias("catalog_number"),
        F.concat("p_type", F.lit(" "), "p_name").alias("description")))


@register("upload_matches")
def upload_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert the upload, re-embed what changed, match every
    uploaded row (top 10, keyword + vector candidates, rule scores)."""
    job = uj.run(inventory(spark, sf_dir), _part_upload(spark, sf_dir), top_k=10, dim=HYBRID_DIM, run_ts=RUN_TS)
    return job.results.select("source_item", F.col("match_rank").cast("int").alias("match_rank"), "item_number",
                              "match_score", F.array_join("varying_attributes", ",").alias("varying_attributes"))


@register("upload_summary")
def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total rows, rows with matches, not in the catalogue, errors, and
    the matches that the user removed (the second of some items)."""
    upload = _part_upload(spark, sf_dir)
    removed = upload.where("item_number <> '' and ordinal % 10 = 3").select(
        F.col("item_number").alias("source_item"), F.lit(1).alias("match_idx"))
    job = uj.run(inventory(spark, sf_dir), upload, top_k=10, dim=HYBRID_DIM, run_ts=RUN_TS, exclusions=removed)
    return job.summary


@register("upload_row_results")
def upload_row_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 + B5: one result per uploaded row when the upload is only matched
    against the catalogue as it is, so new items are not found."""
    job = uj.run(inventory(spark, sf_dir), _part_upload(spark, sf_dir), top_k=10, dim=HYBRID_DIM, run_ts=RUN_TS,
                 insert=False)
    return job.rows


# --------------------------------------------------------------------------- oracle for lifecycle A

from altfinder.functions import attributes as atr  # noqa: E402


def _num_sql(e: str) -> str:
    return (f"CASE WHEN regexp_matches({e}, '^[0-9]+/[0-9]+$') AND TRY_CAST(split_part({e}, '/', 2) AS DOUBLE) <> 0 "
            f"THEN TRY_CAST(split_part({e}, '/', 1) AS DOUBLE) / TRY_CAST(split_part({e}, '/', 2) AS DOUBLE) "
            f"ELSE TRY_CAST({e} AS DOUBLE) END")


def _attrs_sql(name: str, p: str) -> str:
    """Columns ``{p}size, {p}type, ...`` of the M8 attribute extraction."""
    n = f"lower({name})"
    nz = lambda e: f"nullif({e}, '')"
    size = (f"regexp_extract({n}, '([0-9]+(?:[./-][0-9]+)*(?:\\s*x\\s*[0-9]+(?:[./][0-9]+)*)*)\\s*(?:in\\b|inch|\")', 1)")
    volt = f"regexp_extract({n}, '\\b([0-9]{{2,3}})(?:/[0-9]{{2,3}})?\\s*v(?:ac|dc|olt)?\\b', 1)"
    vclass = "CASE " + " ".join(
        f"WHEN {volt} IN ({', '.join(repr(m) for m in ms)}) THEN '{c}'" for c, ms in atr.VOLTAGE_CLASSES.items()
    ) + f" ELSE {volt} END"
    grp = "CASE " + " ".join(
        f"WHEN regexp_matches({n}, '\\b({'|'.join(ws)})s?\\b') THEN '{g}'" for g, ws in atr.GROUP_WORDS.items()
    ) + " ELSE 'general' END"
    stop = "['inch', 'with', 'for', 'and', 'the', 'kit']"
    nouns = f"list_filter(regexp_extract_all({n}, '[a-z]{{3,}}'), lambda w: NOT list_contains({stop}, w))"
    mats = "|".join(atr.MATERIALS)
    return ", ".join([
        f"{nz(f'regexp_replace({size}, ' + chr(39) + '\\s+' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS {p}size",
        f"CASE WHEN len({nouns}) > 0 THEN {nouns}[-1] END AS {p}type",
        f"{grp} AS {p}grp",
        f"{nz(vclass)} AS {p}voltage",
        f"{_num_sql(nz(f'regexp_extract({n}, ' + chr(39) + '([0-9]+)\\s*cfm\\b' + chr(39) + ', 1)'))} AS {p}cfm",
        f"{_num_sql(nz(f'regexp_extract({n}, ' + chr(39) + '([0-9]+/[0-9]+|[0-9]*\\.?[0-9]+)\\s*hp\\b' + chr(39) + ', 1)'))} AS {p}hp",
        f"{_num_sql(nz(f'regexp_extract({n}, ' + chr(39) + '([0-9]*\\.?[0-9]+)\\s*(?:a|amps?)\\b' + chr(39) + ', 1)'))} AS {p}amps",
        f"{_num_sql(nz(f'regexp_extract({n}, ' + chr(39) + '([0-9]*\\.?[0-9]+)\\s*gpm\\b' + chr(39) + ', 1)'))} AS {p}gpm",
        f"{nz(f'regexp_extract({n}, ' + chr(39) + '\\b(npt|bsp)\\b' + chr(39) + ', 1)')} AS {p}thread",
        f"{nz(f'regexp_extract({n}, ' + chr(39) + '\\b(' + mats + ')\\b' + chr(39) + ', 1)')} AS {p}material",
    ])


def _rules_sql() -> str:
    both = lambda f: f"(s_{f} IS NOT NULL AND c_{f} IS NOT NULL)"
    differ = lambda f: f"({both(f)} AND s_{f} <> c_{f})"
    critical = " OR ".join([differ(f) for f in ["size", "type", "thread", "material", "voltage"]] + [
        f"(s_grp = 'electrical' AND {both('amps')} AND c_amps < s_amps)",
        f"(s_grp = 'pump' AND {both('hp')} AND c_hp < s_hp)"])
    varying = ("list_filter([" + ", ".join(
        [f"CASE WHEN {differ(f)} THEN '{f}' END" for f in ["cfm", "hp", "amps", "gpm"]]
        + [f"CASE WHEN (s_{f} IS NULL) <> (c_{f} IS NULL) THEN '{f}' END" for f in ["voltage", "material", "size"]])
        + "], lambda x: x IS NOT NULL)")
    score = (f"CASE WHEN src_item = item_number THEN {atr.SAME_PRODUCT} WHEN {critical} THEN {atr.EXCLUDED} "
             f"WHEN s_grp = 'fan' AND {both('cfm')} AND c_cfm < s_cfm THEN {atr.LOWER_RATING} "
             f"WHEN s_size IS NULL AND c_size IS NULL THEN {atr.UNVERIFIED_SIZE} "
             f"ELSE greatest({atr.FLOOR_SCORE}, {atr.BASE_SCORE} - {atr.PER_VARYING} * len({varying})) END")
    return (f"CASE WHEN src_name = lower(item_name) THEN {atr.SAME_PRODUCT} ELSE {score} END AS match_score, "
            f"CASE WHEN src_name = lower(item_name) THEN []::VARCHAR[] ELSE {varying} END AS varying_attributes")


def substitutes_ctes(top_k: int = 20, inv_cte: str = DEFAULT_INV_CTE, src_where: str = "true") -> str:
    return f"""{hybrid_ctes(top_k, HYBRID_DIM, inv_cte, src_where)},
srcs AS (SELECT id AS query_id, item_number AS src_item, lower(item_name) AS src_name, {_attrs_sql('item_name', 's_')}
         FROM inv WHERE {src_where}),
pairs AS (
  SELECT cand.query_id, cand.id, cand.position, cand.item_number, cand.item_name, srcs.* EXCLUDE (query_id),
         {_attrs_sql('cand.item_name', 'c_')}
  FROM cand JOIN srcs USING (query_id)
),
scored AS (SELECT query_id, id, position, item_number, src_item, {_rules_sql()} FROM pairs),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, position) AS INTEGER)
           AS match_rank
  FROM scored WHERE match_score >= 50
),
cat1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_number ORDER BY id DESC) AS rn FROM inv
                 WHERE item_number IS NOT NULL) WHERE rn = 1
)"""


SUBSTITUTES_CTES = substitutes_ctes()


SUBSTITUTES_SQL = f"""WITH {SUBSTITUTES_CTES}
SELECT r.src_item AS source_item, r.match_rank, r.item_number, r.match_score,
       array_to_string(r.varying_attributes, ',') AS varying_attributes, c.id AS matched_id, false AS from_cache
FROM ranked r JOIN cat1 c ON c.item_number = r.item_number
WHERE r.match_rank <= 20
"""

SUBSTITUTE_LISTS_SQL = f"""WITH {SUBSTITUTES_CTES}
SELECT src_item AS item_number, match_rank - 1 AS pos,
       concat_ws('|', item_number, CAST(match_score AS VARCHAR), array_to_string(varying_attributes, ',')) AS r
FROM ranked
"""

SUBSTITUTE_COUNTS_SQL = f"""WITH {SUBSTITUTES_CTES},
res AS (
  SELECT r.src_item FROM ranked r JOIN cat1 c ON c.item_number = r.item_number WHERE r.match_rank <= 20
),
cc AS (
  SELECT query_id, count(*) FILTER (WHERE in_keyword) AS keyword_results,
         count(*) FILTER (WHERE in_vector) AS vector_results, count(*) AS combined_unique
  FROM cand GROUP BY query_id
),
mc AS (SELECT src_item AS item_number, count(*) AS matched FROM res GROUP BY 1)
SELECT i.item_number, i.id AS query_id, true AS found,
       coalesce(cc.keyword_results, 0) AS keyword_results, coalesce(cc.vector_results, 0) AS vector_results,
       coalesce(cc.combined_unique, 0) AS combined_unique, coalesce(mc.matched, 0) AS matched
FROM inv i LEFT JOIN cc ON cc.query_id = i.id LEFT JOIN mc ON mc.item_number = i.item_number
"""

ORACLE["substitutes_inventory"] = SUBSTITUTES_SQL
ORACLE["substitutes_crossref_lists"] = SUBSTITUTE_LISTS_SQL
ORACLE["substitutes_source_counts"] = SUBSTITUTE_COUNTS_SQL


# --------------------------------------------------------------------------- oracle for the upload flow

_PART_UPLOAD_SQL = """SELECT p_partkey + 1 AS ordinal,
         CASE WHEN p_partkey % 50 = 7 THEN '' WHEN p_partkey % 40 = 3 THEN concat('NW', CAST(p_partkey % 31 AS VARCHAR))
              ELSE concat('IT', lpad(CAST(p_partkey - CASE WHEN p_partkey % 30 = 4 THEN 1 ELSE 0 END AS VARCHAR), 6, '0'))
         END AS item_number,
         concat(p_name, ' ', CAST(p_size AS VARCHAR), ' in.') AS item_name, p_brand AS brand,
         '' AS catalog_number, concat(p_type, ' ', p_name) AS description
  FROM part"""

UPLOADED_INV_CTE = f"""inv0 AS ({INVENTORY_SQL}),
up0 AS ({_PART_UPLOAD_SQL}),
up AS (
  SELECT ordinal, item_number, {', '.join(f'{clean_sql(f)} AS {f}' for f in _UPLOAD_FIELDS_SQL)}
  FROM up0 WHERE item_number <> '' OR item_name <> '' OR brand <> ''
),
stored0 AS (SELECT DISTINCT item_number FROM inv0 WHERE item_number IS NOT NULL),
agg0 AS (
  SELECT item_number, min(ordinal) AS first_ord,
         {', '.join(f'arg_max({f}, ordinal) FILTER (WHERE {f} IS NOT NULL) AS n_{f}' for f in _UPLOAD_FIELDS_SQL)}
  FROM up WHERE item_number IS NOT NULL AND item_number <> '' GROUP BY item_number
),
newi0 AS (
  SELECT a.*, row_number() OVER (ORDER BY first_ord) AS rk FROM agg0 a
  WHERE item_number NOT IN (SELECT item_number FROM stored0)
),
inv AS (
  SELECT i.id, i.item_number, {', '.join(f'coalesce(a.n_{f}, i.{f}) AS {f}' for f in _UPLOAD_FIELDS_SQL)}, i.supplier
  FROM inv0 i LEFT JOIN agg0 a USING (item_number)
  UNION ALL
  SELECT (SELECT coalesce(max(id), 0) FROM inv0) + rk, item_number, {', '.join(f'n_{f}' for f in _UPLOAD_FIELDS_SQL)},
         CAST(NULL AS VARCHAR)
  FROM newi0
)"""
UPLOAD_SRC_WHERE = "item_number IN (SELECT item_number FROM up WHERE item_number IS NOT NULL AND item_number <> '')"
UPLOAD_SUBST_CTES = substitutes_ctes(10, UPLOADED_INV_CTE, UPLOAD_SRC_WHERE)

ORACLE["upload_matches"] = f"""WITH {UPLOAD_SUBST_CTES}
SELECT r.src_item AS source_item, r.match_rank, r.item_number, r.match_score,
       array_to_string(r.varying_attributes, ',') AS varying_attributes
FROM ranked r JOIN cat1 c ON c.item_number = r.item_number
WHERE r.match_rank <= 10
"""

ORACLE["upload_summary"] = f"""WITH {UPLOAD_SUBST_CTES},
res AS (
  SELECT DISTINCT r.src_item FROM ranked r JOIN cat1 c ON c.item_number = r.item_number WHERE r.match_rank <= 10
),
gone AS (
  SELECT count(*) AS n FROM ranked r JOIN cat1 c ON c.item_number = r.item_number
  WHERE r.match_rank = 2 AND r.src_item IN (SELECT item_number FROM up WHERE ordinal % 10 = 3 AND item_number <> '')
)
SELECT count(*) AS total,
       count(*) FILTER (WHERE item_number IN (SELECT src_item FROM res)) AS with_matches,
       count(*) FILTER (WHERE item_number <> '' AND
                        item_number NOT IN (SELECT item_number FROM inv WHERE item_number IS NOT NULL))
         AS not_in_inventory,
       count(*) FILTER (WHERE item_number = '') AS errors, (SELECT n FROM gone) AS removed_matches
FROM up
"""

STORED_INV_CTE = f"""inv AS ({INVENTORY_SQL}),
up0 AS ({_PART_UPLOAD_SQL}),
up AS (SELECT * FROM up0 WHERE item_number <> '' OR item_name <> '' OR brand <> '')"""

ORACLE["upload_row_results"] = f"""WITH {substitutes_ctes(10, STORED_INV_CTE, UPLOAD_SRC_WHERE)},
res AS (
  SELECT r.src_item, count(*) AS n FROM ranked r JOIN cat1 c ON c.item_number = r.item_number
  WHERE r.match_rank <= 10 GROUP BY r.src_item
)
SELECT up.ordinal, up.item_number,
       CASE WHEN up.item_number = '' THEN 'error'
            WHEN up.item_number NOT IN (SELECT item_number FROM inv WHERE item_number IS NOT NULL) THEN 'not_found'
            WHEN res.n > 0 THEN 'matched' ELSE 'no_match' END AS status,
       coalesce(res.n, 0) AS n_matches, CASE WHEN up.item_number = '' THEN 'missing item number' END AS error
FROM up LEFT JOIN res ON res.src_item = up.item_number
"""


# --------------------------------------------------------------------------- K6, K7, H6 over the document search

def _doc_hits(spark: SparkSession, sf_dir: str):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = kw.search(kw.KeywordIndex.build(docs, ["text"]), queries, ["text"], k=10, fuzzy=False)
    return docs, queries, hits


@register("documents_by_id", """SELECT b.item_id AS id, d.doc_id IS NOT NULL AS found, d.n_chars
FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def documents_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: documents looked up by id (the benchmark item ids), found flag."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    ids = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).distinct()
    return kw.documents_by_id(docs, ids).select("id", "found", "n_chars")


_DOC_HITS_CTE = DOC_BM25_SQL.strip().replace(
    "\nSELECT query_id, rank, id, score, total_hits FROM r WHERE rank <= 10",
    ",\nhits AS (SELECT query_id, rank, id, score, total_hits FROM r WHERE rank <= 10)")


@register("keyword_exact_match_flag", f"""{_DOC_HITS_CTE}
SELECT h.query_id, h.id, h.score,
       coalesce(h.score > 20 OR lower(b.text) = lower(d.text), false) AS exact_match
FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id
WHERE h.rank = 1""")
def keyword_exact_match_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: exact-match flag of each query's rank-1 document (score above 20,
    or the query equals the text ignoring case)."""
    docs, queries, hits = _doc_hits(spark, sf_dir)
    d = docs.select("id", F.col("text").alias("item_name"), F.col("text").alias("description"))
    return kw.exact_match_flag(hits, queries, d)


@register("keyword_rerank_top5", f"""{_DOC_HITS_CTE},
rp AS (
  SELECT h.query_id, h.id, h.rank,
         list_distinct({std_terms_sql('b.text')}) AS qt, list_distinct({std_terms_sql('d.text')}) AS dt
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id
),
rs AS (
  SELECT query_id, id, rank,
         round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / len(qt) ELSE 0.0 END, 6) AS rerank_score
  FROM rp
),
rr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER)
           AS rerank_rank
  FROM rs
)
SELECT query_id, id, rerank_score, rerank_rank FROM rr WHERE rerank_rank <= 5""")
def keyword_rerank_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: the 10 BM25 hits of each passage re-scored by the default scorer
    (share of query terms in the document) and cut to 5; ties keep the
    original order."""
    docs, queries, hits = _doc_hits(spark, sf_dir)
    pairs = (hits.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
             .join(docs.select("id", F.col("text").alias("text_combined")), "id")
             .withColumnRenamed("rank", "position"))
    rr = hy.rerank(pairs, 5, order_col="position")
    return rr.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"),
                     F.col("rerank_rank").cast("int").alias("rerank_rank"))


# --------------------------------------------------------------------------- M2, M3 request texts

@register("match_requests_inventory", f"""WITH {hybrid_ctes()},
lines AS (
  SELECT c.query_id, CAST(floor((c.position - 1) / 50) AS INTEGER) AS batch, c.position,
         coalesce(c.item_number, '(none)') || ': ' || coalesce(c.item_name, '(none)') AS line
  FROM cand c
),
per_batch AS (
  SELECT query_id, batch, string_agg(line, chr(10) ORDER BY position) AS candidates_text FROM lines
  GROUP BY query_id, batch
)
SELECT pb.query_id, pb.batch,
       'SOURCE ITEM ' || coalesce(i.item_number, '(none)') || chr(10) ||
       'name: ' || coalesce(i.item_name, '(none)') || chr(10) ||
       'searched as: ' || coalesce(i.item_name, '') || chr(10) || chr(10) ||
       'CANDIDATES' || chr(10) || pb.candidates_text || chr(10) || chr(10) ||
       'REPLY' || chr(10) ||
       'A JSON array with one object {{"r": "ITEM|SCORE|ATTRIBUTES"}} per candidate that can ' ||
       'replace the source; SCORE is 0 to 100, ATTRIBUTES lists what differs, parted by commas.' AS request
FROM per_batch pb JOIN inv i ON i.id = pb.query_id""")
def match_requests_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M3: the scoring request text of every (source, batch of 50
    candidates) -- what a model hook (M4) receives."""
    cands, sources, _ = hybrid_candidates(spark, sf_dir)
    src = sources.withColumn("llm_query", F.coalesce("item_name", F.lit("")))
    return mt.request_text(mt.with_batches(cands), src).select("query_id", "batch", "request")


# --------------------------------------------------------------------------- R6, R7 over the substitutes flow

@register("catalog_best_alternative", f"""WITH {SUBSTITUTES_CTES},
alt_lists AS (SELECT src_item AS item_number, match_rank - 1 AS pos, item_number AS alt, match_score FROM ranked),
best_alt AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY item_number ORDER BY match_score DESC, pos) AS rn
    FROM alt_lists WHERE alt <> item_number) WHERE rn = 1
)
SELECT i.id, i.item_number, b.alt AS alt_item_number, b.match_score
FROM inv i LEFT JOIN best_alt b USING (item_number)""")
def catalog_best_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 (+ C4 over the stored lists): every catalogue row with the best
    stored alternative that is not the item itself."""
    res = substitutes(spark, sf_dir)
    raw = inventory(spark, sf_dir)
    out = br.with_best_alternative(raw, res.crossref)
    return out.select("id", "item_number", "alt_item_number", "match_score")


@register("substitutes_without_source", f"""WITH {SUBSTITUTES_CTES}
SELECT r.src_item AS source_item, r.match_rank, r.item_number, r.match_score
FROM ranked r JOIN cat1 c ON c.item_number = r.item_number
WHERE r.match_rank <= 20 AND r.item_number <> r.src_item""")
def substitutes_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live substitute results without the source item itself."""
    res = substitutes(spark, sf_dir).results
    return br.without_source(res).select("source_item", F.col("match_rank").cast("int").alias("match_rank"),
                                         "item_number", "match_score")


# --------------------------------------------------------------------------- H7 (optional fusion)

@register("hybrid_rrf_fusion", f"""WITH {hybrid_ctes()},
fz AS (
  SELECT query_id, id, coalesce(1.0 / (60 + kw_rank), 0.0) + coalesce(1.0 / (60 + vec_rank), 0.0) AS f FROM m
  UNION ALL
  SELECT query_id, id, 1.0 / (60 + kw_rank) FROM kh
  WHERE query_id NOT IN (SELECT query_id FROM withvec) AND kw_rank <= {HYBRID_TOP_K}
)
SELECT query_id, id, round(f, 9) AS fused_score FROM fz""")
def hybrid_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: reciprocal rank fusion (k = 60) of the two candidate legs; the
    reference declares fusion weights but never applies them, so this is an
    option next to the plain merge."""
    cands, _, _ = hybrid_candidates(spark, sf_dir)
    return hy.fuse_rrf(cands).select("query_id", "id", F.round("fused_score", 9).alias("fused_score"))


# M8 on names that reach every rule: each part gives one (source, candidate)
# pair; the expected scores are stated per pair, not computed from the rules.
RULE_PAIRS = [
    ("{} in. Duct Fan 380 CFM", "{} in. Duct Fan 500 CFM White", 90, "cfm"),
    ("{} in. Exhaust Fan 500 CFM 115 V", "{} in. Exhaust Fan 380 CFM 120 V", 65, "cfm"),
    ("{} in. Duct Fan 380 CFM", "{}9 in. Duct Fan 380 CFM", 0, ""),
    ("{} in. Sweat x Male Copper Pipe Adapter", "{} in. Flanged Copper Pipe Adapter", 0, ""),
    ("{} in. Copper Pipe Elbow", "{} in. PVC Pipe Elbow", 0, ""),
    ("{} in. NPT Brass Ball Valve", "{} in. NPT Brass Gate Valve Red", 95, ""),
    ("{} in. NPT Steel Coupling", "{} in. BSP Steel Coupling", 0, ""),
    ("120 V {} Amp Breaker", "240 V {} Amp Breaker", 0, ""),
    ("120 V {} Amp Receptacle NEMA 5-15R", "115 V {} Amp Receptacle NEMA 5-20R", 0, ""),
    ("120 V {} Amp Twist-Lock Receptacle", "110 V 9{} Amp Twist Lock Receptacle", 60, "amps"),
    ("{} in. 1/2 HP 115 V Booster Pump", "{} in. 1/2 HP 115 V Centrifugal Pump", 0, ""),
    ("{} in. 1/2 HP 115 V Sump Pump", "{} in. 3/4 HP 120 V Sump Pump", 90, "hp"),
    ("{} in. 3/4 HP 115 V Sump Pump", "{} in. 1/2 HP 115 V Sump Pump", 0, ""),
    ("{} in. Duct Fan", "{} in. Sump Pump", 0, ""),
    ("{} in. Duct Fan 300 CFM", "{} in. Booster Fan 300 CFM", 90, "type"),
    # names that lack the group's own words
    ("pump {} hp 115v", "{} hp pump 120 volt", 60, ""),
    ("{} in fan 500 cfm", "ventilator {} in", 95, ""),
    ("{} in fan 500 cfm", "{}-inch Exhaust Fan", 95, ""),
    ("cord {} ft", "cord 120 V", 60, "voltage"),
    ("{} in. valve", "valve", 90, "size"),
    # the same quantity in another notation
    ("1/2 in. x {} ft Copper Pipe", "0.5 inch Copper Pipe {} feet", 95, ""),
    ("1-1/2 in. PVC Elbow {} psi", "1.5 in PVC Elbow {} psi", 95, ""),
    ("1 1/2\" PVC Elbow", "38.1 mm PVC Elbow {} psi", 95, ""),
    ("{} x 4 in. Duct Fan", "4 in. x {} in. Duct Fan", 95, ""),
    ("{} x 4 in. Duct Fan", "{} x 5 in. Duct Fan", 0, ""),
    ("{} in. Duct Fan 1,200 CFM", "{} in. Duct Fan 900 CFM", 65, "cfm"),
    ("{} in. Duct Fan 900 cfm", "{} in. Duct Fan 1,200 cfm", 90, "cfm"),
    ("500 mA Relay 24 VDC {} in", "0.5 amp Relay 24V {} inch", 95, ""),
    ("Relay 24 VDC 750 mA {} in", "Relay 24 VDC 0.5 A {} in", 0, ""),
    ("115/230 V {} Amp Contactor", "208-240 V {} Amp Contactor", 60, ""),
    ("115/230 V {} Amp Contactor", "480 V {} Amp Contactor", 0, ""),
    # what may only rise
    ("{} in. Brass Valve 150 psi", "{} in. Brass Valve 300 psi", 90, "pressure"),
    ("{} in. Brass Valve 20 bar", "{} in. Brass Valve 150 psi", 65, "pressure"),
    ("120 V {} in. Transformer 1.5 kW", "120 V {} in. Transformer 1,800 watt", 90, "wattage"),
    ("120 V {} in. Transformer 1.5 kW", "120 V {} in. Transformer 1,000 W", 65, "wattage"),
    ("{} in. Sump Pump 20 GPM", "{} in. Sump Pump 600 gph", 65, "gpm"),
    ("{} in. x 10 ft PVC Pipe", "{} in. x 20 ft PVC Pipe", 90, "length"),
    ("1/100 HP 110 V Evaporator Fan Motor Kit {} in", "{} in. Evaporator Fan Motor 0.01 hp 115V", 95, ""),
    ("", "{} in. Duct Fan", 90, "size"),
]

RULE_PAIRS_SQL = ("SELECT p_partkey, " + "CASE p_partkey % {n} ".format(n=len(RULE_PAIRS))
                  + " ".join(f"WHEN {i} THEN {score}" for i, (_, _, score, _) in enumerate(RULE_PAIRS)) + " END AS match_score, "
                  + f"CASE p_partkey % {len(RULE_PAIRS)} "
                  + " ".join(f"WHEN {i} THEN '{varying}'" for i, (*_, varying) in enumerate(RULE_PAIRS)) + " END AS varying FROM part")


@register("rule_scores_by_group", RULE_PAIRS_SQL)
def rule_scores_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: fans, pipes, electrical parts and pumps named after every part."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    k = F.pmod(F.col("p_partkey"), F.lit(len(RULE_PAIRS)))
    forms = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, *_ in RULE_PAIRS])
    named = parts.withColumn("form", F.get(forms, k.cast("int")))
    named = named.select("p_partkey", *[atr.extract(F.replace(F.col(f"form.{c}"), F.lit("{}"), F.col("size"))).alias(c) for c in "ab"])
    scored = named.withColumn("r", atr.rule_score(F.col("a"), F.col("b"), F.lit("source"), F.lit("candidate")))
    return scored.select("p_partkey", F.col("r.score").alias("match_score"),
                         F.when(F.col("r.score") > 0, F.array_join("r.varying", ",")).otherwise("").alias("varying"))
