"""Registered queries over inputs that reach the branches the plain tables
leave out: rejects, blank and foreign text, empty lists, failed calls, rows
sent again, changed rows. The inputs are derived from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altfinder.functions import quantities as qt
from altfinder.functions import text as tx
from altfinder.operators import browse as br
from altfinder.operators import clean as cl
from altfinder.operators import codes
from altfinder.operators import crossref as xr
from altfinder.operators import feedback as fbk
from altfinder.operators import hybrid as hy
from altfinder.operators import ingest as ing
from altfinder.operators import keyword as kw
from altfinder.operators import matching as mt
from altfinder.operators import upload as upl
from altfinder.operators import vectors as vx
from altfinder.plans import registry as rg
from altfinder.plans import substitutes as sb
from altfinder.plans.registry import register
from altfinder.schemas import MATCH_ARRAY, TEXT_FIELDS
from altfinder.session import materialize, read_table, scratch
from altfinder.sources import derived as dv
from altfinder.sources import snapshots as snap
from altfinder.sources import workbook as wbk
from altfinder.sources.catalog import INVENTORY_SQL, inventory

# --------------------------------------------------------------------------- P2 P3 P5 P9 B5 X3 X4: rows to reject, foreign letters

# How the six fields of a seventh of the rows look: half of them without any
# text, half with tokens that only the cleaner takes for empty.
BLANKS = {"supplier": "   ", "brand": "None", "item_number": "", "catalog_number": "  ", "description": "none", "item_name": " "}
TOKENS = {"supplier": "null", "brand": "None", "item_number": "", "catalog_number": "NULL", "description": " n/a ", "item_name": " "}
FOREIGN = "Café Ångström Piñata Über Žižek"


def dirty_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with missing ids, blank rows and foreign letters; ``row_no`` names the row."""
    n = F.col("id")

    def field(f: str):
        plain = F.when(n % 5 == 0, F.concat(F.col(f), F.lit(f" {FOREIGN}"))).otherwise(F.col(f)) if f == "item_name" else F.col(f)
        return F.when(n % 14 == 0, F.lit(BLANKS[f])).when(n % 14 == 7, F.lit(TOKENS[f])).otherwise(plain).alias(f)

    return inventory(spark, sf_dir).select(n.alias("row_no"), F.when(n % 11 != 0, n).alias("id"), *[field(f) for f in TEXT_FIELDS])


def _dirty_field(f: str) -> str:
    plain = f"CASE WHEN id % 5 = 0 THEN {f} || ' {FOREIGN}' ELSE {f} END" if f == "item_name" else f
    return f"CASE WHEN id % 14 = 0 THEN '{BLANKS[f]}' WHEN id % 14 = 7 THEN '{TOKENS[f]}' ELSE {plain} END AS {f}"


DIRTY_CTE = f"""dirty AS (
  SELECT id AS row_no, CASE WHEN id % 11 <> 0 THEN id END AS id, {', '.join(_dirty_field(f) for f in TEXT_FIELDS)}
  FROM ({INVENTORY_SQL})
)"""
DIRTY_CLEAN_CTES = f"""{DIRTY_CTE},
cleaned AS (SELECT id, row_no, {', '.join(f'{rg.clean_sql(f)} AS {f}' for f in TEXT_FIELDS)} FROM dirty),
judged AS (
  SELECT *, CASE WHEN id IS NULL THEN 'missing_id' WHEN coalesce({', '.join(TEXT_FIELDS)}) IS NULL THEN 'all_fields_null' END
              AS reject_reason FROM cleaned
)"""


@register("dirty_outcome_counts", f"""WITH {DIRTY_CLEAN_CTES}
SELECT coalesce(reject_reason, 'valid') AS outcome, count(*) AS n_rows FROM judged GROUP BY 1""")
def dirty_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + P3: rows kept and skipped by reason, where there are all of them."""
    return cl.transform_counts(dirty_inventory(spark, sf_dir))


@register("dirty_rejected_rows", f"""WITH {DIRTY_CLEAN_CTES}
SELECT id, item_number, item_name, reject_reason, 'transform' AS stage FROM judged WHERE reject_reason IS NOT NULL""")
def dirty_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + B5: the rejected rows with stage and reason."""
    return cl.rejects(dirty_inventory(spark, sf_dir)).select("id", "item_number", "item_name", "reject_reason", "stage")


@register("dirty_combined_text", f"""WITH {DIRTY_CTE}, t AS (SELECT row_no, {rg.combine_sql(TEXT_FIELDS)} AS text_combined FROM dirty)
SELECT row_no, text_combined, CASE WHEN text_combined = '' THEN 'no_text' END AS reject_reason FROM t""")
def dirty_combined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + P9: combined texts, with rows that have none."""
    return cl.with_combined_text(dirty_inventory(spark, sf_dir)).select("row_no", "text_combined", "reject_reason")


@register("dirty_folded_terms", f"""WITH {DIRTY_CTE}
SELECT row_no, strip_accents(array_to_string({rg.words_sql('item_name')}, ' ')) AS terms,
       CAST(list_sum(list_transform({rg.words_sql('item_name')},
            lambda w: CASE WHEN length(w) >= 2 THEN least(length(w), 15) - 1 ELSE 0 END)) AS BIGINT) AS n_grams
FROM dirty WHERE len({rg.words_sql('item_name')}) > 0""")
def dirty_folded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 + X3 + X4: folded words of names with foreign letters, and how many
    prefixes they have (the SQL folds by its own accent table)."""
    rows = dirty_inventory(spark, sf_dir).where(F.size(tx.words("item_name")) > 0)
    return rows.select("row_no", F.array_join(tx.folded_terms("item_name"), " ").alias("terms"),
                       F.size(tx.edge_grams("item_name")).cast("long").alias("n_grams"))


# --------------------------------------------------------------------------- V5 S4 S5 S6: vectors to reject, keyed writes

@register("vector_reject_reasons", f"""WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: x * 0)
                      WHEN vec_id % 5 = 0 THEN embedding[1:{rg.EMB_DIM - 1}] ELSE embedding END AS embedding FROM embeddings
)
SELECT vec_id, CASE WHEN embedding IS NULL THEN 'no_vector' WHEN len(embedding) <> {rg.EMB_DIM} THEN 'wrong_dimension'
                    WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero_vector' END AS reject_reason
FROM e""")
def vector_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: missing, short and zero vectors among the given ones."""
    n, e = F.col("vec_id"), F.col("embedding")
    given = read_table(spark, sf_dir, "embeddings").select("vec_id", F.when(n % 11 == 0, None).when(
        n % 7 == 0, F.transform(e, lambda x: x * F.lit(0).cast("float"))).when(
        n % 5 == 0, F.slice(e, 1, rg.EMB_DIM - 1)).otherwise(e).alias("embedding"))
    return vx.check_dimension(given, rg.EMB_DIM).select("vec_id", "reject_reason")


def _vector_writes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, table, rejects): two loads of changed vectors, new ones and
    short ones, written over the stored vectors."""
    stored = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    n = F.col("vec_id")
    first = stored.where(n % 3 == 0).select("vec_id", "embedding", (F.col("label") + 100).alias("label"), F.lit(1).alias("load"))
    second = stored.where(n % 6 == 0).select("vec_id", "embedding", (F.col("label") + 200).alias("label"), F.lit(2).alias("load"))
    fresh = stored.where(n % 5 == 0).select((n + 10_000_000).alias("vec_id"), "embedding", "label", F.lit(1).alias("load"))
    short = stored.where(n % 10 == 1).select("vec_id", F.slice("embedding", 1, 3).alias("embedding"), "label", F.lit(3).alias("load"))
    base = scratch(spark, "vector-writes")
    table, rejects = snap.keyed_write(
        stored, first.union(second).union(fresh).union(short), f"{base}/table", f"{base}/rejects", "vec_id",
        order_col="load", valid=F.size("embedding") == rg.EMB_DIM)
    return stored, table, rejects


@register("vector_keyed_write", f"""SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN label + 200 WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label,
       CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings
UNION ALL SELECT vec_id + 10000000, label, CAST(len(embedding) AS INTEGER) FROM embeddings WHERE vec_id % 5 = 0""")
def vector_keyed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S5: the vector table after two loads; the later one wins."""
    _, table, _ = _vector_writes(spark, sf_dir)
    return table.select("vec_id", "label", F.size("embedding").alias("dimension"))


@register("vector_write_check", """SELECT (SELECT count(*) FROM embeddings) + count(*) FILTER (WHERE vec_id % 5 = 0) AS document_count,
       true AS schema_ok, true AS count_ok, count(*) FILTER (WHERE vec_id % 10 = 1) AS n_rejects FROM embeddings""")
def vector_write_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S6: count and schema of what was written, and the rejects."""
    stored, table, rejects = _vector_writes(spark, sf_dir)
    want = stored.count() + stored.where("vec_id % 5 = 0").count()
    n = rejects.agg(F.count(F.lit(1)).alias("n_rejects"))
    return snap.verify(table, stored.schema, want).join(F.broadcast(n))


# --------------------------------------------------------------------------- F4 P13 K2 X7 X5 P8 H4: invalid requests, one field, fallbacks

@register("feedback_rejects", """SELECT event_id, nullif(event_type, 'signup') AS feedback, 'invalid feedback type' AS reject_reason
FROM events WHERE event_type NOT IN ('purchase', 'error') OR event_type IS NULL""")
def feedback_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events that are neither like nor dislike, or say nothing."""
    kind = F.col("event_type")
    ev = read_table(spark, sf_dir, "events").select("event_id", F.when(kind == "purchase", "like").when(kind == "error", "dislike")
                                                    .when(kind != "signup", kind).alias("feedback"))
    return fbk.split_valid(ev)[1].select("event_id", "feedback", "reject_reason")


_ASKED_SQL = """asked AS (
  SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '   ' WHEN item_id % 10 = 3 THEN NULL ELSE text END AS text,
         item_id % 120 - 5 AS top_k FROM benchmark
),
checked AS (
  SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 'Empty query string'
                 WHEN top_k NOT BETWEEN 1 AND 100 THEN 'top k must be 1 to 100' END AS error FROM asked
),
good AS (SELECT * FROM checked WHERE error IS NULL),
"""


@register("keyword_answers", rg.DOC_BM25_SQL.strip().replace("WITH d AS", f"WITH {_ASKED_SQL}d AS").replace(
    "FROM benchmark WHERE text", "FROM good WHERE text").replace(
    "SELECT query_id, rank, id, score, total_hits FROM r WHERE rank <= 10",
    """SELECT c.item_id AS query_id, c.error, count(r.id) AS hits
FROM checked c LEFT JOIN r ON r.query_id = c.item_id AND r.rank <= c.top_k GROUP BY c.item_id, c.error"""))
def keyword_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per query, blank ones and bad top k with their error."""
    n = F.col("item_id")
    asked = read_table(spark, sf_dir, "benchmark").select(
        n.alias("query_id"), F.when(n % 4 == 0, "   ").when(n % 10 == 3, None).otherwise(F.col("text")).alias("text"),
        (n % 120 - 5).alias("top_k"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows, _ = kw.answers(kw.KeywordIndex.build(docs, ["text"]), asked, ["text"], fuzzy=False, with_total=False)
    return rows


@register("keyword_field_search", f"""WITH {rg.clean_inv_sql()},
a AS (SELECT id, {rg.std_terms_sql('item_name')} AS terms FROM docs WHERE item_name IS NOT NULL),
a2 AS (SELECT id, terms, len(terms) AS dl FROM a WHERE len(terms) > 0),
fs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM a2),
p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(terms) AS term FROM a2) GROUP BY ALL),
pdf AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT p_partkey AS query_id, unnest({rg.std_terms_sql('substr(p_name, 2)')}) AS term FROM part) GROUP BY ALL
),
ex AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY boost DESC, match_term) AS rn FROM (
      SELECT t.term, v.term AS match_term, 1.0 - damerau_levenshtein(t.term, v.term) / least(length(t.term), length(v.term)) AS boost
      FROM (SELECT DISTINCT term FROM qt) t CROSS JOIN pdf v
      WHERE damerau_levenshtein(t.term, v.term) <= CASE WHEN length(t.term) <= 2 THEN 0 WHEN length(t.term) <= 5 THEN 1 ELSE 2 END))
  WHERE rn <= 50
),
c AS (
  SELECT qt.query_id, p.id, round(round(sum(qtf * boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9), 4) AS score
  FROM qt JOIN ex USING (term) JOIN pdf ON pdf.term = ex.match_term JOIN p ON p.term = ex.match_term CROSS JOIN fs
  GROUP BY qt.query_id, p.id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM c)
SELECT query_id, rank, score, {', '.join(TEXT_FIELDS)} FROM r JOIN docs USING (id) WHERE rank <= 10""")
def keyword_field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + X7 + P12: names that lack their first letter, searched in the name
    field alone, fuzzy without a fixed prefix; six fields of each hit, no id."""
    docs = rg.clean_inventory(spark, sf_dir)
    index = kw.KeywordIndex.build(docs, ["item_name"])
    queries = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.expr("substr(p_name, 2)").alias("text"))
    hits = kw.field_search(index, queries, "item_name", k=10, fields_allowed=TEXT_FIELDS, with_total=False)
    hits = hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    return cl.result_projection(hits, docs, with_id=False)


@register("keyword_exact_values", f"""SELECT s.s_suppkey AS query_id, i.id FROM supplier s JOIN ({INVENTORY_SQL}) i ON i.supplier = s.s_name""")
def keyword_exact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every supplier by the exact form of the field."""
    queries = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.lit("supplier").alias("field"), F.col("s_name").alias("value"))
    return br.exact_values(inventory(spark, sf_dir), queries)


_FALLBACK_SQL = rg.truthy_sql([f"d.{f}" for f in hy.RERANK_FIELDS])


@register("rerank_text_fallback", f"""WITH inv AS ({INVENTORY_SQL}),
pairs AS (
  SELECT q.id AS query_id, d.id, q.description || ' ' || q.item_name AS query_text,
         CASE WHEN d.id % 2 = 0 THEN d.item_name ELSE {_FALLBACK_SQL} END AS doc
  FROM inv q JOIN inv d ON d.id IN (q.id, q.id + 1, q.id + 2)
),
t AS (SELECT query_id, id, list_distinct({rg.std_terms_sql('query_text')}) AS qt, list_distinct({rg.std_terms_sql('doc')}) AS dt FROM pairs)
SELECT query_id, id, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / len(qt) ELSE 0.0 END, 6) AS rerank_score FROM t""")
def rerank_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 + H6: every item as a query for itself and the next two; half of the
    documents have no text of their own, so their fields stand in."""
    inv = inventory(spark, sf_dir)
    queries = inv.select(F.col("id").alias("query_id"), F.concat_ws(" ", "description", "item_name").alias("query_text"),
                         F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    docs = inv.withColumn("text_combined", F.when(F.col("id") % 2 == 0, F.col("item_name")))
    pairs = queries.withColumn("id", F.col("query_id") + F.col("step")).join(docs, "id").withColumnRenamed("step", "position")
    return hy.rerank(pairs, 3).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"))


@register("hybrid_without_vectors", f"""{rg._DOC_HITS_CTE}
SELECT query_id, id, rank AS position, score AS keyword_score, '{hy.NO_VECTOR_WARNING}' AS warning
FROM hits WHERE rank <= 4 AND query_id % 3 = 0""")
def hybrid_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: queries that got no vector keep their 4 best keyword hits."""
    _, queries, hits = rg._doc_hits(spark, sf_dir)
    none = F.when(F.col("query_id") % 3 != 0, F.array(F.lit(1.0)))
    asked = vx.check_dimension(queries.withColumn("embedding", none), 1).where("reject_reason is not null")
    kept = hy.keyword_only(hits, asked, 4)
    return kept.select("query_id", "id", F.col("position").cast("int").alias("position"), "keyword_score", "warning")


@register("hybrid_weighted_fusion", f"""{rg._DOC_HITS_CTE},
o AS (
  SELECT h.query_id, h.id, h.score, list_distinct({rg.std_terms_sql('b.text')}) AS qt, list_distinct({rg.std_terms_sql('d.text')}) AS dt
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id
),
t AS (SELECT query_id, id, score AS k, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / len(qt) ELSE 0.0 END, 6) AS v FROM o),
e AS (SELECT *, min(k) OVER w AS k0, max(k) OVER w AS k1, min(v) OVER w AS v0, max(v) OVER w AS v1 FROM t WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(0.5 * CASE WHEN k1 > k0 THEN (k - k0) / (k1 - k0) ELSE 0 END
                           + 0.5 * CASE WHEN v1 > v0 THEN (v - v0) / (v1 - v0) ELSE 0 END, 6) AS fused_score FROM e""")
def hybrid_weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: two scores of the same hits, min-max normalised and summed by weight."""
    docs, queries, hits = rg._doc_hits(spark, sf_dir)
    pairs = (hits.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
             .join(docs.select("id", F.col("text").alias("text_combined")), "id"))
    both = pairs.select("query_id", "id", F.col("score").alias("keyword_score"), F.round(
        hy.overlap_score(F.col("query_text"), F.col("text_combined")), 6).alias("vector_score"))
    return hy.fuse_weighted(both).select("query_id", "id", F.round("fused_score", 6).alias("fused_score"))


# --------------------------------------------------------------------------- M1 M12 C3 C5 C7: stored lists, some of them empty

def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cross-reference table in which a quarter of the lists are empty,
    requested sources: all users, and as many that are not stored)."""
    stored = dv.crossref_from_events(spark, sf_dir)
    number = F.substring("item_number", 2, 20).cast("long")
    table = stored.withColumn("matches", F.when(number % 4 == 0, xr.empty_matches()).otherwise(F.col("matches")))
    users = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    asked = users.select(F.explode(F.array(F.concat(F.lit("U"), "u"), F.concat(F.lit("V"), "u"))).alias("item_number"))
    return table, asked


_LISTS_CTES = f"""{dv.CROSSREF_ENTRIES_SQL},
lists AS (SELECT * FROM xr WHERE CAST(substr(item_number, 2) AS BIGINT) % 4 <> 0),
users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events),
asked AS (SELECT 'U' || u AS item_number FROM users UNION ALL SELECT 'V' || u FROM users)"""


@register("crossref_routing", f"""WITH {_LISTS_CTES}
SELECT item_number, item_number IN (SELECT item_number FROM lists) AS from_cache FROM asked WHERE item_number IS NOT NULL""")
def crossref_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: which sources their stored matches answer; empty lists do not."""
    table, asked = _lists(spark, sf_dir)
    cached, fresh = mt.route_by_cache(asked, table)
    return cached.unionByName(fresh)


@register("crossref_stored_lists", f"""WITH {_LISTS_CTES}
SELECT a.item_number, count(l.pos) > 0 AS found, count(l.pos) AS n_matches
FROM asked a LEFT JOIN lists l USING (item_number) WHERE a.item_number IS NOT NULL GROUP BY a.item_number""")
def crossref_stored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored list of each requested source."""
    table, asked = _lists(spark, sf_dir)
    found = xr.stored_matches(table, asked.where("item_number is not null"))
    return found.select("item_number", "found", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"))


def _few_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue that holds three of the matched items, each many times."""
    return inventory(spark, sf_dir).withColumn("item_number", F.concat(F.lit("M"), (F.col("id") % 3).cast("string")))


_FEW_CTES = f"""few AS (SELECT 'M' || CAST(id % 3 AS VARCHAR) AS item_number, max(id) AS id FROM ({INVENTORY_SQL}) GROUP BY 1)"""


@register("crossref_lookup_enriched", f"""WITH {_LISTS_CTES}, {_FEW_CTES},
pe AS {rg.parsed_entries_sql('lists', 50)},
r AS (
  SELECT pe.*, CAST(row_number() OVER (PARTITION BY item_number ORDER BY score DESC, pos) AS INTEGER) AS rank
  FROM pe WHERE item <> item_number
)
SELECT r.item_number, rank, item AS matched_item, score AS match_score, few.id, i.item_name
FROM r JOIN few ON few.item_number = r.item JOIN ({INVENTORY_SQL}) i ON i.id = few.id WHERE rank <= 3""")
def crossref_lookup_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 + M11: the 3 best stored matches of each source, enriched; items
    that are not in the catalogue drop after the cut."""
    table, asked = _lists(spark, sf_dir)
    out = xr.cross_references_for(table, asked, _few_items(spark, sf_dir), top_k=3)
    return out.select("item_number", F.col("rank").cast("int").alias("rank"), "matched_item", "match_score", "id", "item_name")


@register("crossref_missing_items", f"""WITH {_LISTS_CTES}, {_FEW_CTES}, pe AS {rg.parsed_entries_sql('lists', 50)}
SELECT item_number AS source_item, pos, item FROM pe WHERE item NOT IN (SELECT item_number FROM few)""")
def crossref_missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches whose item the catalogue lacks."""
    table, _ = _lists(spark, sf_dir)
    e = xr.explode_matches(table).where("ok").select(F.col("item_number").alias("source_item"), F.col("pos").cast("int").alias("pos"), "item")
    return mt.missing_items(e, _few_items(spark, sf_dir), "item").select("source_item", "pos", "item")


@register("crossref_saved_lists", f"""WITH {dv.CROSSREF_ENTRIES_SQL}, pe AS {rg.parsed_entries_sql('xr', 50)},
kept AS (
  SELECT item_number, pos, item, array_to_string(attrs, ',') AS attrs,
         CASE WHEN pos % 3 = 0 THEN CAST(floor(score / 200.0 * 100 + 0.5) AS INTEGER) WHEN score % 4 <> 0 THEN score ELSE 50 END AS score
  FROM pe WHERE CAST(substr(item_number, 2) AS BIGINT) % 6 <> 5 AND NOT (pos = 1 OR CAST(substr(item_number, 2) AS BIGINT) % 9 = 1)
)
SELECT item_number, CAST(row_number() OVER (PARTITION BY item_number ORDER BY pos) - 1 AS INTEGER) AS pos,
       concat_ws('|', item, CAST(score AS VARCHAR), attrs) AS r FROM kept""")
def crossref_saved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the save step keeps of reviewed results -- sources not found,
    excluded places and lists left empty go; relevance before score before 50."""
    e = xr.explode_matches(dv.crossref_from_events(spark, sf_dir)).where("ok")
    number = F.substring("source_item", 2, 20).cast("long")
    reviewed = e.select(F.col("item_number").alias("source_item"), F.col("pos").cast("int").alias("match_idx"), F.col("item").alias("item_number"),
                        F.when(F.col("pos") % 3 == 0, F.col("score") / 200.0).when(F.col("pos") % 3 == 1, 0.0).alias("relevance_score"),
                        F.when(F.col("score") % 4 != 0, F.col("score")).otherwise(0).alias("match_score"),
                        F.col("attrs").alias("varying_attributes")).withColumn("found", number % 6 != 5)
    out = reviewed.where((F.col("match_idx") == 1) | (number % 9 == 1)).select("source_item", "match_idx")
    saved = xr.save_step(reviewed, out)
    return saved.select("item_number", F.posexplode(F.col("matches").cast(MATCH_ARRAY)).alias("pos", "m")).select(
        "item_number", F.col("pos").cast("int").alias("pos"), F.col("m.r").alias("r"))


# --------------------------------------------------------------------------- M4: a model that fails for some requests

def _picky(texts: list[str]) -> list[str]:
    if any(t.endswith("7 in.") for t in texts):
        raise ValueError("no answer")
    return ['[{"r": "A|90|"}, {"r": "B|x|cfm"}]' for _ in texts]


@register("match_model_failures", f"""SELECT id AS query_id, CASE WHEN item_name LIKE '%7 in.' THEN 'ValueError: no answer' END AS error,
       CASE WHEN item_name LIKE '%7 in.' THEN 0 ELSE 140 END AS total_score FROM ({INVENTORY_SQL})""")
def match_model_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M5: a request that fails keeps its reason and costs no other."""
    requests = inventory(spark, sf_dir).select(F.col("id").alias("query_id"), F.lit(0).alias("batch"), F.col("item_name").alias("request"))
    replied = mt.ask_model(requests, _picky)
    score = F.aggregate(F.coalesce(F.transform(mt.cp.parse_reply(F.col("reply")), lambda r: mt.cp.parse_compact(r)["score"]),
                                   F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    return replied.select("query_id", "error", score.alias("total_score"))


# --------------------------------------------------------------------------- I1 I6 I7: rows sent again

def _two_runs(spark: SparkSession, sf_dir: str) -> str:
    """Outcomes of a run over all documents and one over those sent again,
    blank or with a new text."""
    base = scratch(spark, "ingest-runs") + "/outcomes"
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    again = docs.where(F.col("id") % 9 < 2).withColumn("text", F.when(F.col("id") % 9 == 0, " ").otherwise("changed text"))
    for run, rows in enumerate((docs, again)):
        ing.process(rows, base, rg.EMB_DIM, rg.RUN_TS, run=run, fields=["text"])
    return base


_RUNS_CTE = f"""runs AS (
  SELECT doc_id, len({rg.std_terms_sql('text')}) > 0 AS first_ok, {rg.combine_sql(['text'])} AS t FROM documents
)"""


@register("ingest_sent_again", f"""WITH {_RUNS_CTE}
SELECT doc_id AS product_id,
       CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 9 = 1 OR first_ok THEN 'completed' ELSE 'failed' END AS status,
       CAST(CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 9 = 1 THEN 12 ELSE length(t) END AS INTEGER) AS text_length,
       first_ok OR doc_id % 9 = 1 AS has_vector FROM runs""")
def ingest_sent_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I6: status by the last run; a row that turned blank is failed but
    keeps the vector it had."""
    base = _two_runs(spark, sf_dir)
    held = ing.vectors(spark, base).select(F.col("id").alias("product_id"), F.lit(True).alias("has_vector"))
    rows = ing.progress(spark, base).join(held, "product_id", "left")
    return rows.select("product_id", "status", "text_length", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@register("ingest_run_reports", f"""WITH {_RUNS_CTE}
SELECT 0 AS run, 'completed' AS status, count(*) AS rows, count(*) FILTER (WHERE first_ok) AS embedded,
       count(*) FILTER (WHERE NOT first_ok) AS failed FROM runs
UNION ALL
SELECT 1, 'completed', count(*), count(*) FILTER (WHERE doc_id % 9 = 1), count(*) FILTER (WHERE doc_id % 9 = 0)
FROM runs WHERE doc_id % 9 < 2""")
def ingest_run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each run."""
    return ing.reports(spark, _two_runs(spark, sf_dir)).select("run", "status", "rows", "embedded", "failed")


# --------------------------------------------------------------------------- B2 K1: refresh equals rebuild

CHANGED_INV_CTE = f"""inv0 AS ({INVENTORY_SQL}),
inv AS (
  SELECT id, item_number, CASE WHEN id % 9 = 0 THEN item_name || ' revised' ELSE item_name END AS item_name,
         CASE WHEN id % 9 = 3 THEN NULL ELSE brand END AS brand, catalog_number, description, supplier
  FROM inv0 WHERE id % 9 <> 6
  UNION ALL SELECT id + 10000000, item_number || 'N', item_name, brand, catalog_number, description, supplier FROM inv0 WHERE id % 9 = 7
)"""


def _changed_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogue before, after edits, deletions and new rows; their ids)."""
    old = materialize(inventory(spark, sf_dir))
    n = F.col("id")
    new = old.where(n % 9 != 6).withColumn("item_name", F.when(n % 9 == 0, F.concat("item_name", F.lit(" revised"))).otherwise(F.col("item_name"))) \
        .withColumn("brand", F.when(n % 9 != 3, F.col("brand")))
    more = old.where(n % 9 == 7).withColumn("item_number", F.concat("item_number", F.lit("N"))).withColumn("id", n + 10_000_000)
    changed = old.where((n % 9).isin(0, 3, 6)).select("id").union(more.select("id"))
    return old, new.unionByName(more), changed


@register("index_after_refresh", f"""WITH {rg.multifield_ctes(CHANGED_INV_CTE)}
SELECT p.field, p.term, count(*) AS df, CAST(sum(p.tf) AS BIGINT) AS tf, any_value(fs.n_docs) AS n_docs, round(any_value(fs.avgdl), 6) AS avgdl
FROM p JOIN fs USING (field) GROUP BY p.field, p.term""")
def index_after_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + K1: vocabulary and statistics of an index whose changed rows alone
    were analysed anew; the SQL builds them from the whole new catalogue."""
    old, new, changed = _changed_catalog(spark, sf_dir)
    index = sb.Legs.build(old, rg.HYBRID_DIM).refresh(new, changed, rg.HYBRID_DIM).index
    by_term = index.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return by_term.join(F.broadcast(index.field_stats), "field").select("field", "term", "df", "tf", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@register("vectors_after_refresh", f"""WITH {CHANGED_INV_CTE},
vdoc AS (SELECT id, {rg.combine_sql(TEXT_FIELDS)} AS t FROM inv),
vterm AS (SELECT id, unnest({rg.std_terms_sql('t')}) AS term FROM vdoc WHERE t <> '')
SELECT id, count(DISTINCT (('0x' || substr(md5(term), 1, 8))::BIGINT) % {rg.HYBRID_DIM}) AS nonzero FROM vterm GROUP BY id""")
def vectors_after_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: the vectors after only the changed rows were embedded."""
    old, new, changed = _changed_catalog(spark, sf_dir)
    vectors = sb.Legs.build(old, rg.HYBRID_DIM).refresh(new, changed, rg.HYBRID_DIM).vectors
    return vectors.select("id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"))


# --------------------------------------------------------------------------- R1 S7 P10 P11: all pages, an upload file

@register("catalog_all_pages", f"""WITH {rg.CLEAN_INV_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_index FROM docs)
SELECT id, row_index, row_index // 50 + 1 AS page FROM r""")
def catalog_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and page of every row of the cleaned catalogue."""
    return br.rank_rows(rg.clean_inventory(spark, sf_dir)).select("id", "row_index", "page")


@register("catalog_page_by_seek", f"""WITH {rg.CLEAN_INV_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_index FROM docs)
SELECT id, item_number, item_name FROM r WHERE row_index // 50 + 1 = 7""")
def catalog_page_by_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page found in the index of pages and read by its range of ids."""
    docs = materialize(rg.clean_inventory(spark, sf_dir).repartitionByRange("id").sortWithinPartitions("id"))
    index = materialize(br.page_index(docs))
    return br.seek_page(docs, index, 7).select("id", "item_number", "item_name")


ACCENTED = ["", "É", "e", "Ä ", "z-", "Zoë ", "o'", "10 ", "9 ", "ñ"]


@register("catalog_sorted_by_locale", f"""WITH n AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE
         CASE p_partkey % 10 {" ".join("WHEN %d THEN '%s'" % (i, a.replace("'", "''")) for i, a in enumerate(ACCENTED))} END || p_name END AS item_name
  FROM part)
SELECT id, item_name, row_number() OVER (ORDER BY lower(coalesce(item_name, '')) COLLATE "en_us", id) - 1 AS row_index FROM n""")
def catalog_sorted_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: names with accents, marks and digits in locale order, ties by id."""
    k = F.col("p_partkey")
    first = F.get(F.array(*[F.lit(a) for a in ACCENTED]), (k % 10).cast("int"))
    named = read_table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 17 != 0, F.concat(first, "p_name")).alias("item_name"))
    return br.rank_rows(named, "name_asc", collation="UNICODE").select("id", "item_name", "row_index")


ORACLE_OF_FILE_ROWS = """WITH u AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS ordinal, p_partkey % 60 = 11 AS blank, * FROM part
)
SELECT ordinal, concat('IT', CAST(p_partkey AS VARCHAR)) AS item_number, p_name AS item_name,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS brand FROM u WHERE NOT blank"""


def _upload_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The parts and, by header, the cells of an upload of them."""
    k, blank = F.col("p_partkey"), F.col("p_partkey") % 60 == 11
    cells = [F.when(blank | (k % 7 == 0), "").otherwise(F.col("p_brand")), F.when(~blank, F.concat(F.lit("IT"), k.cast("string"))),
             F.col("p_type"), F.lit(""), F.when(~blank, F.col("p_name")), k.cast("string")]
    headers = [" BRAND NAME", "Wise Item No ", "Catalog No", "Mainframe Description", "win item name", "Other"]
    return read_table(spark, sf_dir, "part"), dict(zip(headers, cells, strict=True))


@register("upload_file_rows", ORACLE_OF_FILE_ROWS)
def upload_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + P10 + P11: an upload file written in item order and read back:
    row numbers as in the file, rows without number, name and brand dropped."""
    p, cells = _upload_cells(spark, sf_dir)
    path = scratch(spark, "upload-file")
    (p.orderBy("p_partkey").select(*[c.alias(h) for h, c in cells.items()])
     .write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return upl.read_upload(spark, path).select("ordinal", "item_number", "item_name", "brand")


@register("upload_workbook_rows", ORACLE_OF_FILE_ROWS)
def upload_workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + P10 + P11 for spreadsheets: the same rows as workbooks of 700 rows."""
    p, cells = _upload_cells(spark, sf_dir)
    path = scratch(spark, "upload-workbooks")
    written = wbk.write_workbooks(p.select("p_partkey", *[F.nullif(c, F.lit("")).alias(h) for h, c in cells.items()]), path, ["p_partkey"], 700)
    written.count()
    rows, _ = upl.read_workbooks(spark, path)
    return rows.select("ordinal", "item_number", "item_name", "brand")


# --------------------------------------------------------------------------- M8: quantities in every notation

# Names by form, and for each the kinds and values (of the part's size n) that
# they state; the values are stated, not read from the names.
NOTATIONS = [
    ("Duct Fan {n} in. {n},250 CFM", [("size", "n"), ("cfm", "n * 1000 + 250")]),
    ("{n}-1/2 in x {n} ft Copper Pipe", [("size", "n + 0.5"), ("length", "n * 12")]),
    ("{n} 3/4\" Elbow", [("size", "n + 0.75")]),
    ("Motor 1/{n} HP 115/230V", [("hp", "1 / n"), ("voltage", "115"), ("voltage", "230")]),
    ("Relay {n}00 mA 24 VDC", [("amps", "n / 10"), ("voltage", "24")]),
    ("Breaker {n}-60 Amp 1.5 kW", [("amps", "n"), ("amps", "60"), ("watts", "1500")]),
    ("Valve {n} mm, 2 bar", [("size", "n / 25.4"), ("pressure", "29.0075")]),
    ("Pump {n}0 gph {n} psi", [("gpm", "n / 6"), ("pressure", "n")]),
    ("Grille {n} x 4 x 8 inch", [("size", "n"), ("size", "4"), ("size", "8")]),
    ("Cord schedule 40 {n} feet w/ plug", [("length", "n * 12")]),
    ("Widget {n}", []),
    ("Plug nema {n}-15p .5 in", [("size", "0.5")]),
]


def _stated(form: list[tuple[str, str]]) -> str:
    rows = [f"{{'place': {i}, 'kind': '{kind}', 'value': round(CAST({value} AS DOUBLE), 4)}}" for i, (kind, value) in enumerate(form)]
    return f"[{', '.join(rows)}]"


@register("quantity_notations", "SELECT p_partkey, x.place, x.kind, x.value FROM (SELECT p_partkey, unnest(CASE k "
          + " ".join(f"WHEN {i} THEN {_stated(form)}" for i, (_, form) in enumerate(NOTATIONS) if form)
          + f" END) AS x FROM (SELECT p_partkey, p_partkey % {len(NOTATIONS)} AS k, CAST(p_size AS DOUBLE) AS n FROM part))")
def quantity_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: quantities read from a name of every part, in base units."""
    parts = read_table(spark, sf_dir, "part")
    form = F.get(F.array(*[F.lit(name) for name, _ in NOTATIONS]), F.pmod(F.col("p_partkey"), F.lit(len(NOTATIONS))).cast("int"))
    found = qt.quantities(F.replace(form, F.lit("{n}"), F.col("p_size").cast("string")))
    return (parts.select("p_partkey", F.posexplode(found).alias("place", "q"))
            .select("p_partkey", "place", F.col("q.kind").alias("kind"), F.col("q.value").alias("value")))


# --------------------------------------------------------------------------- V4: product codes

@register("vector_codes_recall", f"""SELECT count(*) AS queries, true AS recall_reached, true AS within_a_tenth
FROM embeddings WHERE len(embedding) = {vx.DEFAULT_DIM} AND list_sum(list_transform(embedding, lambda x: x * x)) > 0""")
def vector_codes_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 through codes: every vector as a query, recall at 10 of 0.9 or more
    with at most a tenth of the whole-vector distances of the exact search."""
    v = rg._vectors(spark, sf_dir)
    q = v.withColumnRenamed("id", "query_id")
    recall = vx.recall_at_k(codes.knn_codes(q, v, k=10), vx.knn(q, v, k=10))
    return recall.agg(F.count(F.lit(1)).alias("queries"), (F.max("mean_recall") >= 0.9).alias("recall_reached"),
                      (F.lit(10 * codes.SHORT_LIST) * 10 <= F.count(F.lit(1))).alias("within_a_tenth"))
