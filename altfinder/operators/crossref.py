"""The cross-reference table: source item -> ordered match list.

State changes are snapshot -> snapshot: every operator takes the current
table as a DataFrame and returns the next one; ``sources.snapshots`` writes
it as a new version. Deletions explode only the lists they name and regroup
them in list order (a group is one stored list); feedback edits the array in
place (``transform`` / ``filter`` against a per-source lookup joined on the
key). Per-source "first / last" questions are grouped min / max_by, which
Spark pre-aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altfinder.functions import compact as cp
from altfinder.schemas import MATCH_ARRAY


def empty_matches() -> Column:
    return F.array().cast(MATCH_ARRAY)


def entry_key(r: Column) -> Column:
    """The raw (unstripped) text before the first pipe; null when there is no
    pipe. ``r`` starts with ``X|`` exactly when this equals X."""
    return F.when(F.instr(r, "|") > 0, F.substring_index(r, "|", 1))


def explode_matches(crossref: DataFrame, bad_score: int = 50) -> DataFrame:
    """(item_number, pos, r, likes, dislikes, key, item, score, attrs, ok):
    one row per stored entry; ``pos`` is 0-based list order."""
    e = crossref.select("item_number", F.posexplode("matches").alias("pos", "m"))
    return e.select(
        "item_number", "pos", F.col("m.r").alias("r"),
        F.coalesce(F.col("m.l"), F.lit(0)).alias("likes"),
        F.coalesce(F.col("m.d"), F.lit(0)).alias("dislikes"),
        entry_key(F.col("m.r")).alias("key"),
        cp.parse_compact(F.col("m.r"), bad_score).alias("p"),
    ).select("*", F.col("p.item").alias("item"), F.col("p.score").alias("score"),
             F.col("p.attrs").alias("attrs"), F.col("p.ok").alias("ok")).drop("p")


# --------------------------------------------------------------------------- writes

def upsert(crossref: DataFrame, new_lists: DataFrame, ts) -> DataFrame:
    """C1 + C8: replace the whole list of every source in ``new_lists``
    (item_number, matches); counts of a replaced list are lost, as in the
    reference. created_at is kept, updated_at is set to ``ts`` on change."""
    ts = F.lit(ts).cast("timestamp") if not isinstance(ts, Column) else ts
    old = crossref.select("item_number", F.col("matches").alias("_om"), F.col("created_at").alias("_oc"),
                          F.col("updated_at").alias("_ou"))
    new = new_lists.select("item_number", F.col("matches").alias("_nm"), F.lit(True).alias("_new"))
    j = old.join(new, "item_number", "full_outer")
    return j.select(
        "item_number",
        F.when(F.col("_new"), F.col("_nm")).otherwise(F.col("_om")).alias("matches"),
        F.coalesce(F.col("_oc"), ts).alias("created_at"),
        F.when(F.col("_new"), ts).otherwise(F.col("_ou")).alias("updated_at"),
    )


def bulk_upsert(crossref: DataFrame, entries: DataFrame, ts) -> tuple[DataFrame, DataFrame]:
    """Entries (ordinal, item_number, matches) in upload order. The last
    entry of a source wins. Returns (new table, counts) where counts has one
    row per outcome: saved (source new to the table, first time in the
    upload), updated (already stored, or repeated in the upload), error (no
    item number)."""
    bad = entries.where(F.col("item_number").isNull())
    good = entries.where(F.col("item_number").isNotNull())
    existing = crossref.select("item_number", F.lit(True).alias("_stored"))
    # first ordinal and last entry per source by grouped min / max_by, which
    # Spark pre-aggregates before the shuffle (a source repeated across a
    # third of the upload is still spread over many tasks)
    per_src = good.groupBy("item_number").agg(F.min("ordinal").alias("_first"),
                                             F.max_by("matches", "ordinal").alias("matches"))
    flagged = (good.join(per_src.select("item_number", "_first"), "item_number")
               .join(existing, "item_number", "left")
               .withColumn("outcome", F.when(F.col("_stored") | (F.col("ordinal") > F.col("_first")),
                                             F.lit("updated")).otherwise(F.lit("saved"))))
    last = per_src.select("item_number", "matches")
    counts = (flagged.select("outcome").unionByName(bad.select(F.lit("error").alias("outcome")))
              .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
    return upsert(crossref, last, ts), counts


def save_step(results: DataFrame, exclusions: DataFrame) -> DataFrame:
    """From reviewed results (source_item, found, match_idx, item_number,
    relevance_score, match_score, varying_attributes) and user exclusions
    (source_item, match_idx) build (item_number, matches) to save: sources
    not found or without results are dropped, excluded positions dropped,
    score = round(relevance x 100) if relevance is set and non-zero, else
    match score if non-zero, else 50; sources left empty are dropped."""
    kept = (results.where(F.col("found") & F.col("item_number").isNotNull())
            .join(exclusions, ["source_item", "match_idx"], "left_anti"))
    rel = F.col("relevance_score")
    score = (F.when(rel.isNotNull() & (rel != 0), F.floor(rel * 100 + F.lit(0.5)).cast("int"))
             .when(F.col("match_score").isNotNull() & (F.col("match_score") != 0), F.col("match_score"))
             .otherwise(F.lit(50)))
    m = kept.select("source_item", "match_idx", F.struct(
        cp.write_compact(F.col("item_number"), score,
                         F.coalesce(F.col("varying_attributes"), F.array().cast("array<string>"))).alias("r"),
        F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("d")).alias("m"))
    return (m.groupBy("source_item")
            .agg(F.array_sort(F.collect_list(F.struct("match_idx", "m"))).alias("_l"))
            .select(F.col("source_item").alias("item_number"), F.transform("_l", lambda x: x["m"]).alias("matches")))


def delete_matches(crossref: DataFrame, deletions: DataFrame, ts) -> tuple[DataFrame, DataFrame]:
    """Deletions (source_item, matched_item). Every entry whose raw text
    starts with ``matched_item|`` is removed. Returns (new table, status per
    deletion: removed / not_found / no_crossref, with remaining count). An
    emptied list stays as a row. Statuses compare with the stored list.

    Only the lists named by a deletion are exploded; their entries are
    anti-joined with the deletions on (source, key) and regrouped in list
    order (a group is one stored list, bounded by its length)."""
    ts = F.lit(ts).cast("timestamp") if not isinstance(ts, Column) else ts
    dels = deletions.select(F.col("source_item").alias("item_number"),
                            F.col("matched_item").alias("key")).distinct()
    touched = crossref.join(dels.select("item_number").distinct(), "item_number", "left_semi")
    ent = touched.select("item_number", F.posexplode("matches").alias("pos", "m")) \
        .withColumn("key", entry_key(F.col("m.r")))
    kept = ent.join(dels, ["item_number", "key"], "left_anti")
    regrouped = (kept.groupBy("item_number")
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_l"))
                 .select("item_number", F.transform("_l", lambda x: x["m"]).alias("_kept")))
    edited = (touched.join(regrouped, "item_number", "left")
              .select("item_number", F.coalesce("_kept", empty_matches()).alias("matches"), "created_at",
                      F.when(F.size(F.coalesce("_kept", empty_matches())) != F.size("matches"), ts)
                      .otherwise(F.col("updated_at")).alias("updated_at")))
    untouched = crossref.join(dels.select("item_number").distinct(), "item_number", "left_anti")
    new = untouched.unionByName(edited)
    # status: does the stored list hold the item?
    hits = ent.join(dels, ["item_number", "key"], "left_semi").select(
        F.col("item_number").alias("source_item"), F.col("key").alias("matched_item")).distinct() \
        .withColumn("_hit", F.lit(True))
    has = crossref.where(F.size("matches") > 0).select(F.col("item_number").alias("source_item"),
                                                       F.lit(True).alias("_has"))
    remaining = edited.select(F.col("item_number").alias("source_item"), F.size("matches").alias("_rem"))
    status = (deletions.join(hits, ["source_item", "matched_item"], "left")
              .join(has, "source_item", "left").join(remaining, "source_item", "left")
              .select("source_item", "matched_item",
                      F.when(F.col("_has").isNull(), F.lit("no_crossref"))
                      .when(F.col("_hit").isNull(), F.lit("not_found")).otherwise(F.lit("removed")).alias("status"),
                      F.when(F.col("_has").isNull(), F.lit(0)).otherwise(F.col("_rem")).alias("remaining_matches")))
    return new, status


# --------------------------------------------------------------------------- reads

def stored_matches(crossref: DataFrame, requested: DataFrame, item_col: str = "item_number") -> DataFrame:
    """Stored list per requested source; an empty list counts as
    missing (found = false, matches null)."""
    has = crossref.where(F.size("matches") > 0).select(F.col("item_number").alias(item_col), "matches")
    return (requested.select(item_col).distinct().join(has, item_col, "left")
            .withColumn("found", F.col("matches").isNotNull()))


def best_alternative(crossref: DataFrame) -> DataFrame:
    """C4: per source the highest-scored entry that is not the source itself
    (unparseable score counts as 0 here; first in list order on ties)."""
    e = explode_matches(crossref.where(F.col("item_number").isNotNull() & (F.size("matches") > 0)), bad_score=0)
    e = e.where(F.col("ok") & (F.col("item") != F.col("item_number")))
    w = Window.partitionBy("item_number").orderBy(F.desc("score"), F.asc("pos"))
    return (e.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select("item_number", F.col("item").alias("alt_item_number"), F.col("score").alias("match_score"),
                    F.col("attrs").alias("varying_attributes")))


def cross_references_for(crossref: DataFrame, requested: DataFrame, catalog: DataFrame, top_k: int = 20,
                         enrich: bool = True) -> DataFrame:
    """For each requested source its stored matches sorted by score
    (stable), the source itself removed, cut to top_k, then enriched from the
    catalogue (unknown items dropped -- the cut comes first, so fewer than
    top_k may remain). Columns: item_number, rank, matched item, score,
    attributes, likes, dislikes (+ catalogue columns)."""
    from altfinder.operators.matching import catalog_by_item

    src = requested.select("item_number").distinct()
    e = explode_matches(crossref.join(src, "item_number", "left_semi").where(F.size("matches") > 0))
    e = e.where(F.col("ok") & (F.col("item") != F.col("item_number")))
    w = Window.partitionBy("item_number").orderBy(F.desc("score"), F.asc("pos"))
    top = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select(
        "item_number", "rank", F.col("item").alias("matched_item"), F.col("score").alias("match_score"),
        F.col("attrs").alias("varying_attributes"), "likes", "dislikes")
    if not enrich:
        return top
    cat = catalog_by_item(catalog).select(F.col("item_number").alias("matched_item"), "id", "item_name", "brand",
                                          "catalog_number", "description", "supplier")
    return top.join(cat, "matched_item", "inner")
