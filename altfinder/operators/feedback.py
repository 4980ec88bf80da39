"""Like / dislike feedback on stored matches (F1-F4), as a batch fold.

The reference applies one request at a time: find every entry of the
source's list whose text starts with ``item|``, add one like or dislike,
drop the entry once its dislikes exceed 5 (checked after any update, so a
like also drops an entry already above 5). Later requests no longer see a
dropped entry; a list emptied this way reads as "no cross-reference".

Here all events are folded at once. Running counts per list entry come from
a two-phase scan so that no single key -- even one holding a third of all
events -- is processed by one task: events are cut into time chunks, chunk
totals are summed per key (a handful of rows per key), and the running sum
inside each (key, chunk) adds that offset. The removal point is a grouped
minimum, which Spark pre-aggregates before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altfinder.operators.crossref import entry_key
from altfinder.schemas import MATCH_ARRAY

REMOVE_ABOVE = 5
FEEDBACK_TYPES = ("like", "dislike")
CHUNK_SECONDS = 3600


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """only ``like`` and ``dislike`` are accepted; the rest are rejects."""
    ok = F.col("feedback").isin(*FEEDBACK_TYPES)
    return events.where(ok), events.where(~ok | F.col("feedback").isNull()).withColumn(
        "reject_reason", F.lit("invalid feedback type"))


def entries(crossref: DataFrame) -> DataFrame:
    """One row per list entry: source_item, pos, matched_item, l0, d0."""
    e = crossref.select("item_number", F.posexplode("matches").alias("pos", "m"))
    return e.select(F.col("item_number").alias("source_item"), "pos",
                    entry_key(F.col("m.r")).alias("matched_item"),
                    F.coalesce(F.col("m.l"), F.lit(0)).alias("l0"),
                    F.coalesce(F.col("m.d"), F.lit(0)).alias("d0"))


def _running(j: DataFrame, chunk_seconds: int) -> DataFrame:
    """Running like / dislike counts per (source_item, pos) in (ts, event_id)
    order, by the two-phase scan described in the module docstring."""
    key = ["source_item", "pos"]
    j = j.withColumn("chunk", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(chunk_seconds * 1_000_000)))
    tot = j.groupBy(*key, "chunk").agg(F.sum("is_like").alias("_cl"), F.sum("is_dislike").alias("_cd"))
    wk = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*key, "chunk", F.coalesce(F.sum("_cl").over(wk), F.lit(0)).alias("off_l"),
                     F.coalesce(F.sum("_cd").over(wk), F.lit(0)).alias("off_d"))
    wc = Window.partitionBy(*key, "chunk").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return (j.join(off, [*key, "chunk"])
            .withColumn("cum_l", F.col("l0") + F.col("off_l") + F.sum("is_like").over(wc))
            .withColumn("cum_d", F.col("d0") + F.col("off_d") + F.sum("is_dislike").over(wc))
            .drop("off_l", "off_d"))


def applied(ent: DataFrame, valid: DataFrame, chunk_seconds: int = CHUNK_SECONDS,
            remove_above: int = REMOVE_ABOVE) -> DataFrame:
    """Each valid event at each entry it names: the running counts, whether it
    still applied (the entry was not dropped before), whether it dropped it."""
    ev = valid.select("event_id", "ts", "source_item", "matched_item",
                      (F.col("feedback") == "like").cast("int").alias("is_like"),
                      (F.col("feedback") == "dislike").cast("int").alias("is_dislike"))
    j = _running(ev.join(ent, ["source_item", "matched_item"]), chunk_seconds)
    order = F.struct("ts", "event_id")
    rm = (j.where(F.col("cum_d") > remove_above).groupBy("source_item", "pos")
          .agg(F.min(order).alias("removed_at")))
    j = j.join(rm, ["source_item", "pos"], "left")
    return (j.withColumn("applied", F.col("removed_at").isNull() | (order <= F.col("removed_at")))
            .withColumn("removed_here", F.coalesce(order == F.col("removed_at"), F.lit(False))))


def state_after(j: DataFrame) -> DataFrame:
    """Counts per entry after its events: source_item, pos, l, d, removed, last_ts."""
    return (j.where("applied").groupBy("source_item", "pos")
            .agg(F.max("cum_l").alias("l"), F.max("cum_d").alias("d"), F.max("removed_here").alias("removed"),
                 F.max("ts").alias("last_ts")))


def with_state(crossref: DataFrame, state: DataFrame) -> DataFrame:
    """The table with the counts of ``state`` (of entries that had events);
    removed entries drop."""
    per_src = (state.groupBy("source_item")
               .agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("l", "d", "removed")))).alias("_u"),
                    F.max("last_ts").alias("_ts"))
               .withColumnRenamed("source_item", "item_number"))
    t = crossref.join(per_src, "item_number", "left")

    def upd(m: Column, i: Column) -> Column:
        u = F.element_at(F.col("_u"), i)
        return F.when(u.isNull(), F.struct(m["r"].alias("r"), m["l"].alias("l"), m["d"].alias("d"),
                                          F.lit(False).alias("gone"))) \
            .otherwise(F.struct(m["r"].alias("r"), u["l"].cast("int").alias("l"), u["d"].cast("int").alias("d"),
                                u["removed"].alias("gone")))
    edited = F.filter(F.transform("matches", upd), lambda x: ~x["gone"])
    return t.select(
        "item_number",
        F.when(F.col("_u").isNull(), F.col("matches"))
        .otherwise(F.transform(edited, lambda x: F.struct(x["r"].alias("r"), x["l"].alias("l"), x["d"].alias("d")))
                   ).cast(MATCH_ARRAY).alias("matches"),
        "created_at",
        F.when(F.col("_ts").isNotNull(), F.greatest(F.col("updated_at"), F.col("_ts")))
        .otherwise(F.col("updated_at")).alias("updated_at"))


def fold(crossref: DataFrame, events: DataFrame, chunk_seconds: int = CHUNK_SECONDS,
         remove_above: int = REMOVE_ABOVE) -> tuple[DataFrame, DataFrame]:
    """F1 + F2: apply valid feedback events (event_id, ts, source_item,
    matched_item, feedback) to the table. Returns (new table, one reply per
    event: event_id, source_item, matched_item, status, likes, dislikes,
    removed). status is updated / not_found / no_crossref."""
    ev, _ = split_valid(events)
    j = applied(entries(crossref), ev, chunk_seconds, remove_above)
    new_tab = with_state(crossref, state_after(j))
    order = F.struct("ts", "event_id")
    rm = (j.where(F.col("removed_at").isNotNull()).groupBy("source_item", "pos")
          .agg(F.max("removed_at").alias("removed_at")))

    # replies: list emptied by removals answers "no cross-reference" afterwards
    sizes = crossref.select(F.col("item_number").alias("source_item"), F.size("matches").alias("_size"))
    emptied = (rm.groupBy("source_item").agg(F.count(F.lit(1)).alias("_nrm"), F.max("removed_at").alias("_empty_at"))
               .join(sizes, "source_item").where(F.col("_nrm") == F.col("_size")).select("source_item", "_empty_at"))
    per_ev = (j.where("applied").groupBy("event_id")
              .agg(F.max_by(F.struct("cum_l", "cum_d"), F.col("pos")).alias("_c"),
                   F.max("removed_here").alias("removed")))
    rep = (ev.join(sizes, "source_item", "left").join(emptied, "source_item", "left")
           .join(per_ev, "event_id", "left"))
    no_xr = (F.coalesce(F.col("_size"), F.lit(0)) == 0) | (
        F.col("_empty_at").isNotNull() & (order > F.col("_empty_at")))
    status = F.when(no_xr, F.lit("no_crossref")).when(F.col("_c").isNull(), F.lit("not_found")) \
        .otherwise(F.lit("updated"))
    ok = status == "updated"
    replies = rep.select(
        "event_id", "source_item", "matched_item", status.alias("status"),
        F.when(ok, F.col("_c.cum_l")).otherwise(F.lit(0)).cast("int").alias("likes"),
        F.when(ok, F.col("_c.cum_d")).otherwise(F.lit(0)).cast("int").alias("dislikes"),
        F.when(ok, F.col("removed")).otherwise(F.lit(False)).alias("removed"))
    return new_tab, replies


def read_counts(crossref: DataFrame, pairs: DataFrame) -> DataFrame:
    """likes and dislikes of the first entry of the source's list that
    starts with ``item|``; zeros and success = false when absent."""
    ent = entries(crossref)
    w = Window.partitionBy("source_item", "matched_item").orderBy("pos")
    first = ent.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "pos")
    return (pairs.select("source_item", "matched_item").distinct()
            .join(first, ["source_item", "matched_item"], "left")
            .select("source_item", "matched_item", F.col("l0").isNotNull().alias("success"),
                    F.coalesce("l0", F.lit(0)).cast("int").alias("likes"),
                    F.coalesce("d0", F.lit(0)).cast("int").alias("dislikes")))
