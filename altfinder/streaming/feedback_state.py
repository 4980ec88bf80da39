"""the feedback fold with keyed state in Spark's state store.

``transformWithStateInPandas`` holds the list entries, with their counts, and
the events still open. An event is open until the watermark (the latest event
time seen, less ``delay``) passes it: until then an earlier event may still
arrive and is folded in before it. An event-time timer folds the passed ones
into the counts. What a micro-batch emits is the fold of all events so far in
the order (ts, event_id), open ones included, so the last row of an entry equals
one batch fold (F1), in whatever order the events arrived. Events without a time
come last, by event_id, and stay open.

A call to the state costs far more than an event, so a key of the state is a
group of (source item, matched item) pairs, dealt by hash: the entries of a
group are one value and its open events another, and a micro-batch reads and
writes each once for a group that it touches. The number of groups is fixed at
the first start, so calls do not grow with the catalogue or the log.

Late-event rule: an event older than the watermark on arrival is not applied.
Spark drops it before the state is asked and counts it; ``late_events`` reads
the count.

A task holds one group at a time: its entries, its events of the micro-batch and
its open events, so it grows with the events inside ``delay`` and with the
trigger's size, not with all events. Where one entry may get a third of all
events, ``feedback_stream`` spreads them over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from altfinder.operators import feedback as fb
from altfinder.sources import snapshots as snap

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["source_item", "pos"]
PAIR = ["source_item", "matched_item"]
OUT = "source_item string, pos int, l long, d long, removed boolean, last_us long"
GROUPS = 1024
NEVER = (1 << 63) - 1  # the time of events that have none


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: tuple | None) -> pd.DataFrame | None:
    return value and pa.ipc.open_stream(pa.py_buffer(bytes(value[0]))).read_all().to_pandas()


def _fold(entries: pd.DataFrame, events: pd.DataFrame, remove_above: int) -> pd.DataFrame:
    """The entries after events in order; none apply once an entry is removed."""
    hits = events.merge(pd.DataFrame({"pair": entries["pair"], "entry": np.arange(len(entries))}), on="pair")
    entry, like, us = (hits[c].to_numpy() for c in ("entry", "is_like", "us"))
    over = entries["d"].to_numpy()[entry] + pd.Series(~like).groupby(entry).cumsum().to_numpy() > remove_above
    before = pd.Series(over).groupby(entry).cumsum().to_numpy() - over
    use = (before == 0) & ~entries["removed"].to_numpy()[entry]
    entry, like, us, over = entry[use], like[use], us[use], over[use]
    after = entries.copy()
    after["l"] += np.bincount(entry[like], minlength=len(entries))
    after["d"] += np.bincount(entry[~like], minlength=len(entries))
    after["removed"] |= np.bincount(entry[over], minlength=len(entries)) > 0
    last = pd.Series(us[us < NEVER]).groupby(entry[us < NEVER]).last()
    after["last_us"] = after["last_us"].mask(after.index.isin(last.index), last.reindex(after.index).astype("Int64"))
    return after


class FeedbackState(StatefulProcessor):
    def __init__(self, remove_above: int):
        self.remove_above = remove_above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "rows binary")
        self.open = handle.getValueState("open", "rows binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        new = initialState[[*PAIR, "pos"]].assign(
            l=initialState["l0"].astype("int64"), d=initialState["d0"].astype("int64"), removed=False,
            last_us=pd.array([None] * len(initialState), dtype="Int64"))
        held = _unpacked(self.entries.get())  # a large group comes in parts
        new = new if held is None else pd.concat([held.drop(columns="pair"), new], ignore_index=True)
        self.entries.update(_packed(new.assign(pair=new.groupby(PAIR, sort=False, dropna=False).ngroup())))

    def _passed(self, entries: pd.DataFrame, pending: pd.DataFrame, watermark_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Folds the events that the watermark has passed into the counts;
        returns the entries and the events still open, in order."""
        pending = pending.sort_values(["us", "event_id", "is_like"], ignore_index=True)
        done = (pending["us"] <= watermark_ms * 1000).to_numpy()
        if done.any():
            entries, pending = _fold(entries, pending[done], self.remove_above), pending[~done]
            self.entries.update(_packed(entries))
        if len(pending):
            self.open.update(_packed(pending))
        else:
            self.open.clear()
        return entries, pending

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, new = _unpacked(self.entries.get()), []
        for part in rows:  # of pairs without an entry nothing is kept
            if entries is not None and len(part):
                new.append(part.merge(entries[[*PAIR, "pair"]].drop_duplicates("pair"), on=PAIR)[["pair", "us", "event_id", "is_like"]])
        touched = {p for part in new for p in part["pair"].unique()}
        if not touched:
            return
        held = _unpacked(self.open.get())
        pending = pd.concat([*([] if held is None else [held]), *new], ignore_index=True)
        entries, pending = self._passed(entries, pending, timerValues.getCurrentWatermarkInMs())
        timed = pending["us"][pending["us"] < NEVER]
        if len(timed):
            self.handle.registerTimer(int(timed.iloc[-1]) // 1000 + 1)
        entries = entries[entries["pair"].isin(touched)].reset_index(drop=True)
        yield _fold(entries, pending[pending["pair"].isin(touched)], self.remove_above)[["source_item", "pos", "l", "d", "removed", "last_us"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = _unpacked(self.open.get())
        if pending is not None:
            self._passed(_unpacked(self.entries.get()), pending, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64(*PAIR), F.lit(groups)).cast("int").alias("pairs")


def start(events: DataFrame, crossref: DataFrame, state: str, checkpoint: str, delay: str = "1 day",
          remove_above: int = fb.REMOVE_ABOVE, groups: int = GROUPS) -> StreamingQuery:
    """Start the stream over ``events``, a streaming DataFrame of feedback; it
    processes every file present and stops. A restart goes on from
    ``checkpoint``, with the same ``crossref`` and number of ``groups``; each
    micro-batch appends the entries it touched to the table ``state`` as its
    epoch."""
    spark = crossref.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    valid, _ = fb.split_valid(events)
    keyed = valid.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        _group(groups), *PAIR, "ts", F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("us"), "event_id", (F.col("feedback") == "like").alias("is_like"))
    first = fb.entries(crossref).select(_group(groups), "*").groupBy("pairs")
    out = keyed.groupBy("pairs").transformWithStateInPandas(
        statefulProcessor=FeedbackState(remove_above), outputStructType=OUT,
        outputMode="Update", timeMode="EventTime", initialState=first)

    def batch(df: DataFrame, epoch: int) -> None:
        snap.write_epoch(df, state, epoch)

    return (out.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def late_events(query: StreamingQuery) -> int:
    """Events of a run that came after the watermark had passed them."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def table(spark: SparkSession, crossref: DataFrame, state: str) -> DataFrame:
    """The cross-reference table with the streamed counts in it."""
    touched = snap.latest(spark, state, KEYS)
    return fb.with_state(crossref, touched.select(*KEYS, "l", "d", "removed", F.timestamp_micros("last_us").alias("last_ts")))
