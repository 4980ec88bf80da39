"""Chat formatting by relational operations only.

A conversation's turn structs are collected and sorted, adjacent turns of one
role are merged by an array aggregation, and the blocks are concatenated:

    <s>ROLE[INST]TEXT[/INST]TEXT</s>

``[/INST]`` stands between the texts of merged turns, so reading back gives
the turns as they were. In roles and texts a backslash is doubled and a
backslash is put behind the first character of a control string; then no
control string is left in them, and ``\\(.)`` -> ``$1`` restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, BODY, NEXT, CLOSE)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _blocks(turns: Column) -> Column:
    """[(role, texts)] with adjacent turns of one role merged: the running
    block is closed when the role changes."""
    block = "struct<role:string,texts:array<string>>"
    empty = F.lit(None).cast(block)
    start = F.struct(F.array().cast(f"array<{block}>").alias("done"), empty.alias("last"))

    def step(acc: Column, turn: Column) -> Column:
        same = acc["last"].isNotNull() & (acc["last"]["role"] == turn["role"])
        grown = F.struct(turn["role"].alias("role"), F.concat(acc["last"]["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        done = F.when(same | acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
        return F.struct(done.alias("done"), F.when(same, grown).otherwise(fresh).cast(block).alias("last"))

    return F.aggregate(turns, start, step,
                       lambda acc: F.when(acc["last"].isNull(), acc["done"])
                       .otherwise(F.concat(acc["done"], F.array(acc["last"]))))


def format_conversations(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of ``turns`` (conv_id,
    turn, role, text).

    loss_spans are (begin, length) in code points, from 0, of the texts of
    ``role`` inside ``formatted``. Null texts and roles are empty; equal turn
    numbers are ordered by role, then text; a null turn number comes first;
    rows of a null conv_id make one conversation; repeated rows stay. An empty
    table gives no rows. One conversation is one value, so it must fit a row.
    """
    rows = turns.select("conv_id", F.col("turn").alias("turn"),
                        escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
                        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = grouped.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.concat(F.lit(OPEN), b["role"], F.lit(BODY)).alias("s"), F.lit(False).alias("loss"))),
        F.flatten(F.transform(b["texts"], lambda t, i: F.concat(
            F.when(i > 0, F.array(F.struct(F.lit(NEXT).alias("s"), F.lit(False).alias("loss"))))
            .otherwise(F.array().cast("array<struct<s:string,loss:boolean>>")),
            F.array(F.struct(t.alias("s"), (b["role"] == F.lit(role)).alias("loss")))))),
        F.array(F.struct(F.lit(CLOSE).alias("s"), F.lit(False).alias("loss"))))))
    out = blocks.select("conv_id", pieces.alias("pieces"))
    # begin of each piece: one pass that carries (position, spans)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate("pieces", state, lambda acc, p: F.struct(
        (acc["at"] + F.length(p["s"])).cast("long").alias("at"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(
            acc["at"].alias("begin"), F.length(p["s"]).cast("long").alias("length")))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    return out.select("conv_id", F.concat_ws("", F.transform("pieces", lambda p: p["s"])).alias("formatted"),
                      spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): the turns [(role, text)] and the text under
    the loss mask, both parsed from ``formatted`` alone and unescaped."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda s: s != "")
    turns = F.flatten(F.transform(blocks, lambda b: _read_block(b)))
    masked = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), masked.alias("loss_text"))


def _read_block(block: Column) -> Column:
    head = F.substring_index(block, BODY, 1)
    body = F.substring(block, F.length(head) + len(BODY) + 1, F.length(block))
    role = unescape(F.substring(head, len(OPEN) + 1, F.length(head)))
    return F.transform(F.split(body, r"\[/INST\]", -1),
                       lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
