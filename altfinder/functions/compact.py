"""The compact match format ``ITEM|SCORE|attr,attr`` and its JSON column
(S8, M5, M6, M7). Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from altfinder.functions.text import strip_ws
from altfinder.schemas import MATCH_ARRAY

INT_PATTERN = r"^[+-]?[0-9]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_compact(r, bad_score: int = 50) -> Column:
    """M6: struct(item, score, attrs, ok). Split on the pipe (empty parts
    kept), at least two parts, item stripped, score an integer after
    stripping or ``bad_score``, attributes of the third part stripped and
    non-empty. ``ok`` is false for rows the parser skips."""
    r = _c(r)
    parts = F.split(r, r"\|", -1)
    ok = r.isNotNull() & (r != "") & (F.size(parts) >= 2)
    s = strip_ws(F.get(parts, 1))
    score = F.when(s.rlike(INT_PATTERN), s.try_cast("int")).otherwise(F.lit(bad_score))
    raw_attrs = F.get(parts, 2)
    attrs = F.when(
        (F.size(parts) >= 3) & (raw_attrs != ""),
        F.filter(F.transform(F.split(raw_attrs, ",", -1), lambda a: strip_ws(a)), lambda a: a != ""),
    ).otherwise(F.array().cast("array<string>"))
    return F.struct(strip_ws(F.get(parts, 0)).alias("item"),
                    F.coalesce(score, F.lit(bad_score)).alias("score"),
                    attrs.alias("attrs"), ok.alias("ok"))


def write_compact(item, score, attrs) -> Column:
    """M7: ``ITEM|SCORE|a,b`` (empty attribute list keeps the last pipe)."""
    return F.concat_ws("|", _c(item), _c(score).cast("string"), F.array_join(_c(attrs), ","))


def matches_from_json(c) -> Column:
    """JSON text column -> array<struct<r,l,d>> (null on bad JSON)."""
    return F.from_json(_c(c), MATCH_ARRAY)


def matches_to_json(c) -> Column:
    """array<struct<r,l,d>> -> JSON text; absent counts are left out."""
    return F.to_json(_c(c))


def reply_body(reply) -> Column:
    """M5: strip a Markdown code fence (and a ``json`` tag) from a reply."""
    t = strip_ws(_c(reply))
    inner = F.coalesce(F.get(F.split(t, "```", -1), 1), F.lit(""))
    inner = F.when(inner.startswith("json"), inner.substr(F.lit(5), F.length(inner))).otherwise(inner)
    return F.when(t.startswith("```"), strip_ws(inner)).otherwise(t)


def parse_reply(reply) -> Column:
    """M5: reply text -> array of compact strings; null when it is not a
    JSON array of objects (the reference drops such a batch)."""
    arr = F.from_json(reply_body(reply), "array<struct<r:string>>")
    return F.transform(arr, lambda x: x["r"])
