"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text are turned into ratios; from the labelled ones
a list of threshold conjunctions is learned for the poor class: a rule is
grown condition by condition (information gain over the uncovered rows, cuts
between any two of their values), pruned on held-out rows and kept if it stays
precise there; the rows it covers, or the poor ones it was grown for if it is
not kept, are taken away before the next rule grows. The list is emitted as one
ordered Spark conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_marks", "n_digits")
STATS_TYPE = StructType([StructField(c, LongType(), False) for c in STATS])
ARROW_STATS = pa.struct([pa.field(c, pa.int64(), False) for c in STATS])

_SYMBOLS = frozenset(b"#*$%&|<>")
_DROP = {  # byte tables: what remains after deletion is not counted
    "symbols": bytes(b for b in range(256) if b not in _SYMBOLS),
    "upper": bytes(b for b in range(256) if not 65 <= b <= 90),
    "lower": bytes(b for b in range(256) if not 97 <= b <= 122),
    "marks": bytes(b for b in range(256) if b not in b"!?"),
    "digits": bytes(b for b in range(256) if not 48 <= b <= 57),
    "space": bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"),
}
_BLANK = re.compile(rb"[^ \t\n\x0b\x0c\r]")


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    n = len(words)
    if n < 4:
        return 0, len(ids)
    # two steps of exact numbering: pair numbers, then (pair, word) numbers
    base = np.int64(len(ids))
    _, pair = np.unique(seq[:-1] * base + seq[1:], return_inverse=True)
    _, gram, count = np.unique(pair[:-1].astype(np.int64) * base + seq[2:],
                               return_inverse=True, return_counts=True)
    hit = count[gram] >= 2
    if not hit.any():
        return 0, len(ids)
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum()), len(ids)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics named in ``STATS`` of one whole text (null: all 0)."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    left = {k: len(raw.translate(None, drop)) for k, drop in _DROP.items()}
    seen: set[bytes] = set()
    n_lines = dups = 0
    for line in raw.split(b"\n"):
        if _BLANK.search(line):
            n_lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    repeated, distinct = repeat_words(words)
    return (len(words), len(text) - left["space"], left["symbols"], dups, repeated, n_lines, distinct,
            left["upper"], left["lower"], left["marks"], left["digits"])


def _stats_column(texts: pa.Array) -> pa.Array:
    rows = np.array([text_stats(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))],
                                      fields=list(ARROW_STATS))


def stats_of(text: Column) -> Column:
    """A struct of the statistics, evaluated batch by batch."""
    def stats(texts: pa.Array) -> pa.Array:
        return _stats_column(texts)

    return F.arrow_udf(stats, STATS_TYPE)(text)


#: Ratios that rules may test: name -> (numerator, denominator).
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "mark_ratio": ("n_marks", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"),
    "line_words": ("n_words", "n_lines"),
}


def feature(name: str, stats: str) -> Column:
    top, below = FEATURES[name]
    num = F.col(f"{stats}.{top}").cast("double")
    return num if below is None else num / F.greatest(F.col(f"{stats}.{below}"), F.lit(1)).cast("double")


def features_of(stats: np.ndarray) -> np.ndarray:
    """The same ratios over rows of ``STATS``."""
    at = {c: i for i, c in enumerate(STATS)}
    out = np.empty((len(stats), len(FEATURES)))
    for j, (top, below) in enumerate(FEATURES.values()):
        num = stats[:, at[top]].astype(float)
        out[:, j] = num if below is None else num / np.maximum(stats[:, at[below]], 1)
    return out


@dataclass
class Rule:
    """``feature >= cut`` or ``feature < cut`` for every condition."""

    conditions: list[tuple[int, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for j, above, cut in self.conditions:
            hit &= (x[:, j] >= cut) if above else (x[:, j] < cut)
        return hit

    def expression(self, stats: str) -> Column:
        names = list(FEATURES)
        out = F.lit(True)
        for j, above, cut in self.conditions:
            f = feature(names[j], stats)
            out = out & ((f >= F.lit(cut)) if above else (f < F.lit(cut)))
        return out

    def __str__(self) -> str:
        names = list(FEATURES)
        return " and ".join(f"{names[j]} {'>=' if above else '<'} {cut:.6g}" for j, above, cut in self.conditions)


def _grow(x: np.ndarray, y: np.ndarray, orders: list[np.ndarray], use: np.ndarray, most: int) -> Rule:
    """A rule for the rows ``y`` among those in ``use``. ``orders``: the rows
    sorted by each feature. Cuts are all midpoints of the values inside."""
    rule, inside = Rule(), use.copy()
    while len(rule.conditions) < most and (inside & ~y).any():
        p0, n0 = int((inside & y).sum()), int((inside & ~y).sum())
        if not p0:
            break
        had, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, order in enumerate(orders):
            rows = order[inside[order]]
            values = x[rows, j]
            at = np.flatnonzero(values[1:] > values[:-1])  # a cut lies after these rows
            if not len(at):
                continue
            below_p = np.cumsum(y[rows])[at]
            below_n = at + 1 - below_p
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / (p + n)) - had), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    low, high = values[at[k]], values[at[k] + 1]
                    middle = (low + high) / 2
                    best = (float(gain[k]), (j, above, float(middle if middle > low else high)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside &= Rule([best[1]]).covers(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The shortest head of the rule with the best (p - n) / (p + n)."""
    best, kept = -2.0, rule
    for k in range(1, len(rule.conditions) + 1):
        head = Rule(rule.conditions[:k])
        hit = head.covers(x)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept = worth, head
    return kept


def learn(x: np.ndarray, poor: np.ndarray, order: np.ndarray, precision: float = 0.95,
          max_conditions: int = 4, max_rules: int = 32, chance: float = 1e-3) -> list[Rule]:
    """Sequential covering of the poor rows. ``order`` is any fixed integer per
    row; every third one (by it) prunes, the others grow. The poor rows that an
    imprecise rule was grown for are set aside, and the next rule grows for the
    others. A rule whose held-out rows could be poor by more than ``chance`` is
    imprecise: with cuts at every value some fit any few rows."""
    rules: list[Rule] = []
    held = order % 3 == 0
    gx, gy, px, py = x[~held], poor[~held], x[held], poor[held]
    base = float(py.mean()) if len(py) else 0.0
    orders = [np.argsort(gx[:, j], kind="stable") for j in range(x.shape[1])]
    left, open_, p_left = np.ones(len(gx), dtype=bool), gy.copy(), np.ones(len(px), dtype=bool)
    while len(rules) < max_rules and open_.any():
        grown = _grow(gx, open_, orders, left & (open_ | ~gy), max_conditions)
        if not grown.conditions:
            break
        rule = _prune(grown, px[p_left], py[p_left])
        g, h = rule.covers(gx) & left, rule.covers(px) & p_left
        right = int((g & gy).sum() + (h & py).sum())
        wrong = int((g & ~gy).sum() + (h & ~py).sum())
        held_p, held_n = int((h & py).sum()), int((h & ~py).sum())
        if right < precision * (right + wrong) or held_p < precision * (held_p + held_n) or base ** held_p > chance:
            open_ &= ~grown.covers(gx)
            continue
        rules.append(rule)
        left, open_, p_left = left & ~g, open_ & ~g, p_left & ~h
    return rules


def base_failed(stats: str) -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (r * 100 > n * 50)


def verdict(rules: list[Rule], stats: str) -> Column:
    """The ordered list: the first rule that holds rejects, else keep."""
    out = None
    for rule in rules:
        cond = rule.expression(stats)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = 50_000, **knobs) -> list[Rule]:
    """Learn from ``stats`` (doc_id, stats) and ``labels`` (doc_id, quality).

    At most ``max_labelled`` labelled rows, those of smallest hashed doc_id,
    reach the driver; this bound is the only sample here. Rows without a
    label, null labels and unknown ids are left out; an id labelled twice
    counts as poor if any label says so.
    """
    asked = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rows = (stats.select("doc_id", "stats").join(asked, "doc_id")
            .select(F.xxhash64("doc_id").alias("at"), "doc_id", "quality", *[F.col(f"stats.{c}").alias(c) for c in STATS])
            .orderBy("at", "doc_id", *STATS).limit(max_labelled).toPandas())
    x = features_of(rows[list(STATS)].to_numpy(dtype=np.int64).reshape(-1, len(STATS)))
    return learn(x, (rows["quality"] == 0).to_numpy(), rows["at"].to_numpy(dtype=np.int64), **knobs)


def judge(docs: DataFrame, labels: DataFrame, **knobs) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, stats, base_failed, kept) per row of ``docs``, and the rules.

    Null and empty texts have no words and fail the base rule; repeated rows
    are judged alike; other columns are ignored.
    """
    stats = written(docs.select("doc_id", stats_of(F.col("text")).alias("stats")), "quality-stats")
    rules = fit(stats, labels, **knobs)
    failed = base_failed("stats")
    return stats.select("doc_id", "stats", failed.alias("base_failed"),
                        (~failed & verdict(rules, "stats")).alias("kept")), rules


def keep_good(docs: DataFrame, labels: DataFrame, **knobs) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; the texts
    are measured once and written with their statistics."""
    name = "_stats"
    while name in docs.columns:
        name += "_"
    measured = written(docs.withColumn(name, stats_of(F.col("text"))), "quality-measured")
    rules = fit(measured.select("doc_id", F.col(name).alias("stats")), labels, **knobs)
    return measured.where(~base_failed(name) & verdict(rules, name)).drop(name)
