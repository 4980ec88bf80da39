"""Column expressions for cleaning, combining and analysing text.

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation; nothing here runs Python per row.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from altfinder.schemas import TEXT_FIELDS

# Tokens that the catalogue cleaner turns into null (compared
# lower-cased after stripping).
NULL_TOKENS = ["null", "none", "n/a", ""]

# The English stop-word list of the standard analyzer.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]

# Word pattern of the standard analysis: runs of letters and digits.
WORD_PATTERN = r"[\p{L}\p{N}]+"

# Whitespace as Python's str.strip() sees it.
WS_CLASS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\p{Z}]"
STRIP_PATTERN = rf"^{WS_CLASS}+|{WS_CLASS}+$"
COLLAPSE_PATTERN = rf"{WS_CLASS}+"

# Edge n-gram sizes of the prefix sub-field.
MIN_GRAM = 2
MAX_GRAM = 15

# Latin letters whose ASCII form is more than one letter or
# has no canonical decomposition (lower case; folding runs after lower()).
FOLD_MULTI = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij")]
FOLD_SINGLE_EXTRA = [("ø", "o"), ("đ", "d"), ("ł", "l"), ("ı", "i"), ("ħ", "h"), ("ŧ", "t"),
                     ("ƀ", "b"), ("ð", "d")]


def _fold_table() -> tuple[str, str]:
    """Single-letter fold table, derived by rule: every lower-case letter in
    Latin-1 Supplement and Latin Extended-A/B whose canonical decomposition is
    one ASCII letter followed by combining marks maps to that letter."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        if ch != ch.lower():
            continue
        dec = unicodedata.normalize("NFD", ch)
        base = dec[0]
        if len(dec) > 1 and base.isascii() and base.isalpha() and all(
                unicodedata.combining(c) for c in dec[1:]):
            src.append(ch)
            dst.append(base)
    for a, b in FOLD_SINGLE_EXTRA:
        if a not in src:
            src.append(a)
            dst.append(b)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python-style strip of leading and trailing whitespace."""
    return F.regexp_replace(_c(c).cast("string"), STRIP_PATTERN, "")


def clean_text(c) -> Column:
    """To string, strip, null for empty or a null token in any case."""
    s = strip_ws(c)
    return F.when(s.isNull() | F.lower(s).isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(s)


def combine_fields(fields=TEXT_FIELDS) -> Column:
    """P5: fields in list order; a part is kept if it is non-blank and is not
    ``none`` before stripping; parts are stripped, joined and whitespace is
    collapsed."""
    parts = []
    for f in fields:
        v = F.col(f).cast("string")
        keep = v.isNotNull() & (strip_ws(v) != "") & (F.lower(v) != "none")
        parts.append(F.when(keep, strip_ws(v)))
    joined = F.concat_ws(" ", *parts)
    return strip_ws(F.regexp_replace(joined, COLLAPSE_PATTERN, " "))


def join_truthy(fields) -> Column:
    """Non-empty fields joined by a space, no cleaning."""
    return F.concat_ws(" ", *[F.when(F.col(f) != "", F.col(f)) for f in fields])


def fold_ascii(c) -> Column:
    """ASCII folding of lower-case text."""
    out = F.translate(_c(c), FOLD_FROM, FOLD_TO)
    for a, b in FOLD_MULTI:
        out = F.regexp_replace(out, a, b)
    return out


def words(c) -> Column:
    """Lower-cased words (runs of letters and digits)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_PATTERN), 0)


def standard_terms(c) -> Column:
    """Standard analysis -- words, lower case, stop words removed.
    A filter (not array_except) keeps repeated words, so term counts hold."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(c), lambda t: ~F.array_contains(stops, t))


def folded_terms(c) -> Column:
    """Query side of the prefix sub-field -- words, lower case, folded."""
    return F.transform(words(c), lambda t: fold_ascii(t))


def edge_grams(c) -> Column:
    """Prefixes of length 2..15 of every word, lower-cased then folded."""
    def grams(t):
        n = F.least(F.length(t), F.lit(MAX_GRAM))
        return F.when(
            n >= MIN_GRAM,
            F.transform(F.sequence(F.lit(MIN_GRAM), n), lambda k: fold_ascii(F.substring(t, 1, k))),
        ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words(c), grams))


def fold_sql(expr: str) -> str:
    """The same folding written as SQL text (used by oracle queries)."""
    out = f"translate({expr}, '{FOLD_FROM}', '{FOLD_TO}')"
    for a, b in FOLD_MULTI:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def stop_words_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _aligned(a: Column, b: Column) -> Column:
    """Optimal string alignment distance by its table, a row per character of
    ``a``; a swapped pair is not edited again."""
    def row(held: Column, x: Column, x_before: Column, chars: Column) -> Column:
        """Row i from rows i-1 (``p``) and i-2 (``q``)."""
        p, q, i = held["p"], held["q"], held["i"]

        def cell(done: Column, j: Column) -> Column:
            y, y_before = F.get(chars, j - 1), F.get(chars, j - 2)
            plain = F.least(F.get(p, j) + 1, F.get(done, j - 1) + 1, F.get(p, j - 1) + F.when(x == y, 0).otherwise(1))
            swapped = F.coalesce((i > 1) & (j > 1) & (x == y_before) & (x_before == y), F.lit(False))
            return F.concat(done, F.array(F.when(swapped, F.least(plain, F.get(q, j - 2) + 1)).otherwise(plain)))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), F.array(i), cell)

    def steps(xs: Column, chars: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(chars))
        start = F.struct(F.lit(1).alias("i"), first.alias("p"), first.alias("q"))
        last = F.aggregate(F.sequence(F.lit(1), F.size(xs)), start, lambda held, i: F.struct(
            (held["i"] + 1).alias("i"), row(held, F.get(xs, i - 1), F.get(xs, i - 2), chars).alias("p"), held["p"].alias("q")))
        return F.try_element_at(last["p"], F.lit(-1))
    return steps(F.split(a, ""), F.split(b, ""))


def edits_with_swaps(a: Column, b: Column) -> Column:
    """Edits between two non-empty strings if at most 2, else 3 or more; an
    adjacent swap is one edit (optimal string alignment). Only pairs whose plain
    distance leaves it open are aligned: a swap counts two there."""
    plain = F.levenshtein(a, b, 4)
    return F.when(plain.between(0, 1), plain).when(plain.between(2, 4), F.least(plain, _aligned(a, b))).otherwise(F.lit(3))
