"""Secret scans with corpus-wide ownership frequency, by expressions only.

Patterns propose candidates with their places; a candidate's value is kept as
its SHA-256. The hashes are counted by distinct repositories and owners over
the whole corpus: a value that many owners have is a copied example, one that
stays with one owner looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The base kinds in their order, the pattern of each and the
# least length of the group that must have it.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
# Kinds that the method adds when their values are owner-specific.
ADDED = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 35),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
    ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])"
              r"[A-Za-z0-9+/_-]{24,}+", 0, 24),
)
KINDS = tuple(k for k, *_ in BASE + ADDED)

SPAN = "struct<begin:bigint,kind_no:int,kind:string,end:bigint,hash:string>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has at
    least ``least`` characters. The texts between the matches tell the places,
    which Spark's extraction leaves out. Texts without a match pay one scan."""
    regex = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = (begin + F.length(F.coalesce(p["whole"], F.lit("")))).cast("long")
        span = F.struct(begin.cast("long").alias("begin"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"),
                        end.alias("end"), F.sha2(p["value"], 256).alias("hash"))
        good = p["whole"].isNotNull() & (F.length(p["value"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(parts, state, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """(uid, doc_id, owner, repository, base, added) per row, written once.

    base and added are span arrays; an added candidate inside a base span is
    left out. uid tells repeated rows apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*[matches(text, *k) for k in BASE]))
    added = F.array_sort(F.concat(*[matches(text, *k) for k in ADDED]))
    own = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    rows = docs.select("doc_id", own.alias("owner"),
                       F.concat_ws("/", own, F.col(repository).cast("string")).alias("repository"),
                       base.alias("base"), added.alias("added"))
    rows = rows.withColumn("added", F.filter("added", lambda a: ~F.exists(
        "base", lambda b: (b["begin"] <= a["begin"]) & (a["end"] <= b["end"]))))
    return written(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "secret-candidates")


def ownership(found: DataFrame, max_owners: int = 2, max_repositories: int = 4) -> DataFrame:
    """(hash, n_repositories, n_owners, live) per candidate value. Equal
    (hash, owner, repository) rows are merged before the shuffle, so a value
    that a third of all rows hold is small work."""
    each = (found.select("owner", "repository", F.explode(F.concat("base", "added")).alias("s"))
            .select("owner", "repository", F.col("s.hash").alias("hash")).distinct())
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(
        F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")).withColumn(
        "live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang",
         max_owners: int = 2, max_repositories: int = 4) -> DataFrame:
    """(uid, doc_id, base, added, examples) per row of ``docs``.

    base: the base spans, all of them. added: the spans of further kinds whose
    value looks live. examples: number of base spans whose value is widely
    copied. Null and empty texts have no spans; a null owner is the owner ''.
    Repeated rows are separate rows of one owner; an empty table gives no rows.
    """
    found = candidates(docs, owner, repository)
    verdicts = ownership(found, max_owners, max_repositories)
    spans = (found.select("uid", F.explode(F.concat("base", "added")).alias("s"))
             .select("uid", "s", F.col("s.hash").alias("hash")))
    judged = spans.join(verdicts, "hash").groupBy("uid").agg(
        F.sort_array(F.collect_list(F.when(F.col("live") & (F.col("s.kind_no") >= len(BASE)), F.col("s")))).alias("live_added"),
        F.count(F.when(~F.col("live") & (F.col("s.kind_no") < len(BASE)), 1)).alias("examples"))
    return found.join(judged, "uid", "left").select(
        "uid", "doc_id", "base", F.coalesce("live_added", F.array().cast(f"array<{SPAN}>")).alias("added"),
        F.coalesce("examples", F.lit(0)).cast("long").alias("examples"))


def listing(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["begin"], acc["at"])
        new = s["begin"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        out = F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(F.array_sort(spans), state, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redacted(docs: DataFrame, owner: str = "source", repository: str = "lang",
             max_owners: int = 2, max_repositories: int = 4) -> DataFrame:
    """``docs`` with every reported span replaced, all columns kept; n_chars
    follows the text where there is one. The patterns run once; only rows
    with spans of the added kinds wait for the corpus-wide verdicts."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    spans = {f"{mark}base": BASE, f"{mark}added": ADDED}
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("*", *[F.concat(*[matches(text, *k) for k in kinds]).alias(c) for c, kinds in spans.items()])
    held = written(held.select("*", F.monotonically_increasing_id().alias(f"{mark}uid")), "secret-held")
    own = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    found = held.select(own.alias("owner"), F.concat_ws("/", own, F.col(repository).cast("string")).alias("repository"),
                        F.col(f"{mark}base").alias("base"), F.col(f"{mark}added").alias("added"))
    live = ownership(found, max_owners, max_repositories).where("live").select("hash")
    some = F.size(f"{mark}added") > 0
    wanted = (held.where(some).select(F.col(f"{mark}uid").alias(f"{mark}id"), F.explode(f"{mark}added").alias("s"))
              .select(f"{mark}id", "s", F.col("s.hash").alias("hash")).join(live, "hash", "left_semi")
              .groupBy(f"{mark}id").agg(F.collect_list("s").alias(f"{mark}live")))
    none = F.array().cast(f"array<{SPAN}>")
    waited = held.where(some).join(wanted, F.col(f"{mark}id") == F.col(f"{mark}uid"), "left").select(
        *held.columns, F.concat(f"{mark}base", F.coalesce(f"{mark}live", none)).alias(f"{mark}all"))
    rows = held.where(~some).withColumn(f"{mark}all", F.col(f"{mark}base")).union(waited)
    reported = F.col(f"{mark}all")
    changed = F.when(F.size(reported) > 0, redact(text, reported)).otherwise(F.col("text"))
    out = rows.withColumn("text", changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(reported) > 0, F.length("text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
