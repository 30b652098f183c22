"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import rejoin, with_row_id, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group of the secret, least characters of it.  A match of access or hex that is too short is inside no longer one.
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: What the method looks at besides: access tokens by their public prefixes, JSON web tokens, passwords in URLs, long base64 runs.
MORE = (
    (
        "live",
        r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[A-Za-z0-9+/]{40,}={0,2}",
        0,
        6,
    ),
    ("url", r"://[^\s:@/]*+:([^\s:@/]++)@", 1, 6),
)


#: What each pattern's texts have: one of these strings after lower-casing, or a run without white space as long as its shortest match.
_RUN = r"(?:^|\s)\S{20}"


def _gates(text: Column) -> dict[str, Column]:
    """Whether a text can have a match at all: searches for a fixed string, and one pass for long runs, save most texts the patterns."""
    low, run = F.lower(text), F.regexp_like(text, F.lit(_RUN))
    has = lambda s: F.contains(low, F.lit(s))
    return {
        "assign": has("passw") | has("secret") | has("token") | has("apikey") | has("api_key"),
        "access": has("akia"),
        "hex": run,
        "live": run | has("xox"),
        "url": has("://"),
    }


def _matches(text: Column, kind: str, pattern: str, group: int, gate: Column) -> Column:
    """Of each match: kind, code points before it since the last one, its own, those of the secret, and the secret's hash."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    made = F.transform(
        F.arrays_zip(whole.alias("m"), F.slice(gaps, 1, F.size(whole)).alias("g"), part.alias("v")),
        lambda s: F.struct(
            F.lit(kind).alias("kind"), F.length(s["g"]).alias("gap"), F.length(s["m"]).alias("n"),
            F.length(s["v"]).alias("n_value"), F.xxhash64(s["v"]).alias("vh"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,gap:int,n:int,n_value:int,vh:bigint>>")
    return F.when(gate & F.regexp_like(text, F.lit(pattern)), made).otherwise(none)


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_cols: tuple[str, ...] = ("source",),
    repo_cols: tuple[str, ...] = ("source", "lang"),
    example_owners: int = 3,
    example_repos: int = 6,
    more: tuple = MORE,
) -> DataFrame:
    """One row for each row of ``docs`` with the secrets in its text.

    Candidates are hashed and counted over the corpus by distinct owners and
    repositories.  One seen with ``example_owners`` owners or more, or with two
    and in ``example_repos`` repositories or more, is a widely copied example;
    others are specific to an owner.  Base spans always stay; a
    span of the method's own patterns stays only if it is owner-specific.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and
    n_example (spans by their value's class) and row_id.  Offsets are code
    points, ends exclusive.  A null or empty text has no spans; null owners
    count as one owner; rows that repeat are counted each for itself; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    kinds = [k for k, *_ in BASE] + [k for k, *_ in more]
    text = F.coalesce(F.col("_t"), F.lit(""))
    key = lambda cols: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    base = with_row_id(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), key(owner_cols).alias("owner"), key(repo_cols).alias("repo")), "row_id"
    )
    none = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("n"), F.lit(0).alias("n_value"), F.lit(0).cast("long").alias("vh")))
    gates, known = _gates(text), {(k, p) for k, p, *_ in (*BASE, *MORE)}
    found = F.concat(none, *[_matches(text, k, p, g, gates[k] if (k, p) in known else F.lit(True)) for k, p, g, _ in (*BASE, *more)])
    rows = base.select("row_id", "doc_id", "owner", "repo", F.posexplode(found).alias("no", "x")).select("row_id", "doc_id", "owner", "repo", "no", "x.*")
    along = W.partitionBy("row_id", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(along)).withColumn("start", F.col("end") - F.col("n"))
    least = F.create_map(*[F.lit(x) for k, _, _, n in (*BASE, *more) for x in (k, n)])
    rows = written(rows.where((F.col("kind") == "") | (F.col("n_value") >= least[F.col("kind")])).select("row_id", "doc_id", "owner", "repo", "kind", "start", "end", "vh"))
    spans = rows.where("kind <> ''")
    freq = (
        spans.select("vh", "owner", "repo").distinct()
        .groupBy("vh", "owner").agg(F.count("*").alias("repos"))
        .groupBy("vh").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    judged = rejoin(rows.drop("owner", "repo"), freq, ["vh"])
    judged = judged.withColumn("example", (F.col("owners") >= example_owners) | (F.col("owners") >= 2) & (F.col("repos") >= example_repos))
    is_base = F.col("kind").isin(*[k for k, *_ in BASE])
    stays = is_base | ((F.col("kind") != "") & ~F.col("example"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    entry = F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end")
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    out = judged.groupBy("row_id", "doc_id").agg(
        *[count(F.col("kind") == k).alias(f"n_{k}") for k, *_ in BASE],
        F.collect_list(F.when(is_base, entry)).alias("_base"),
        F.collect_list(F.when(stays, entry)).alias("_all"),
        count(stays & ~F.col("example")).alias("n_live"),
        count((F.col("kind") != "") & F.col("example")).alias("n_example"),
    )
    return out.select("doc_id", *[f"n_{k}" for k, *_ in BASE], F.sha2(said("_base"), 256).alias("base_sha256"), said("_all").alias("spans"), "n_live", "n_example", "row_id")
