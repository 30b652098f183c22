"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import rejoin, with_row_id, without_rows, written

#: A chunk ends at the first vowel-space-consonant place past SHORT characters, at LONG characters, or with the text.
SHORT, LONG = 2048, 8192
#: White space runs other than one space.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def chunk_pattern(short: int = SHORT, long: int = LONG) -> str:
    """Boundaries depend on the text around them only, so a shifted passage is cut at the same places."""
    return rf"(?s).{{{short},{long}}}?[aeiou]\x20[b-dfhst]|.{{1,{long}}}"


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, long: int = LONG, hash_bits: int = 64
) -> DataFrame:
    """One row for each row of ``docs`` with the group of equal texts it is in.

    Texts are equal when identical after each run of ASCII white space is one
    space; a null text counts as empty.  Each text is cut at content-defined
    places; a chunk's identifier is its 64-bit hash, verified over the corpus by
    length and SHA-256: where one hash stands for different chunks, these get
    numbers in addition.  Texts are then compared by their ordered identifier
    lists, so no text is moved, only its list.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and row_id (the row's
    number in the scan).  The row of smallest id stays; null ids come last, and
    of rows with equal id and text the first of the scan stays.  An empty table
    gives no rows; of other columns none is read, whatever their names.
    ``hash_bits`` below 64 weakens the hash (for tests).
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    chunk = F.transform(F.regexp_extract_all("_t", F.lit(chunk_pattern(short, long)), F.lit(0)), lambda c: F.struct(c.alias("c")))
    ids = F.transform(
        chunk,
        lambda s: F.struct(
            (F.xxhash64(s["c"]) if hash_bits >= 64 else F.xxhash64(s["c"]).bitwiseAND(F.lit((1 << hash_bits) - 1))).alias("h"),
            F.length(s["c"]).alias("n"),
            F.unhex(F.sha2(s["c"], 256)).alias("v"),
        ),
    )
    base = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), "row_id")
    rows = written(base.select("doc_id", "row_id", text.alias("_t")).select("doc_id", "row_id", F.sha2("_t", 256).alias("text_sha256"), ids.alias("_ids")))
    seen = rows.select(F.explode("_ids").alias("x")).groupBy("x.h", "x.n", "x.v").agg(F.lit(1).alias("one"))
    clash = written(seen.groupBy("h").count().where("count > 1").select("h"))
    if clash.isEmpty():
        rows = rows.withColumn("_fix", F.lit(None).cast("array<int>"))
    else:
        told = seen.join(clash, "h").withColumn("no", F.row_number().over(W.partitionBy("h").orderBy("n", "v")))
        told = told.select("h", "n", "v", "no")
        parts = rows.select("text_sha256", "_ids").dropDuplicates(["text_sha256"]).select("text_sha256", F.posexplode("_ids").alias("at", "x"))
        fix = (
            parts.select("text_sha256", "at", "x.*").join(told, ["h", "n", "v"])
            .groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("at", "no"))).alias("f"))
            .select("text_sha256", F.flatten(F.transform("f", lambda s: F.array(s["at"], s["no"]))).alias("_fix"))
        )
        rows = rejoin(rows, fix, ["text_sha256"])
    rows = rows.withColumn("_recipe", F.transform("_ids", lambda s: s["h"])).drop("_ids")
    groups = rows.groupBy("_recipe", "_fix").agg(
        F.min("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))["row_id"].alias("_keep_row"),
    )
    out = rejoin(rows, groups, ["_recipe", "_fix"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("_keep_row")).alias("kept"), "text_sha256", "row_id")


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of any names."""
    return without_rows(docs, exact_dedup(docs, **how).where(~F.col("kept")))
