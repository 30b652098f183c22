"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import numbered, written

#: Words by ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges into which a source's hash space is divided, twice over.
RANGE_BITS = 12


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_pos``, the place by code point (null last), without a single-task window."""
    low = (1 << 33) - 1
    at = written(
        sources.sort(F.col("_src").asc_nulls_last()).select(
            "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("_i")
        )
    )
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    # one row for each sort partition
    starts = at.groupBy("_pid").count().select("_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return at.join(F.broadcast(starts), "_pid").withColumn("_pos", F.col("_start") + F.col("_i")).drop("_pid", "_i", "_start")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> float:
    """The level at which sum(min(max_epochs * _size, level * _w)) is ``total``.

    A source is full when its cap lies below the level; each pass shares what
    full sources leave by the weights of the others, and the level only rises.
    """
    level = -1.0
    cap = F.col("_size") * F.lit(float(max_epochs))
    while True:
        full = cap < F.lit(level) * F.col("_w")
        taken, weight = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full & (F.col("_size") > 0), F.col("_w")).otherwise(0.0))
        ).first()
        if not weight:
            return max(level, 0.0)
        new = (total - taken) / weight
        if new <= level * (1 + 1e-12) + 1e-12:
            return new
        level = new


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    prefix: str = "",
) -> DataFrame:
    """All rows of ``docs`` with what a mix of its sources takes of each.

    The sources, by code point with null last, weigh ``weights``, repeating, and
    share ``share`` of all words; a source is clamped at ``max_epochs`` times
    its size and the excess goes to the others by weight.  A row's whole
    repetitions are the same throughout its source; the rest of the target goes
    to the rows of smallest seeded hash (of id and text), and the last of them
    gives the words that are still missing, so a source takes its target to
    within one word (or within one word for each wholly equal row).

    Adds, with ``prefix`` before the names: size, source_size, target, whole
    (repetitions), extra (words of one more, fractional repetition), taken.
    A column of ``docs`` with such a name, in any case, is replaced; all others
    stay as they are, whatever their names.  A null or empty text has
    size 0 and takes 0 words; an empty table gives no rows; rows that are equal
    throughout take the same; null sources are a source of their own.
    """
    given = docs.columns
    docs, names = numbered(docs)
    id_col, text_col, source_col = names[id_col], names[text_col], names[source_col]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 63) - 1))
    top = F.shiftright("_h", 63 - RANGE_BITS)
    mid = F.shiftright("_h", 63 - 2 * RANGE_BITS).bitwiseAND(F.lit((1 << RANGE_BITS) - 1))
    rows = written(docs.select(F.col(source_col).alias("_src"), size.alias("_n"), mark.alias("_h")))
    first = written(rows.groupBy("_src", top.alias("_b")).agg(F.sum("_n").alias("_n")))
    sources = _ranked(first.groupBy("_src").agg(F.sum("_n").alias("_size")))
    sources = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int")))
    total = sources.agg(F.sum("_size")).first()[0] or 0
    level = water_fill(sources, share * total, max_epochs)
    ratio = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    sources = (
        sources.withColumn("_target", F.least(F.col("_size") * float(max_epochs), F.col("_w") * level))
        .withColumn("_whole", F.floor(ratio + 1e-12))
        .withColumn("_rest", F.greatest(F.round(F.col("_target")).cast("long") - F.col("_whole") * F.col("_size"), F.lit(0)))
        .select("_src", "_size", "_target", "_whole", "_rest")
    )
    sources = written(sources)
    near = F.broadcast(sources) if sources.count() <= 100_000 else sources.hint("merge")

    def crossing(parts: DataFrame, by: Column) -> DataFrame:
        """The part of each source in which the running sum of words reaches _rest; _rest becomes what it must give."""
        upto = F.sum("_n").over(W.partitionBy("_src").orderBy(by))
        return parts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest"))).withColumn("_rest", F.col("_rest") - F.col("_upto") + F.col("_n"))

    same = F.col("_src").eqNullSafe(F.col("_s2"))
    open_ = near.where("_rest > 0").select(F.col("_src").alias("_s2"), "_rest")
    cut1 = crossing(first.join(open_, same).drop("_s2"), F.col("_b")).select(F.col("_src").alias("_s2"), F.col("_b").alias("_b1"), "_rest")
    inside = rows.join(cut1.hint("broadcast") if sources.count() <= 100_000 else cut1, same & (top == F.col("_b1"))).drop("_s2")
    second = inside.groupBy("_src", "_b1", "_rest", mid.alias("_b")).agg(F.sum("_n").alias("_n"))
    cut2 = crossing(second, F.col("_b")).select(F.col("_src").alias("_s2"), "_b1", F.col("_b").alias("_b2"), F.col("_rest").alias("_r2"))
    last = inside.drop("_rest", "_b1").join(cut2.hint("broadcast") if sources.count() <= 100_000 else cut2, same & (top == F.col("_b1")) & (mid == F.col("_b2")))
    each = last.groupBy("_src", "_h", F.col("_r2").alias("_rest")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_k"))
    cut3 = crossing(each, F.col("_h")).select(F.col("_src").alias("_s2"), F.col("_h").alias("_cut"), F.floor(F.col("_rest") / F.col("_k")).alias("_part"))
    plan = written(sources.join(cut3, same, "left").select("_src", "_size", "_target", "_whole", "_cut", "_part"))
    plan = plan.select(F.col("_src").alias("_s2"), *[F.col(c).alias(f"_p{c}") for c in plan.columns[1:]])
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan.hint("merge")
    out = docs.withColumn("_n", size).withColumn("_h", mark).join(plan, F.col(source_col).eqNullSafe(F.col("_s2")), "left")
    extra = F.when(F.col("_p_cut").isNull(), 0).when(F.col("_h") < F.col("_p_cut"), F.col("_n")).when(F.col("_h") == F.col("_p_cut"), F.least("_n", "_p_part")).otherwise(0).cast("long")
    out = out.withColumn("_x", extra)
    new = {
        "size": F.col("_n"),
        "source_size": F.col("_p_size"),
        "target": F.col("_p_target"),
        "whole": F.col("_p_whole").cast("long"),
        "extra": F.col("_x"),
        "taken": F.col("_p_whole").cast("long") * F.col("_n") + F.col("_x"),
    }
    replaced = {(prefix + k).lower() for k in new}
    kept = [F.col(names[c]).alias(c) for c in given if c.lower() not in replaced]
    return out.select(*kept, *[v.alias(prefix + k) for k, v in new.items()])


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    A last repetition counts as one if it takes at least half of the row's words.
    Columns stay as they are, whatever their names; an empty table gives none.
    """
    given = docs.columns
    docs, names = numbered(docs)
    for arg, usual in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")):
        how[arg] = names[how.get(arg, usual)]
    mixed = mix_sources(docs, prefix="_mix_", **how)
    times = F.col("_mix_whole") + F.when((F.col("_mix_extra") > 0) & (2 * F.col("_mix_extra") >= F.col("_mix_size")), 1).otherwise(0)
    out = mixed.select(*names.values(), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_again"))
    return out.select(*[F.col(names[c]).alias(c) for c in given])
