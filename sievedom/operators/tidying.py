"""Merging texts and minifying on ``dom_nodes`` rows, as gaps and islands among siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dom import COMMENT, ELEMENT, TEXT
from ..functions.transform import PRESERVE
from .nodes import TREE


def merged_texts(nodes: DataFrame) -> DataFrame:
    """Texts without another node between them as one, in the place of the first; empty ones go.

    Other children of one parent cut its texts into islands, which are numbered
    by a running count; each island's texts are put together by one window.  Rows
    that lost nodes between texts, as comments, are merged as the tree would be.
    """
    family = [*TREE, "parent_id"]
    text = F.col("node_type") == TEXT
    rows = nodes.withColumn("_island", F.sum(F.when(text, 0).otherwise(1)).over(W.partitionBy(*family).orderBy("node_id")))
    some = rows.withColumn("_some", text & (F.col("text") != ""))
    island = W.partitionBy(*family, "_island", "node_type").orderBy("node_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = F.array_join(F.collect_list(F.when(F.col("_some"), F.col("text"))).over(island), "")
    first = F.min(F.when(F.col("_some"), F.col("node_id"))).over(island)
    out = some.withColumn("_whole", F.when(text, whole)).withColumn("_first", F.when(text, first)).where(~text | (F.col("node_id") == F.col("_first")))
    return out.select(*[F.when(text, F.col("_whole")).otherwise(F.col("text")).alias("text") if c == "text" else c for c in nodes.columns])


def minified(nodes: DataFrame, comments: bool = False, display: bool = False) -> DataFrame:
    """Without texts of only line feeds and tabs (``display``: of any white space) outside elements that keep it, and without comments unless kept; a document's rows are in one partition then."""
    held = (F.col("node_type") == ELEMENT) & F.col("tag").isin(*sorted(PRESERVE))
    before = W.partitionBy(*TREE).orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    inside: Column = F.coalesce(F.max(F.when(held, F.col("last_desc"))).over(before) >= F.col("node_id"), F.lit(False))
    blank = F.regexp_like(F.coalesce("text", F.lit("x")), F.lit(r"\A[ \t\n\r]*\z" if display else r"\A[\t\n\r]*\z"))
    outside = (F.col("tree_id") == 0) & (F.col("depth") == 1) & (F.col("node_type") != ELEMENT)
    gone = (F.col("node_type") == TEXT) & ~F.col("_inside") & blank | outside
    if not comments:
        gone = gone | (F.col("node_type") == COMMENT)
    return nodes.repartition("doc_id").withColumn("_inside", inside).where(~gone).drop("_inside")
