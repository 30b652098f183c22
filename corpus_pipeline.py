"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but
the last return the columns of ``documents``, whatever others there are and
whatever their names.  Columns can be null: a null text counts as empty, a null
id comes after others, a null source is a source of its own.  Rows that repeat
are rows like others.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievedom.llm import exact, mixing, ngram_join, packing, quality
from sievedom.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; a null, empty or short text is rejected."""
    return quality.good_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of smallest id stays; of rows with one id the first of the scan."""
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at a Jaccard similarity of 0.8 over 5-word shingles the row of smallest id stays; an empty text links with nothing."""
    return ngram_join.one_of_each(docs, k=5, similarity=(80, 100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a source's documents can be left out, and can be there up to three times."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences; a null or empty text is its end id."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("exact", exact_dedup), ("near", near_dedup), ("mix", mix), ("pack", pack)]

#: Shingle graphs, seeded samples and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
