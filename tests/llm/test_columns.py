"""Every operator and pipeline stage on tables with clashing names, nulls, repeated rows, or no rows."""

import pytest
from corpus_pipeline import STAGES
from pyspark.sql import functions as F

from sievedom.llm import exact, html_main, licenses, lm, mixing, ngram_join, packing, pii, quality, secrets

from . import cases

CLASHES = ("_n", "_h", "_x", "_t", "_src", "_row", "_row_id", "row_id", "SIZE", "_c0", "t", "node", "root", "class", "kept", "_again", "taken")
PROSE = "The small river runs past seven old mills, and nobody has counted how many boats were tied there since the bridge was closed in spring number {}."


def clashing(spark):
    docs = cases.frame(spark, [PROSE.format("one two three four") if i % 5 == 0 else PROSE.format(f"{i} {i * 7} {i * 11}") for i in range(40)] + ["", None, "short"])
    docs = docs.drop("size")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(100 + i) + F.coalesce("doc_id", F.lit(-1)))
    return docs


OPERATORS = [mixing.mix_sources, exact.exact_dedup, licenses.scan_licenses, ngram_join.jaccard_join, pii.find_pii, quality.quality_rules, secrets.scan_secrets, lm.score_documents, packing.pack]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_operators(spark, operator):
    docs = clashing(spark)
    got = operator(docs)
    assert len(set(map(str.lower, got.columns))) == len(got.columns)
    plain = operator(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    assert ids(got) == ids(plain)
    for name in set(docs.columns) & set(got.columns) - {"doc_id", "row_id", "kept", "taken", "root", "source_size"}:
        assert {(r[0], r[1]) for r in got.select("doc_id", name).collect()} <= {(r[0], r[1]) for r in docs.select("doc_id", name).collect()}


def test_page_operator(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hello there, reader.</p>", 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in html_main.extract_main(pages).collect()} == {1: "Hello there, reader.", None: ""}


@pytest.mark.parametrize(("name", "stage"), STAGES)
def test_stages(spark, name, stage):
    docs = clashing(spark)
    got = stage(spark, docs, cases.SMALL)
    if name != "pack":
        assert got.columns == docs.columns
        rows = {tuple(r) for r in docs.collect()}
        assert {tuple(r) for r in got.collect()} <= rows and got.count() > 0
    assert stage(spark, docs.limit(0), cases.SMALL).count() == 0


def test_stages_one_after_another(spark):
    """Equal and near texts go, whatever their other columns; short and empty ones do, too."""
    docs = clashing(spark)
    for name, stage in STAGES[:3]:
        docs = stage(spark, docs, cases.SMALL)
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts)) and "short" not in texts and "" not in texts and None not in texts
