"""Registered queries against DuckDB, and the streaming assembler."""

import duckdb
import pytest

from sievedom.plans import catalogue, dom_queries, row_queries  # noqa: F401
from sievedom.streaming.chunks import assemble_stream
from sievedom.plans.ship import ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("pages", "documents", "events", "part", "supplier"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(str([r[c] for c in cols]) for r in got.collect())
    assert rows
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols and rows == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_census(spark, duck):
    """Against a walk over each parsed page, and for tags that the parser adds nothing to against the source."""
    from collections import Counter

    from sievedom.functions.dom import parse

    pages = [h for (h,) in duck.sql("select html from pages").fetchall()]
    found = [Counter(n.name for n in parse(h).walk() if n.type == 1) for h in pages]
    got = {r.tag: (r.n, r.n_docs) for r in catalogue.QUERIES["tag_census"](spark, SF).collect()}
    assert got == {t: (sum(f[t] for f in found), sum(t in f for f in found)) for t in set().union(*found)}
    for tag in ("a", "article", "div", "h1", "li", "nav", "p", "script", "title", "ul", "br"):
        assert got[tag][0] == sum(h.count(f"<{tag}>") + h.count(f"<{tag} ") for h in pages)


def test_stream(spark, tmp_path):
    ship(spark)
    parts = [(1, 0, "<p>a<", False), (2, 0, "x", False), (1, 1, "/p>", True)]
    spark.createDataFrame(parts, "doc_id long, seq int, chunk string, is_last boolean").write.parquet(str(tmp_path / "in"))
    stream = assemble_stream(spark.readStream.schema("doc_id long, seq int, chunk string, is_last boolean").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("whole").collect()] == [(1, "<p>a</p>")]
