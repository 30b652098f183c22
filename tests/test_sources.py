"""The node source against parsed rows, with what goes into it, and the sink under failing and repeated tasks."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievedom.operators import nodes as N
from sievedom.sources.document_sink import by_id, file_name
from sievedom.sources.node_source import read_nodes, register_sources

from .test_rows import ODD, SMALL


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    register_sources(spark)
    path = str(tmp_path_factory.mktemp("pages") / "t")
    real = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    real.union(spark.createDataFrame([(10_000 + i, h) for i, h in enumerate(ODD)], "page_id long, html string")).union(spark.createDataFrame([(None, "<p>x")], "page_id long, html string")).repartition(3).write.option("parquet.block.size", 20_000).parquet(path)
    return path


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_source_equals_parse(spark, table):
    """All columns, and every choice of plain or numbered ones, whatever the size of the parts."""
    want = N.parse_nodes(spark.read.parquet(table)).persist()
    assert rows(read_nodes(spark, table)) == rows(want)
    for split in (1_000, 7_000, 1 << 30):
        got = spark.read.format("dom_nodes").schema("doc_id long, tag string, attrs array<struct<name:string,value:string>>").option("split", split).load(table)
        assert rows(got) == rows(want.select("doc_id", "tag", "attrs"))
    for where in ("tag = 'a'", "tag in ('p', 'li') and doc_id >= 10", "node_type = 3 and doc_id < 10003", "doc_id in (1, 2, 10001) and tag is not null", "tag = 'a' and tag = 'b'", "tag is null", "length(tag) > 3 and node_type = 1", "tag = 'p' or doc_id = 3", "node_type in (8, 9)"):
        for columns in (["doc_id", "tag", "node_type"], ["node_type", "doc_id", "tag", "depth", "text"]):
            assert rows(read_nodes(spark, table, columns).where(where)) == rows(want.where(where).select(*columns)), where


def test_pushed(spark, table):
    """Conditions on tag, type and document are not evaluated again after the scan; others are."""
    plan = lambda where: read_nodes(spark, table, ["doc_id", "tag", "node_type"]).where(where)._jdf.queryExecution().executedPlan().toString()
    assert "dom_nodes" in plan("tag = 'a'") and "Filter (" not in plan("doc_id >= 10").split("BatchScan")[0]
    assert "= a" not in plan("tag = 'a'").split("BatchScan")[0] and "length" in plan("length(tag) > 3 and tag in ('a', 'title')").split("BatchScan")[0]
    with pytest.raises(Exception, match="no columns of nodes"):
        spark.read.format("dom_nodes").schema("x long").load(table).collect()


def files(path):
    return {p.name: p.read_bytes().decode() for p in Path(path).rglob("*.html") if "_staging" not in p.parts}


def test_sink(spark, tmp_path):
    register_sources(spark)
    out = str(tmp_path / "out")
    some = [(i, f"<p>{i}\r\n é</p>") for i in range(50)] + [(7, "again"), (8, None), (None, "no id")]
    df = spark.createDataFrame(some, "page_id long, html string").repartition(5)
    by_id(df, "page_id").write.format("html_files").mode("append").save(out)
    got = files(out)
    assert len(got) == 52 and got["id-3.html"] == "<p>3\r\n é</p>" and {got["id-7.html"], got["id-7~1.html"]} == {"<p>7\r\n é</p>", "again"} and got["null.html"] == "no id"
    assert json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"files": 52, "nulls": 1} and not any((tmp_path / "out" / "_staging").iterdir())
    by_id(df.limit(0), "page_id").write.format("html_files").mode("overwrite").save(out)
    assert files(out) == {}


def test_sink_fails_whole(spark, tmp_path):
    """A job with a task that fails shows none of its files, and leaves what was there before."""
    register_sources(spark)
    out = str(tmp_path / "out")
    df = spark.range(40).select(F.col("id"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("html"))
    by_id(df, "id").write.format("html_files").mode("append").save(out)
    bad = df.withColumn("html", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("html"))).repartition(4)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("html_files").mode("overwrite").save(out)
    assert len(files(out)) == 40 and not any((tmp_path / "out" / "_staging").iterdir())


def test_repeated_tries(tmp_path):
    """Tries of a task that fail half way, or that another try outran, leave nothing; each document is there once."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from sievedom.sources.document_sink import DocumentSink

    schema = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": "string", "nullable": True, "metadata": {}} for n in ("id", "html")]})
    batch = lambda *ids: pa.record_batch([pa.array(ids), pa.array([f"<p>{i}" for i in ids])], names=["id", "html"])
    writer = DocumentSink({"path": str(tmp_path)}).writer(schema, False)

    def breaks():
        yield batch("a", "b")
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    writer.write(iter([batch("a", "b", "c")]))  # a try that ended but was not taken
    taken = writer.write(iter([batch("a", "b"), batch("c")]))
    writer.commit([taken, None, writer.write(iter([]))])
    assert sorted(files(tmp_path)) == ["id-a.html", "id-b.html", "id-c.html"] and len(list(tmp_path.glob("part-*"))) == 1
    stream = DocumentSink({"path": str(tmp_path / "s")}).streamWriter(schema, False)
    stream.commit([stream.write(iter([batch("x")]))], 0)
    again = DocumentSink({"path": str(tmp_path / "s")}).streamWriter(schema, False)
    again.commit([again.write(iter([batch("x")]))], 0)  # the same batch after a restart
    again.commit([again.write(iter([batch("y")]))], 1)
    assert len(list((tmp_path / "s").rglob("*.html"))) == 2
    assert file_name("../a b") == "id-%2E%2E%2Fa%20b" and len(file_name("é" * 400)) < 160 and file_name("é" * 400) != file_name("é" * 401)


def test_stream_to_files(spark, tmp_path):
    register_sources(spark)
    spark.range(10).selectExpr("id", "concat('<p>', id) as html").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, html string").parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("html_files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    assert len(files(tmp_path / "out")) == 10
