"""How work is dealt: more input makes more tasks, not longer ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievedom.functions import columns as C
from sievedom.functions import dom, edits, transform
from sievedom.plans import catalogue, dom_queries, row_queries  # noqa: F401
from sievedom.sources import html as H

KEYS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture(autouse=True)
def session(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def many(spark, tmp_path):
    """Parts in one file, one partition of it."""
    p = spark.range(60_000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(7).alias("p_size"))
    p.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_tasks_follow_rows(spark, many):
    sizes = [n for (n,) in dom_queries._parts(spark, many).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 12 and max(sizes) < 2 * H.TASK_ROWS


@pytest.mark.parametrize("name", ["finding", "texts", "css_rulesets", "fragments", "dataset", "insert_adjacent", "clone_and_replace", "minifying"])
def test_part_queries_are_dealt(spark, many, name):
    """One file of parts is not one task."""
    assert catalogue.QUERIES[name](spark, many).rdd.getNumPartitions() == 12


def test_long_texts_and_batches(spark):
    rows = spark.range(2_000).select("id", F.repeat(F.lit("<p>text</p>"), 5_000).alias("html")).coalesce(1)
    dealt = H.spread(rows)
    assert dealt.rdd.getNumPartitions() == -(-2_000 * 55_000 // H.TASK_BYTES)
    assert int(spark.conf.get(KEYS[0])) >= -(-2_000 * 10_000 // H.TASK_MARKS)
    assert (spark.conf.get(KEYS[2]), spark.conf.get(KEYS[3])) == (str(H.BATCH_ROWS), str(H.BATCH_BYTES))


def test_small_inputs_keep_the_session(spark):
    before = [spark.conf.get(k) for k in KEYS[:2]]
    assert H.spread(spark.createDataFrame([], "a long, b string")).count() == 0
    assert H.spread(spark.createDataFrame([(1, None), (1, None)], "a long, b string")).count() == 2
    assert [spark.conf.get(k) for k in KEYS[:2]] == before


def test_readings(spark, monkeypatch):
    """Each as its own function says, from one parse of the document."""
    pages = ["<ul><li id=a>x</li></ul>", "", "<p>no</p>", None]
    asked = {"text": ("string", lambda d: transform.text_content(d, "#a")), "up": ("int", lambda d: edits.position(d, "li", "ul")), "bad": ("string", lambda d: {}["k"])}
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", C.readings(F.col("h"), **asked).alias("r")).orderBy("i").collect()
    assert [r.r and tuple(r.r) for r in got] == [("x", 10, None), (None, None, None), (None, None, None), None]
    doc, seen = dom.parse(pages[0]), Counter()
    monkeypatch.setattr(transform, "parse", lambda h: seen.update(n=1)), monkeypatch.setattr(edits, "parse", lambda h: seen.update(n=1))
    assert edits.matches(doc, "#a", "ul > li") and edits.filtered(doc, "li", "#a") == transform.select_all(doc, "li") and transform.inner(doc, "ul") == transform.outer(doc, "li")
    assert edits.names(doc, "li")["tag"] == "LI" and edits.dataset(doc, "li") == {} and edits.is_empty(doc, "li") is False and not seen


@pytest.mark.parametrize("name", ["part_cascade", "rows_to_pages", "row_tidying", "part_edits", "row_subtrees", "page_titles", "list_positions"])
def test_rows_are_not_broadcast(spark, name, capsys):
    """A join with a row for each document or node shuffles, however small the files that they are from; rules of distinct sheets may be broadcast."""
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").explain("simple")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= (2 if name == "part_cascade" else name == "row_tidying")


def test_chains_parse_no_more_often_than_short_ones(spark, capsys):
    """A cascade's plan has the pages once for elements, once for sheets and once for style attributes, whatever its selectors."""
    from sievedom.operators import cascade
    from sievedom.operators import nodes as N

    for sheet in ("p{top:0}", "body div ul > li + li ~ li p{top:0}"):
        cascade.cascaded(N.parse_nodes(spark.createDataFrame([(1, f"<style>{sheet}</style><p>x</p>")], "page_id long, html string"))).explain("simple")
        assert 0 < capsys.readouterr().out.split("Initial Plan")[0].count("MapInPandas") <= 4


def test_batches_of_functions_are_bounded(spark):
    """What a function on documents holds at once, by rows and by bytes, does not grow with the table."""
    import pandas as pd

    @F.pandas_udf("long")
    def held(column: pd.Series) -> pd.Series:
        return pd.Series([len(column)] * len(column))

    short = spark.range(30_000).select("id", F.lit("<p>x</p>").alias("html")).coalesce(1)
    assert H.spread(short).select(held("html").alias("n")).agg(F.max("n")).first()[0] <= H.BATCH_ROWS


def _plan(df, capsys):
    df.explain("simple")
    return capsys.readouterr().out.split("Initial Plan")[0]


@pytest.fixture
def few(spark):
    from sievedom.operators import nodes as N

    return N.parse_nodes(spark.createDataFrame([(1, "<p>x<template><b>y</b></template></p>")], "page_id long, html string"))


def test_numbering_sorts_once(few, capsys):
    """Edited rows are numbered after one sort, whatever memory each further sort of doubled rows would take."""
    from sievedom.operators.editing import Editing

    plan = _plan(Editing.of(few).nodes(), capsys)
    assert plan.count("Sort [") == 1 and "Window" not in plan and "Generate" not in plan


def test_numbering_over_batches(spark):
    """A document whose rows lie in several Arrow batches is numbered as one."""
    from sievedom.operators import nodes as N
    from sievedom.operators.editing import Editing

    spark.conf.set(KEYS[2], "3")
    html = ["<p>a<b>c</b></p><template><i>d</i><template><u>e</u></template></template><ul><li>f<li>g</ul>", "", "<p>h", "<div>" * 40]
    nodes = N.parse_nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    rows = lambda df: sorted(df.collect(), key=str)
    assert rows(Editing.of(nodes).nodes()) == rows(nodes)


def test_policy_deals_twice(few, capsys):
    """Rows are dealt by document once before what Python judges and once after, and go through Python once."""
    from sievedom.functions.sanitizer import Config
    from sievedom.operators import policing, serialising

    plan = _plan(serialising.documents(policing.clean_rows(few, Config.preset("strict"))), capsys)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1 and plan.count("Sort [") == 3


@pytest.mark.parametrize("name", ["texts", "dataset", "insert_adjacent", "clone_and_replace"])
def test_part_queries_parse_once(spark, many, name, capsys):
    """One function has the document, so it is parsed once for all columns made of it."""
    plan = _plan(catalogue.QUERIES[name](spark, many), capsys)
    assert sum(1 for line in plan.splitlines() if "ArrowEvalPython" in line) == 1
    assert plan.split("ArrowEvalPython [")[1].split("], ")[0].count("wrapped(html") == 1 and "batch(html" not in plan


def test_fragments_parse_once(spark, many, capsys):
    """Of a built page, root and title are read and a new title is set by one function."""
    plan = _plan(catalogue.QUERIES["fragments"](spark, many), capsys)
    assert plan.count("wrapped(concat(<title>") == 1


def test_equal_rows_are_one_call(spark):
    """A function of equal values in one batch is called once, one of structs for each; null arguments stay null."""
    calls = spark.sparkContext.accumulator(0)

    def f(x):
        calls.add(1)
        return x and str(x)

    rows = spark.range(300).coalesce(1).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("s"))
    got = rows.select("id", C._text(f, F.col("s")).alias("t")).collect()
    assert all(r.t == (str(r.id % 3) if r.id % 3 else None) for r in got) and calls.value == 2
    assert [r.t for r in spark.range(2).coalesce(1).select(C._text(lambda a: "x" * len(a), F.array(F.lit(1), F.lit(2))).alias("t")).collect()] == ["xx", "xx"]


def test_readings_with_columns(spark):
    """A change is made to a copy, so that the other functions see the document as it was; a null column makes one reading null."""
    asked = {"a": ("string", lambda d, x: edits.set_text(d, "p", x), F.col("x")), "b": ("string", lambda d: edits.clone(d, "template")), "c": ("string", lambda d, x, y: x + y, F.col("x"), F.col("y")), "d": ("string", lambda d: dom.outer_html(d))}
    page = "<p>t</p><template><i>u</i></template>"
    got = spark.createDataFrame([(1, page, "n", None), (2, page, None, "m"), (3, None, "n", "m")], "i int, h string, x string, y string").orderBy("i").select(C.readings(F.col("h"), **asked).alias("r")).collect()
    whole = "<html><head></head><body>{}<template><i>u</i></template>{}</body></html>"
    twice = whole.format("<p>t</p>", "<template><i>u</i></template>")
    assert [r.r and tuple(r.r) for r in got] == [(whole.format("<p>n</p>", ""), twice, None, whole.format("<p>t</p>", "")), (None, twice, None, whole.format("<p>t</p>", "")), None]


@pytest.mark.parametrize("page", ["<p>a<b>c</b>", "<template><i>d</i><template><u>e</u></template></template>", "<b>1<p>2</b>3</p><svg><a x=1 y=2>", "<style>p>q</style><!--c-->", "<div>" * 3000 + "x"])
def test_copies(page):
    """A copy has all of a document, however deep, and nothing in common with it."""
    doc = dom.parse(page)
    whole, new = dom.outer_html(doc), dom.copy_of(doc)
    assert dom.outer_html(new) == whole and all(c.parent is n for n in new.walk() for c in n.children) and not {id(n) for n in new.walk()} & {id(n) for n in doc.walk()}
    dom.root_of(new).children.clear()
    assert dom.outer_html(doc) == whole
    assert edits.insert_adjacent(doc, "body", "afterbegin", "<b onclick=x>n</b>") == edits.insert_adjacent(page, "body", "afterbegin", "<b onclick=x>n</b>") and dom.outer_html(doc) == whole


def test_presets_parse_once(spark, capsys):
    """Pages are parsed once for all presets, in one function whose batches are bounded."""
    plan = _plan(catalogue.QUERIES["sanitize_structure"](spark, "/root/testdata/sf0.001"), capsys)
    assert "wrapped(html" in plan and "batch(html" not in plan


def test_long_pages_are_dealt(spark, tmp_path):
    """Pages in one file make as many tasks as their bytes ask for, however few rows they are."""
    spark.range(3_000).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>text</p>"), 2_000).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert catalogue._pages(spark, str(tmp_path)).rdd.getNumPartitions() == -(-3_000 * 22_000 // H.TASK_BYTES)


@pytest.mark.parametrize("name", ["rows_to_pages", "row_tidying"])
def test_rows_are_parsed_once(spark, name, capsys):
    """Both sides of a join of what is made of the same rows have one parse and one exchange."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").explain("simple")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert capsys.readouterr().out.count("MapInArrow run(") == 1


def test_pages_over_batches(spark):
    """A page whose rows lie in several Arrow batches is written as one, and the parts of it with it."""
    from sievedom.operators import nodes as N
    from sievedom.operators import serialising

    spark.conf.set(KEYS[2], "3")
    html = ["<p title='a\"&'>a<b>c &amp; d</b></p><template><style>x>y</style><i>d<!--e--></i><template><u>e</u></template></template><ul><li>f<br><li>g</ul>", "", "<style>p>q</style>h", "<div>" * 40]
    nodes = N.parse_nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    whole = {i: dom.outer_html(dom.parse(h)) for i, h in enumerate(html)}
    assert {r.doc_id: r.html for r in serialising.documents(nodes).collect()} == whole
    inside = serialising.inner_html(nodes, F.col("tag").isin("i", "li", "br"), "inside", page="page").collect()
    assert sorted(r.inside for r in inside) == ["", "d<!--e-->", "f<br>", "g"] and {r.page for r in inside} == {whole[0]}


def test_presets_of_rows_deal_once(spark, capsys):
    """Several presets judge the same rows: one parse, one exchange by document and one pass of values through Python."""
    plan = _plan(catalogue.QUERIES["part_policy"](spark, "/root/testdata/sf0.001"), capsys)
    assert plan.count("MapInArrow run(") == 1 and plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("ArrowEvalPython") == 1


def test_presets_of_rows_over_batches(spark):
    """Each preset's pages are what the walker leaves, whatever lies in what it removes or unwraps, and however rows lie in Arrow batches."""
    from sievedom.functions.sanitizer import Config, sanitize
    from sievedom.operators import nodes as N
    from sievedom.operators import policing

    html = [
        "<p onclick=x style='color:red;behavior:url(x)'>a<script>1</script><frob>b<i>c</i><frob>d</frob></frob>e", "", "<template><object data=/a.pdf><b>x</b></object><template><embed src=/v.swf><u>y</u></template></template><!--c-->z",
        "<ul><li>1<svg><animate><a href=x>s</a></animate><circle r=1 fill='url(#a)'/></svg><li><style>p{color:red}</style></ul>", "<div>" * 30 + "<x-y>q</x-y>", "<math><mi mathcolor=red>m</mi><maction>y</maction></math>",
    ]
    configs = {"permissive": Config.preset("permissive"), "strict": Config.preset("strict"), "unwrapping": Config(replaceWithChildrenElements=("svg", "ul", "b"), comments=True)}
    spark.conf.set(KEYS[2], "3")
    nodes = N.parse_nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    got = sorted(tuple(r) for r in policing.clean_documents(nodes, configs, "by").select("doc_id", "by", "html").collect())
    assert got == sorted((i, n, sanitize(h, c)) for i, h in enumerate(html) for n, c in configs.items())
