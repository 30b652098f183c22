"""Edits on labelled rows against the same edits on parsed trees."""

import random

import pytest
from pyspark.sql import functions as F

from sievedom.functions.dom import ELEMENT, TEXT, Node, outer_html, parse, parse_fragment, root_of
from sievedom.functions.edits import WHERE, copied
from sievedom.operators import nodes as N
from sievedom.operators import serialising
from sievedom.operators.editing import Editing

from .test_rows import MORE, ODD, SMALL

TAGS = ["p", "li", "b", "div", "ul", "td", "template", "i", "svg", "a", "h1", "nav", "circle", "script", "pre"]
PIECE = '<q title="{n}">a{n}<i>b</i></q>tail<template><b>{n}</b></template>'


def everything(n: Node):
    """All nodes below a node in the order of the document, contents of templates among them."""
    for c in [*(n.content.children if n.content else []), *n.children]:
        yield c
        yield from everything(c)


def held_by(n: Node, above: Node) -> bool:
    return any(x is n for x in everything(above))


def put(e: Node, where: str, new: list[Node], holders: dict) -> None:
    inside = where in ("afterbegin", "beforeend")
    holder = (e.content or e) if inside else holders[id(e)]
    at = {"beforebegin": lambda: index(holder, e), "afterbegin": lambda: 0, "beforeend": lambda: len(holder.children), "afterend": lambda: index(holder, e) + 1}[where]()
    holder.children[at:at] = new


def index(holder: Node, e: Node) -> int:
    return next(i for i, c in enumerate(holder.children) if c is e)


def holders_of(doc: Node) -> dict:
    found, todo = {}, [doc]
    while todo:
        n = todo.pop()
        for part in (n, n.content):
            for c in part.children if part else []:
                found[id(c)] = part
                todo.append(c)
    return found


def on_tree(doc: Node, step: tuple) -> None:
    kind, tag, other, where, first = step
    holders = holders_of(doc)
    found = [n for n in everything(doc) if n.type == ELEMENT and n.name == tag][: 1 if first and kind != "attribute" else None]
    outermost = [n for n in found if not any(held_by(n, m) for m in found if m is not n)]
    out = lambda n: holders[id(n)].children.remove(n)
    if kind == "insert":
        for e in found:
            put(e, where, list(parse_fragment(PIECE.replace("{n}", tag)).children), holders)
    elif kind == "remove":
        for e in outermost:
            out(e)
    elif kind == "unwrap":
        for e in reversed(found):
            holder = holders_of(doc)[id(e)]
            at = index(holder, e)
            holder.children[at : at + 1] = e.content.children if e.content else e.children
    elif kind == "wrap":
        for e in found:
            holder = holders_of(doc)[id(e)]
            w = Node(ELEMENT, "section", attrs=[("k", "v")])
            w.children = [e]
            holder.children[index(holder, e)] = w
    elif kind == "hollow":
        for e in outermost:
            (e.content or e).children = []
    elif kind == "attribute":
        for e in found:
            e.attrs = [(a, v) for a, v in e.attrs if a != "class"] if first else [*e.attrs, ("data-z", tag)]
    elif kind in ("replace_with", "replace_children"):
        for e in outermost:
            new = list(parse_fragment(PIECE.replace("{n}", tag)).children)
            if kind == "replace_with":
                put(e, "beforebegin", new, holders)
                out(e)
            else:
                (e.content or e).children = new
    else:
        anchors = [n for n in everything(doc) if n.type == ELEMENT and n.name == other and not any(n is m or held_by(n, m) for m in found)]
        if anchors:
            copies = [copied(e) for e in outermost] if kind == "clone" else outermost
            if kind == "move":
                for e in outermost:
                    out(e)
            put(anchors[0], where, copies, holders)


def on_rows(e: Editing, step: tuple) -> Editing:
    kind, tag, other, where, first = step
    t, o = F.col("tag") == tag, F.col("tag") == other
    if kind in ("replace_with", "replace_children"):
        return getattr(e, kind)(t, PIECE, {"n": F.col("tag")}, first)
    return {
        "insert": lambda: e.insert(t, where, PIECE, {"n": F.col("tag")}, first), "remove": lambda: e.remove(t, first), "unwrap": lambda: e.unwrap(t, first), "wrap": lambda: e.wrap(t, "section", {"k": "v"}, first),
        "hollow": lambda: e.hollow(t, first), "move": lambda: e.move(t, o, where, first), "clone": lambda: e.clone(t, o, where, first),
        "attribute": lambda: e.set_attribute(t, "class", None) if first else e.set_attribute(t, "data-z", F.col("tag")),
    }[kind]()


KINDS = ["insert", "move", "clone", "wrap", "remove", "hollow", "replace_with", "replace_children", "attribute", "move", "unwrap"]


def chain(seed: int) -> list[tuple]:
    r = random.Random(seed)
    some = []
    for i in range(5):
        kind = KINDS[(seed + i * 3) % len(KINDS)]
        tag = r.choice(TAGS)
        first = kind == "attribute" and r.random() < 0.5 or kind != "attribute" and r.random() < 0.3
        some.append((kind, tag, r.choice([t for t in TAGS if t != tag]), r.choice(WHERE), first))
    return some


@pytest.fixture(scope="module")
def html(spark):
    real = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect() if r.html is not None][:10]
    return [h for h in ODD if h is not None and "<div>" * 99 not in h] + MORE + real


@pytest.fixture(scope="module")
def nodes(spark, html):
    return N.parse_nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string").repartition(4)).persist()


def test_numbered_again(nodes):
    """Without edits the rows come back as they were, but for numbers of trees where templates are nested."""
    want = {tuple(map(str, r)) for r in nodes.where("doc_id <> 1").collect()}
    got = {tuple(map(str, r)) for r in Editing.of(nodes.where("doc_id <> 1")).nodes().select(*nodes.columns).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(8))
def test_chains(nodes, html, seed):
    """Five random edits give the page that the tree gives, and rows as a parser would number them."""
    steps = chain(seed)
    edited = Editing.of(nodes)
    for s in steps:
        edited = on_rows(edited, s)
    rows = edited.nodes().persist()
    got = {r.doc_id: r.html for r in serialising.documents(rows).collect()}
    for i, h in enumerate(html):
        doc = parse(h)
        for s in steps:
            on_tree(doc, s)
        assert got[i] == outer_html(root_of(doc)), (steps, h)
    for r in rows.where("tree_id = 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "parent_id", "depth", "pos", "last_desc", "node_type"))).alias("all")).collect():
        open_rows = []
        for at, n in enumerate(r["all"]):
            while open_rows and open_rows[-1].last_desc < at:
                open_rows.pop()
            assert n.node_id == at and n.depth == len(open_rows) and n.parent_id == (open_rows[-1].node_id if open_rows else None)
            open_rows.append(n)
    rows.unpersist()


def test_no_join_one_exchange(nodes):
    """A chain's plan has no join, and its windows share the exchange by document."""
    t = F.col("tag") == "p"
    plan = Editing.of(nodes).insert(t, "afterend", "<hr>").remove(F.col("tag") == "nav").move(t, F.col("tag") == "ul", "afterend").wrap(t, "div").rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_refusals_and_small_cases(spark, nodes):
    with pytest.raises(ValueError):
        Editing.of(nodes).insert(F.col("tag") == "p", "nowhere", "<b>")
    empty = Editing.of(nodes.limit(0)).insert(F.col("tag") == "p", "afterend", "<b>").nodes()
    assert empty.columns == nodes.columns and empty.count() == 0
    mark = nodes.where("doc_id = 0").withColumn("price", F.lit(None).cast("int"))
    kept = Editing.of(mark).insert(F.col("tag") == "ul", "beforeend", "<u>{p}</u>{q}", {"p": F.col("price"), "q": F.lit("<b>&")}).nodes()
    assert "price" in kept.columns and "<u></u>&lt;b&gt;&amp;" in serialising.documents(kept).first().html
    assert serialising.documents(Editing.of(mark).remove(F.lit(True)).nodes()).count() == 0
    assert TEXT == 3
