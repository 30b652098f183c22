"""Parsed documents as rows, and tree navigation as joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dom import COMMENT, DOCUMENT, ELEMENT, TEXT, Node, parse
from ..plans.ship import ship

SCHEMA = (
    "doc_id long, tree_id int, host_tree_id int, template_host_id int, doc_order int, doc_last int, node_id int, parent_id int, pos int, depth int, last_desc int, node_type byte, tag string, ns string, "
    "attrs array<struct<name:string,value:string>>, text string"
)
TREE = ["doc_id", "tree_id"]
#: Pages whose rows are put together as one Arrow batch.
PAGES = 64


NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
_ARROW = [
    pa.int64(), *[pa.int32()] * 10, pa.int8(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.string(),
]
_ORDER, _LAST, _PARENT, _INNER = (NAMES.index(c) for c in ("doc_order", "doc_last", "parent_id", "last_desc"))


def node_rows(doc_id: int, root: Node) -> Iterator[dict]:
    """A document's nodes in preorder; tree 0 is the document, each template's content a tree of its own.

    doc_order is the place in the whole document, where a template's content
    stands in its template, and doc_last that of the last node inside.
    """
    for r in node_values(doc_id, root):
        row = dict(zip(NAMES, r, strict=True))
        if row["attrs"] is not None:
            row["attrs"] = [{"name": a, "value": v} for a, v in row["attrs"]]
        yield row


def node_values(doc_id: int, root: Node) -> Iterator[list]:
    """The rows of ``node_rows`` as values in the order of the schema, attributes as pairs."""
    trees, no, whole = [(root, None, None)], 0, []
    while no < len(trees):
        top, host_tree, host = trees[no]
        rows: list[list] = []
        stack: list[tuple[Node | None, int | None, int, int]] = [(top, None, 0, 0)]
        while stack:
            n, parent, pos, depth = stack.pop()
            if n is None:
                rows[pos][_LAST] = rows[pos][_INNER] = len(rows) - 1
                continue
            at, kind = len(rows), n.type
            own = (n.name, n.ns, n.attrs, None) if kind == ELEMENT else (None, None, None, n.data if kind == TEXT or kind == COMMENT else None)
            rows.append([doc_id, no, host_tree, host, at, at, at, parent, pos, depth, at, kind, *own])
            if n.content is not None:
                trees.append((n.content, no, at))
            if n.children:
                stack.append((None, None, at, 0))
                stack.extend([(c, at, i, depth + 1) for i, c in enumerate(n.children)][::-1])
        whole.append(rows)
        no += 1
    if no > 1:
        _number(whole)
    for rows in whole:
        yield from rows


def _number(trees: list[list[list]]) -> None:
    """doc_order and doc_last of a document with templates."""
    inside = {(rows[0][2], rows[0][3]): no for no, rows in enumerate(trees)}
    order, stack = 0, [(0, 0, False)]
    while stack:
        no, at, done = stack.pop()
        rows = trees[no]
        while True:
            if not done:
                rows[at][_ORDER] = order
                order += 1
                content = inside.get((no, at))
                if content is not None:
                    stack += [(no, at, True), (content, 0, False)]
                    break
            done, at = False, at + 1
            if at == len(rows):
                break
    last = {}
    for no in range(len(trees) - 1, -1, -1):  # contents lie in later trees than their templates
        rows = trees[no]
        for i in range(len(rows) - 1, -1, -1):
            content = inside.get((no, i))
            ends = [rows[i][_ORDER], *([last[content]] if content is not None else [])]
            rows[i][_LAST] = max(ends)
        for i in range(len(rows) - 1, 0, -1):
            up = rows[rows[i][_PARENT]]
            up[_LAST] = max(up[_LAST], rows[i][_LAST])
        last[no] = rows[0][_LAST]


def parse_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``dom_nodes``: a row for each node of each page.  A null page has none.

    That no doc_id is null is said once more of the rows: a join by it would put
    that condition under one of its sides only, and pages that both sides are
    made of would be parsed and dealt twice.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PAGES):
                part = b.slice(i, PAGES)
                rows = [r for d, h in zip(*(c.to_pylist() for c in part.columns), strict=True) if h is not None for r in node_values(d, parse(h))]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=NAMES)

    return pages.select(F.col(id_col).cast("long").alias("d"), F.col(html_col).alias("h")).where("d is not null").mapInArrow(run, SCHEMA).where("doc_id is not null")


def elements(nodes: DataFrame, tag: str | None = None) -> DataFrame:
    out = nodes.where(F.col("node_type") == ELEMENT)
    return out if tag is None else out.where(F.col("tag") == tag)


def attribute_of(name: str):
    """The value of an attribute of the row's element, null where it is not there."""
    return F.get(F.transform(F.filter("attrs", lambda a: a["name"] == name), lambda a: a["value"]), F.lit(0))


def text_of(nodes: DataFrame, roots: DataFrame, name: str = "content") -> DataFrame:
    """Adds to some element rows the text below them, in document order."""
    texts = nodes.where(F.col("node_type") == TEXT).select(*TREE, F.col("node_id").alias("_n"), F.col("text").alias("_t"))
    keys = [*TREE, "node_id", "last_desc"]
    held = roots.select(*keys).join(texts.hint("merge"), TREE).where("_n > node_id and _n <= last_desc")
    joined = held.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"]), "").alias(name))
    return roots.join(joined.hint("merge"), keys, "left").withColumn(name, F.coalesce(name, F.lit("")))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds node ids of neighbours, and of the first and last child of the parent, among elements."""
    w = W.partitionBy(*TREE, "parent_id").orderBy("pos")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = elements(nodes)
    return e.select(
        "*", F.lag("node_id").over(w).alias("previous_id"), F.lead("node_id").over(w).alias("next_id"), F.first("node_id").over(whole).alias("first_id"), F.last("node_id").over(whole).alias("last_id"),
        F.row_number().over(w).alias("child_no"),
    )


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs of a row of ``of`` and each element above it."""
    up = elements(nodes).select(*TREE, F.col("node_id").alias("ancestor_id"), F.col("last_desc").alias("_last"), F.col("tag").alias("ancestor_tag"), F.col("depth").alias("ancestor_depth"))
    return of.select(*TREE, "node_id").join(up.hint("merge"), TREE).where("ancestor_id < node_id and node_id <= _last").drop("_last")


def tag_census(nodes: DataFrame) -> DataFrame:
    return elements(nodes).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


assert DOCUMENT == 9
