"""HTML and text of whole documents and of elements from ``dom_nodes`` rows.

Each node is one event, each element that can hold something a second one where
it ends.  In the order of the document they are the page, so a page is one sort
of its own rows and one look at each, with a stack of ends to come; an element's
HTML or text is the part of its page's between its two events: no node is joined
with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dom
from ..functions.dom import COMMENT, ELEMENT, HTML, TEXT, VOID, _RAW_OUT
from ..plans.ship import ship

_EVENT = "array<struct<at:int,end:int,deep:int,piece:string>>"


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def open_tag(attrs: Column | str = "attrs") -> Column:
    values = F.transform(attrs, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), F.replace(_escaped(a["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"')))
    return F.concat(F.lit("<"), F.col("tag"), F.array_join(values, ""), F.lit(">"))


def with_raw(nodes: DataFrame) -> DataFrame:
    """Adds _raw: whether a text stands right in an element whose text is written as it is."""
    raw = (F.col("node_type") == ELEMENT) & (F.col("ns") == HTML) & F.col("tag").isin(*sorted(_RAW_OUT))
    before = W.partitionBy("doc_id", "tree_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("node_type") == ELEMENT, F.struct("node_id", raw.alias("raw"))), ignorenulls=True).over(before)
    return nodes.withColumn("_up", last).withColumn("_raw", F.coalesce(F.col("_up.raw") & (F.col("_up.node_id") == F.col("parent_id")), F.lit(False))).drop("_up")


def events(nodes: DataFrame) -> DataFrame:
    """Rows with their pieces of HTML: at and end order them, deep the ends at one place."""
    start = lambda piece: F.struct(F.col("doc_order").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("deep"), piece.alias("piece"))
    end = F.struct(F.col("doc_last").alias("at"), F.lit(1).alias("end"), (-F.col("doc_order")).alias("deep"), F.concat(F.lit("</"), F.col("tag"), F.lit(">")).alias("piece"))
    void = (F.col("ns") == HTML) & F.col("tag").isin(*sorted(VOID))
    text = F.when(F.col("_raw"), F.col("text")).otherwise(_escaped(F.col("text")))
    element = F.when(void, F.array(start(open_tag()))).otherwise(F.array(start(open_tag()), end))
    made = (
        F.when(F.col("node_type") == ELEMENT, element).when(F.col("node_type") == TEXT, F.array(start(text)))
        .when(F.col("node_type") == COMMENT, F.array(start(F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))))
    ).cast(_EVENT)
    return with_raw(nodes).select("*", F.inline(made))


def _pieces(attrs: Column | str, text: Column) -> tuple[Column, Column, Column]:
    """A row's start tag, comment or plain text, its end tag, and whether texts in it are written as they are."""
    element, html = F.col("node_type") == ELEMENT, F.col("ns") == HTML
    piece = F.when(element, open_tag(attrs)).when(F.col("node_type") == COMMENT, F.concat(F.lit("<!--"), text, F.lit("-->"))).otherwise(text)
    end = F.when(element & ~(html & F.col("tag").isin(*sorted(VOID))), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    return piece, end, F.coalesce(element & html & F.col("tag").isin(*sorted(_RAW_OUT)), F.lit(False))


def documents(nodes: DataFrame, name: str = "html", together: bool = False) -> DataFrame:
    """Each document of ``nodes`` as HTML, without a doctype.

    Rows can be fewer than were parsed: of a node that is not there nothing is
    written but what lies in it.  A document without rows gives none.  With
    ``together`` a document's rows are in one partition already.
    """
    ship(nodes.sparkSession)
    piece, end, raw = _pieces("attrs", F.col("text"))
    rows = nodes if together else nodes.repartition("doc_id")
    pieces = rows.select("doc_id", "tree_id", "node_id", "parent_id", "doc_order", "doc_last", "node_type", piece.alias("piece"), end.alias("end"), raw.alias("raw"))
    kind = nodes.schema["doc_id"].dataType.simpleString()
    return pieces.sortWithinPartitions("doc_id", "doc_order", "tree_id", "node_id").mapInArrow(_written, f"doc_id {kind}, _page string").withColumnRenamed("_page", name)


def versions(rows: DataFrame, kept: dict[str, dict[str, Column]], by: str, name: str = "html") -> DataFrame:
    """Documents written once for each named version: doc_id, the version's name, html.

    A version has columns for a row's attrs, text and verdict.  A row that is
    not kept isn't written, one that is removed takes all inside it along; a
    document of which a version leaves nothing gives none.  A document's rows
    are in one partition already, as ``policing`` deals them.
    """
    ship(rows.sparkSession)
    pieces = {n: _pieces(v["attrs"], v["text"])[0] for n, v in kept.items()}
    _, end, raw = _pieces("attrs", F.col("text"))
    stays = [x for i, (n, v) in enumerate(kept.items()) for x in (F.when(v["verdict"] == "keep", pieces[n]).alias(f"piece{i}"), v["verdict"].alias(f"verdict{i}"))]
    told = rows.select("doc_id", "tree_id", "node_id", "parent_id", "doc_order", "doc_last", "node_type", end.alias("end"), raw.alias("raw"), *stays)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = list(kept)

    def sides_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a page stays in one batch of what is written, so the versions of a batch are written side by side
        sides = [_Kept(i) for i in range(len(names))]
        for b in _whole(batches):
            for n, side in zip(names, sides, strict=True):
                for out in _written(iter([side(b)])):
                    yield pa.record_batch([out.column(0), pa.array([n] * out.num_rows, pa.string()), out.column(1)], names=["doc_id", "_by", "_page"])

    return told.sortWithinPartitions("doc_id", "doc_order", "tree_id", "node_id").mapInArrow(sides_of, f"doc_id {kind}, _by string, _page string").withColumnsRenamed({"_by": by, "_page": name})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end where a document ends; one that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b["doc_id"]
        last = pc.index(ids, ids[-1]).as_py()
        if last or held and held[-1]["doc_id"][-1] != ids[0]:
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Kept:
    """The rows of a batch of whole documents that a version keeps, as ``_written`` takes them."""

    def __init__(self, i: int):
        self.piece, self.verdict = f"piece{i}", f"verdict{i}"

    def __call__(self, b: pa.RecordBatch) -> pa.RecordBatch:
        keep, now, reach = [], None, -1
        for doc, order, last, verdict in zip(*(b[c].to_pylist() for c in ("doc_id", "doc_order", "doc_last", self.verdict)), strict=True):
            if doc != now:
                now, reach = doc, -1
            keep.append(verdict == "keep" and reach < order)
            if verdict == "remove" and last > reach:
                reach = last
        columns = ["doc_id", "tree_id", "node_id", "parent_id", "doc_order", "doc_last", "node_type", self.piece, "end", "raw"]
        return b.select(columns).filter(pa.array(keep, pa.bool_()))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of rows in the order of their documents; one that goes on in the next batch waits for it."""
    now: object = None
    out: list[str] = []
    open_: list[tuple[int, str]] = []  # where elements end, and their end tags
    raw_in: dict[int, int | None] = {}  # each tree's last element, if its text is written as it is
    some = False  # whether the document has anything to write
    for b in batches:
        ids, pages = [], []

        def close() -> None:
            if some:
                out.extend(end for _, end in reversed(open_))
                ids.append(now)
                pages.append("".join(out))

        for doc, tree, node, parent, order, last, kind, piece, end, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if doc != now:
                close()
                now, out, open_, raw_in, some = doc, [], [], {}, False
            while open_ and open_[-1][0] < order:
                out.append(open_.pop()[1])
            if kind == ELEMENT:
                raw_in[tree] = node if raw else None
            elif kind == TEXT:
                if piece is not None and (parent is None or raw_in.get(tree) != parent):
                    piece = dom._escaped(piece)
            elif kind != COMMENT:
                continue
            some = True
            if piece is not None:
                out.append(piece)
            if end is not None:
                open_.append((last, end))
        yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(pages, pa.string())], names=["doc_id", "_page"])
    if some:
        out.extend(end for _, end in reversed(open_))
        yield pa.record_batch([pa.array([now], b.schema.field(0).type), pa.array(["".join(out)], pa.string())], names=["doc_id", "_page"])


def _parts(nodes: DataFrame, wanted: Column) -> DataFrame:
    """What each wanted row spans of its document's page, with the page: doc_id, _PLACE, _from, _to, _open (of its first piece), _void, _page."""
    rows = nodes.repartition("doc_id")  # one exchange for both sides, which need the same columns
    pieces = events(rows.withColumn("_wanted", F.coalesce(wanted, F.lit(False))))
    running = W.partitionBy("doc_id").orderBy("at", "end", "deep")
    placed = pieces.withColumn("_to", F.sum(F.length("piece")).over(running)).withColumn("_from", F.col("_to") - F.length("piece"))
    own = [F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max(F.when(F.col("end") == 0, F.length("piece"))).alias("_open"), (F.count("*") == 1).alias("_void")]
    spans = placed.where("_wanted").groupBy("doc_id", *_PLACE).agg(*own)
    whole = documents(rows, "_page", together=True).hint("merge")  # a row for each document: never broadcast, however small the source's files are
    return spans.join(whole, "doc_id")


_PLACE = ["tree_id", "node_id", "tag"]


def _cut(start: Column, stop: Column) -> Column:
    return F.substring("_page", (start + 1).cast("int"), (stop - start).cast("int"))


def outer_html(nodes: DataFrame, wanted: Column, name: str = "html") -> DataFrame:
    """The HTML of each row that ``wanted`` (a condition on the columns of ``nodes``) is true for: doc_id, tree_id, node_id, tag, html."""
    return _parts(nodes, wanted).select("doc_id", *_PLACE, _cut(F.col("_from"), F.col("_to")).alias(name))


def inner_html(nodes: DataFrame, wanted: Column, name: str = "html", page: str | None = None) -> DataFrame:
    """The HTML inside each wanted element, that of a template being its content's; under ``page``, if asked, the whole document's, too."""
    inside = _cut(F.col("_from") + F.col("_open"), F.col("_to") - F.length("tag") - 3)
    whole = [F.col("_page").alias(page)] if page else []
    return _parts(nodes, wanted).select("doc_id", *_PLACE, F.when(F.col("_void"), F.lit("")).otherwise(inside).alias(name), *whole)


def text_content(nodes: DataFrame, wanted: Column, name: str = "content") -> DataFrame:
    """The text inside each wanted element, without that of templates: doc_id, tree_id, node_id, tag, content."""
    start = F.struct(F.col("node_id").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("deep"), F.when(F.col("node_type") == TEXT, F.col("text")).otherwise(F.lit("")).alias("piece"))
    end = F.struct(F.col("last_desc").alias("at"), F.lit(1).alias("end"), (-F.col("node_id")).alias("deep"), F.lit("").alias("piece"))
    marked = nodes.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).where(F.col("_wanted") | (F.col("node_type") == TEXT)).repartition("doc_id", "tree_id")
    pieces = marked.select("*", F.inline(F.when(F.col("_wanted"), F.array(start, end)).otherwise(F.array(start)).cast(_EVENT)))
    running = W.partitionBy("doc_id", "tree_id").orderBy("at", "end", "deep")
    placed = pieces.withColumn("_to", F.sum(F.length("piece")).over(running)).withColumn("_from", F.col("_to") - F.length("piece"))
    spans = placed.where("_wanted").groupBy("doc_id", *_PLACE).agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "end", "deep", "piece")))
    whole = pieces.where("piece <> ''").groupBy("doc_id", "tree_id").agg(F.array_join(F.transform(in_order, lambda e: e["piece"]), "").alias("_page"))
    part = F.substring("_page", (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int"))
    return spans.join(whole.hint("merge"), ["doc_id", "tree_id"], "left").select("doc_id", *_PLACE, F.coalesce(part, F.lit("")).alias(name))
