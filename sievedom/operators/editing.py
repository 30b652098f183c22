"""Changes to documents as rows: insert, wrap, unwrap, replace, remove, move and clone under order-keeping labels.

A node's label is where it starts and stops: two arrays of numbers that sort, by
their first difference, as the events of the document do.  Between any two
labels there is room for more, as a longer array, so an edit gives labels to new
rows and leaves all others alone: no row is numbered again until ``renumbered``.
What a row is inside of is a running maximum over its document's labels; no edit
joins.  All edits of one chain and the numbering share one exchange by document.

The base of each number leaves three places: 3n is an event, 3n - 1 is for what
is put before it, an extension of 3n for what is put after it.  Later edits at
one place lie nearer to it, as with the calls of a document object model.  An
edit's labels are longer than those that it starts from, so very long chains
should be numbered again in between.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.dom import DOCUMENT, ELEMENT, FRAGMENT, HTML, parse_fragment
from ..functions.edits import WHERE
from ..plans.ship import ship
from .nodes import NAMES, node_rows

LABEL = ["start", "stop"]
_OWN = ["node_type", "tag", "ns", "attrs", "text"]
_PLACES = [c for c in NAMES if c not in ("doc_id", *_OWN)]
_PIECES = "array<struct<start:array<long>,stop:array<long>,node_type:byte,tag:string,ns:string,attrs:array<struct<name:string,value:string>>,text:string>>"


def _start(order: Column) -> Column:
    return F.array((order * 3).cast("long"))


def _stop(order: Column, last: Column) -> Column:
    return F.array((last * 3 + 1).cast("long"), ((last - order) * 2).cast("long"))


def _numbers(*n: int) -> Column:
    return F.array(*[F.lit(i).cast("long") for i in n])


def _before(label: Column, edit: int) -> Column:
    return F.concat(F.slice(label, 1, F.size(label) - 1), F.array(F.element_at(label, -1) - 1), _numbers(1, 3 * edit))


def _after(label: Column, edit: int) -> Column:
    return F.concat(label, _numbers(0, -3 * edit))


def _place(where: str, edit: int, start: Column, stop: Column, template: Column) -> Column:
    """The label under which ``where`` of an element is; what is inside of a template is in its content, the next node."""
    if where not in WHERE:
        raise ValueError(f"{' or '.join(WHERE)}, not {where}")
    in_start = F.when(template, F.concat(F.slice(start, 1, F.size(start) - 1), F.array(F.element_at(start, -1) + 3))).otherwise(start)
    in_stop = F.when(template, F.concat(F.slice(stop, 1, F.size(stop) - 1), F.array(F.element_at(stop, -1) - 2))).otherwise(stop)
    return {"beforebegin": lambda: _before(start, edit), "afterbegin": lambda: _after(in_start, edit), "beforeend": lambda: _before(in_stop, edit), "afterend": lambda: _after(stop, edit)}[where]()


def _template() -> Column:
    return F.coalesce((F.col("tag") == "template") & (F.col("ns") == HTML), F.lit(False))


def _pieces(html: str) -> Column:
    """A fragment's rows with labels, as a constant."""
    rows = [r for r in node_rows(0, parse_fragment(html)) if r["doc_order"]]
    return F.from_json(F.lit(json.dumps([
        {**{c: r[c] for c in _OWN}, "start": [3 * r["doc_order"]], "stop": [3 * r["doc_last"] + 1, 2 * (r["doc_last"] - r["doc_order"])]} for r in rows
    ])), _PIECES)


def _filled(piece: Column, values: dict[str, Column]) -> dict[str, Column]:
    """A piece's columns with ``{name}`` in its texts and attribute values replaced; what is put in is never parsed."""
    def fill(text: Column) -> Column:
        for name, value in values.items():
            text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
        return text

    return {
        "node_type": piece["node_type"], "tag": piece["tag"], "ns": piece["ns"], "text": fill(piece["text"]),
        "attrs": F.transform(piece["attrs"], lambda a: F.struct(a["name"].alias("name"), fill(a["value"]).alias("value"))) if values else piece["attrs"],
    }


def labelled(nodes: DataFrame) -> DataFrame:
    """Rows of ``dom_nodes`` with labels for their places, and any further columns (null in rows that edits add)."""
    order, last = F.col("doc_order"), F.col("doc_last")
    kept = [c for c in nodes.columns if c not in _PLACES]
    return nodes.select(*kept, _start(order).alias("start"), _stop(order, last).alias("stop")).repartition("doc_id")


@dataclass(frozen=True)
class Editing:
    """A chain of edits on labelled rows; each gives a new chain.

    ``target`` and ``anchor`` are conditions on the columns of ``rows``; a null
    is false.  With ``first``, only the first row of a document that ``target``
    holds for counts.  Roots of documents and of contents are never targets.
    """

    rows: DataFrame
    edits: int = 0

    @classmethod
    def of(cls, nodes: DataFrame) -> Editing:
        return cls(labelled(nodes))

    def _then(self, rows: DataFrame) -> Editing:
        return replace(self, rows=rows.select(*self.rows.columns), edits=self.edits + 1)

    def _marked(self, target: Column, first: bool = False) -> DataFrame:
        """_t: a target; _top: a target in no other target; _in: inside a target or one."""
        asked = F.coalesce(target, F.lit(False)) & ~F.col("node_type").isin(DOCUMENT, FRAGMENT)
        rows = self.rows.withColumn("_t", asked)
        in_order = W.partitionBy("doc_id").orderBy("start")
        if first:
            rows = rows.withColumn("_t", F.col("_t") & (F.coalesce(F.count_if("_t").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 0))
        ends = F.max(F.when(F.col("_t"), F.col("stop")))
        rows = rows.withColumn("_open", ends.over(in_order.rowsBetween(W.unboundedPreceding, -1)))
        under = F.coalesce(F.col("_open") > F.col("start"), F.lit(False))
        return rows.withColumn("_top", F.col("_t") & ~under).withColumn("_in", F.col("_t") | under)

    def insert(self, target: Column, where: str, html: str, values: dict[str, Column] | None = None, first: bool = False) -> Editing:
        """A fragment (parsed once, as a constant) at each target; ``{name}`` in it takes the value of a column expression on the target's row."""
        edit = self.edits + 1
        base = _place(where, edit, F.col("start"), F.col("stop"), _template())
        names = [c for c in self.rows.columns if c != "doc_id"]  # which stays outside the generator, so that its partitioning is known
        own = F.struct(*[F.col(c) for c in names])
        none = {c: F.lit(None).cast(self.rows.schema[c].dataType) for c in names}

        def new(piece: Column) -> Column:
            have = {**none, **_filled(piece, values or {}), "start": F.concat(F.col("_base"), piece["start"]), "stop": F.concat(F.col("_base"), piece["stop"])}
            return F.struct(*[have[c].alias(c) for c in names])

        marked = self._marked(target, first) if first else self.rows.withColumn("_t", F.coalesce(target, F.lit(False)) & ~F.col("node_type").isin(DOCUMENT, FRAGMENT))
        rows = marked.withColumn("_base", F.when(F.col("_t"), base))
        whole = F.when(F.col("_t"), F.concat(F.array(own), F.transform(_pieces(html), new))).otherwise(F.array(own))
        return self._then(rows.select("doc_id", F.inline(whole)))

    def wrap(self, target: Column, tag: str, attributes: dict[str, str] | None = None, first: bool = False) -> Editing:
        """Each target in a new element of its own."""
        edit = self.edits + 1
        names = [c for c in self.rows.columns if c != "doc_id"]
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (attributes or {}).items()])
        have = {c: F.lit(None).cast(self.rows.schema[c].dataType) for c in names} | {
            "node_type": F.lit(ELEMENT).cast("byte"), "tag": F.lit(tag), "ns": F.lit(HTML), "attrs": pairs.cast(self.rows.schema["attrs"].dataType),
            "start": _before(F.col("start"), edit), "stop": _after(F.col("stop"), edit),
        }
        own, around = F.struct(*[F.col(c) for c in names]), F.struct(*[have[c].alias(c) for c in names])
        return self._then(self._marked(target, first).select("doc_id", F.inline(F.when(F.col("_t"), F.array(own, around)).otherwise(F.array(own)))))

    def unwrap(self, target: Column, first: bool = False) -> Editing:
        """Each target's children in its place; of a template those of its content, whose root goes too."""
        marked = self._marked(target, first)
        holder = F.lag(F.struct("_t", _template().alias("template"))).over(W.partitionBy("doc_id").orderBy("start"))
        content = (F.col("node_type") == FRAGMENT) & F.coalesce(F.col("_up._t") & F.col("_up.template"), F.lit(False))
        return self._then(marked.withColumn("_up", holder).where(~F.col("_t") & ~content))

    def remove(self, target: Column, first: bool = False) -> Editing:
        """Each target goes, with all inside it."""
        return self._then(self._marked(target, first).where(~F.col("_in")))

    def hollow(self, target: Column, first: bool = False) -> Editing:
        """All inside each outermost target goes; of a template its content's root stays."""
        marked = self._marked(target, first)
        last_top = F.last(F.when(F.col("_top"), F.struct("start", _template().alias("template"))), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("start"))
        content = (F.col("node_type") == FRAGMENT) & F.col("_up.template") & (F.size("start") == F.size("_up.start")) & (F.element_at("start", -1) == F.element_at("_up.start", -1) + 3)
        return self._then(marked.withColumn("_up", last_top).where(~F.col("_in") | F.col("_top") | F.coalesce(content, F.lit(False))))

    def replace_children(self, target: Column, html: str, values: dict[str, Column] | None = None, first: bool = False) -> Editing:
        """A fragment instead of what is inside each outermost target."""
        named = replace(self, rows=self._marked(target, first).drop("_open", "_t", "_in").withColumnRenamed("_top", "_mark"))
        done = named.hollow(F.col("_mark")).insert(F.col("_mark"), "beforeend", html, values)
        return replace(done, rows=done.rows.drop("_mark"))

    def replace_with(self, target: Column, html: str, values: dict[str, Column] | None = None, first: bool = False) -> Editing:
        """A fragment instead of each outermost target."""
        named = replace(self, rows=self._marked(target, first).drop("_open", "_t", "_in").withColumnRenamed("_top", "_mark"))
        done = named.insert(F.col("_mark"), "beforebegin", html, values).remove(F.col("_mark"))
        return replace(done, rows=done.rows.drop("_mark"))

    def _carried(self, target: Column, anchor: Column, where: str, first: bool) -> DataFrame:
        """Rows with the labels that they have at the document's first anchor outside all targets, null for rows outside targets or without an anchor."""
        whole = W.partitionBy("doc_id").orderBy("start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        usable = F.coalesce(anchor, F.lit(False)) & ~F.col("_in") & ~F.col("node_type").isin(DOCUMENT, FRAGMENT)
        found = F.first(F.when(usable, F.struct("start", "stop", _template().alias("template"))), ignorenulls=True).over(whole)
        rows = self._marked(target, first).withColumn("_to", found)
        base = _place(where, self.edits + 1, F.col("_to.start"), F.col("_to.stop"), F.col("_to.template"))
        moved = F.col("_in") & F.col("_to").isNotNull()
        return rows.withColumn("_base", F.when(moved, base))

    def move(self, target: Column, anchor: Column, where: str, first: bool = False) -> Editing:
        """The outermost targets, in their order, to a place at the document's first anchor outside them; without such an anchor they stay."""
        rows = self._carried(target, anchor, where, first)
        at = lambda c: F.when(F.col("_base").isNull(), F.col(c)).otherwise(F.concat(F.col("_base"), F.col(c)))
        return self._then(rows.withColumns({c: at(c) for c in LABEL}))

    def clone(self, target: Column, anchor: Column, where: str, first: bool = False) -> Editing:
        """Copies of the outermost targets, with all inside, at the document's first anchor outside them; without such an anchor there are none."""
        rows, names = self._carried(target, anchor, where, first), [c for c in self.rows.columns if c != "doc_id"]
        own = F.struct(*[F.col(c) for c in names])
        copy = F.struct(*[(F.concat(F.col("_base"), F.col(c)) if c in LABEL else F.col(c)).alias(c) for c in names])
        return self._then(rows.select("doc_id", F.inline(F.when(F.col("_base").isNull(), F.array(own)).otherwise(F.array(own, copy)))))

    def set_attribute(self, target: Column, name: str, value: Column | None) -> Editing:
        """An attribute of each target, in its place if it is there, else last; None takes it away."""
        new = lambda v: F.struct(F.lit(name).alias("name"), v.cast("string").alias("value"))
        rest = F.filter("attrs", lambda a: a["name"] != name)
        if value is None:
            made = rest
        else:
            have = F.exists("attrs", lambda a: a["name"] == name)
            made = F.when(have, F.transform("attrs", lambda a: F.when(a["name"] == name, new(value)).otherwise(a))).otherwise(F.concat("attrs", F.array(new(value))))
        hit = F.coalesce(target, F.lit(False)) & (F.col("node_type") == ELEMENT)
        return self._then(self.rows.withColumn("attrs", F.when(hit, made).otherwise(F.col("attrs"))))

    def nodes(self) -> DataFrame:
        """The rows as ``dom_nodes`` again."""
        return renumbered(self.rows)


_COUNTED = ["tree_id", "host_tree_id", "template_host_id", "doc_order", "doc_last", "node_id", "parent_id", "pos", "depth", "last_desc"]


def numbers(rows: Iterable[tuple[list, list, bool]]) -> list[list]:
    """Places of one document's rows, given in order as start, stop and whether it is a root of a tree: for each the values of _COUNTED.

    The rows that a row is inside of are those begun and not yet stopped, so one
    stack says its tree, parent and depth, and what is open when it stops its last.
    """
    out: list[list] = []
    trees: list[list] = []  # nodes so far, host tree, host
    open_: list[list] = []  # stop, row, children in its tree so far

    def close() -> None:
        row = open_.pop()[1]
        row[4], row[9] = len(out) - 1, trees[row[0]][0] - 1

    for start, stop, root in rows:
        while open_ and open_[-1][0] < start:
            close()
        if root or not trees:
            before = out[-1] if root and trees else None
            trees.append([0, *([before[0], before[5]] if before else [None, None])])
        up = None if root or not open_ else open_[-1]
        tree = len(trees) - 1 if up is None else up[1][0]
        node = trees[tree][0]
        trees[tree][0] = node + 1
        pos = 0
        if up is not None:
            pos = up[2]
            up[2] += 1
        row = [tree, *trees[tree][1:], len(out), 0, node, up and up[1][5], pos, up[1][8] + 1 if up else 0, 0]
        out.append(row)
        open_.append([stop, row, 0])
    while open_:
        close()
    return out


def renumbered(rows: DataFrame) -> DataFrame:
    """Labelled rows as ``dom_nodes``: all places counted anew, trees in the order of the document.

    Spark deals and sorts the rows by document and start; what is left is one
    look at each row, next to its neighbours, in Arrow batches.  A document that
    goes on in the next batch waits for it.  Further columns stay.
    """
    extra = [c for c in rows.columns if c not in ("doc_id", *_OWN, *LABEL, *_PLACES)]
    ship(rows.sparkSession)
    kept = rows.select("doc_id", *_OWN, *extra, *LABEL, F.col("node_type").isin(DOCUMENT, FRAGMENT).alias("_root")).repartition("doc_id").sortWithinPartitions("doc_id", "start")
    names = ["doc_id", *_OWN, *extra]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField(c, kinds[c]) for c in names] + [StructField(c, IntegerType()) for c in _COUNTED])

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        told = zip(*(table[c].to_pylist() for c in ("doc_id", *LABEL, "_root")), strict=True)
        made = [r for _, some in groupby(told, key=itemgetter(0)) for r in numbers(x[1:] for x in some)]
        out = table.select(names)
        for c, values in zip(_COUNTED, zip(*made, strict=True), strict=True):
            out = out.append_column(c, pa.array(values, pa.int32()))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b["doc_id"]
            last = pc.index(ids, ids[-1]).as_py()
            if last or held and held[-1]["doc_id"][-1] != ids[0]:
                yield from counted(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from counted(pa.Table.from_batches(held))

    out = kept.mapInArrow(run, schema)
    return out.select(*NAMES, *extra)
