"""``dom_nodes`` as a data source over Parquet tables of pages: conditions go into it, and only asked columns are made.

    register_sources(spark)
    read_nodes(spark, "pages.parquet", ["doc_id", "tag"]).where("tag in ('a', 'li')")

Conditions on doc_id leave pages unparsed, those on tag and node_type leave nodes
unmade.  A task has row groups of some 32 MB of files; which pages are in them it
finds out itself, so the driver only lists files.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.dom import COMMENT, ELEMENT, TEXT, Node, parse
from ..operators.nodes import SCHEMA, node_rows
from ..plans.ship import ship
from .folders import data_files, located

SPLIT = 32 * 1024 * 1024
#: Nodes in one Arrow batch, at most this many beyond which a document begins a new one.
BATCH = 8192
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_ARROW = {
    "doc_id": pa.int64(), "node_type": pa.int8(), "tag": pa.string(), "ns": pa.string(), "text": pa.string(), "attrs": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
}
#: Columns that need no numbering of the tree.
PLAIN = frozenset(_ARROW)


@dataclass
class Pages(InputPartition):
    """Parts of files: path, first byte, byte after the last; a row group belongs to the part in which its middle is."""

    parts: list[tuple[str, int, int]]


@dataclass
class Wanted:
    """What conditions leave: comparisons of doc_id, and sets of tags and of node types (None: all)."""

    ids: list[tuple] = field(default_factory=list)
    tags: frozenset | None = None
    types: frozenset | None = None

    def take(self, f: Filter) -> bool:
        """Whether the condition is wholly seen to here."""
        name = f.attribute[0] if len(f.attribute) == 1 else None
        if isinstance(f, IsNotNull):
            return name == "doc_id"  # rows have it always; of others the columns are looked at by Spark
        if name == "doc_id" and type(f) in _COMPARE:
            self.ids.append((_COMPARE[type(f)], f.value))
        elif name == "doc_id" and isinstance(f, In):
            self.ids.append((lambda d, some: d in some, frozenset(f.value)))
        elif name in ("tag", "node_type") and isinstance(f, EqualTo | In):
            values = frozenset(f.value) if isinstance(f, In) else frozenset([f.value])
            kind = "tags" if name == "tag" else "types"
            had = getattr(self, kind)
            setattr(self, kind, values if had is None else had & values)
        else:
            return False
        return True

    def page(self, doc_id: int) -> bool:
        return all(ok(doc_id, v) for ok, v in self.ids)

    def node(self, kind: int, tag: str | None) -> bool:
        return (self.types is None or kind in self.types) and (self.tags is None or kind == ELEMENT and tag in self.tags)


class NodeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.id, self.html = options["path"], options.get("id", "page_id"), options.get("html", "html")
        self.split = int(options.get("split", SPLIT))
        self.names, self.wanted = schema.names, Wanted()
        known = {c.strip().split(" ")[0] for c in SCHEMA.split(", ")}
        if set(self.names) - known:
            raise ValueError(f"no columns of nodes: {sorted(set(self.names) - known)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[InputPartition]:
        out, part, held = [], [], 0
        for path, size in data_files(self.path):
            for at in range(0, max(size, 1), self.split):
                end = min(at + self.split, size)
                part.append((path, at, end))
                held += end - at
                if held >= self.split:
                    out.append(Pages(part))
                    part, held = [], 0
        return [*out, Pages(part)] if part or not out else out

    def _pages(self, parts: list[tuple[str, int, int]]) -> Iterator[tuple[int, str]]:
        system, _ = located(self.path)
        for path, first, end in parts:
            with system.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                for g in range(file.num_row_groups):
                    meta = file.metadata.row_group(g)
                    chunks = [meta.column(i) for i in range(meta.num_columns)]
                    start = min(c.dictionary_page_offset or c.data_page_offset for c in chunks)
                    if not first <= start + sum(c.total_compressed_size for c in chunks) // 2 < end:
                        continue
                    for b in file.iter_batches(64, row_groups=[g], columns=[self.id, self.html]):
                        for d, h in zip(b.column(self.id).to_pylist(), b.column(self.html), strict=True):
                            if d is not None and h.is_valid and self.wanted.page(d):
                                yield d, h.as_py()

    def _plain(self, doc_id: int, root: Node) -> Iterator[tuple]:
        """Asked columns of the nodes that conditions leave, without places."""
        take = {
            "doc_id": lambda n: doc_id, "node_type": lambda n: n.type, "tag": lambda n: n.name if n.type == ELEMENT else None, "ns": lambda n: n.ns if n.type == ELEMENT else None,
            "text": lambda n: n.data if n.type in (TEXT, COMMENT) else None, "attrs": lambda n: [{"name": a, "value": v} for a, v in n.attrs] if n.type == ELEMENT else None,
        }
        made, todo = [take[c] for c in self.names], [root]
        while todo:
            n = todo.pop()
            todo.extend(n.children)
            if n.content is not None:
                todo.append(n.content)
            if self.wanted.node(n.type, n.name):
                yield tuple(f(n) for f in made)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        plain = PLAIN.issuperset(self.names)
        types = [_ARROW.get(c, pa.int32()) for c in self.names]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=self.names)

        for d, h in self._pages(partition.parts):
            if plain:
                rows.extend(self._plain(d, parse(h)))
            else:
                rows.extend(tuple(r[c] for c in self.names) for r in node_rows(d, parse(h)) if self.wanted.node(r["node_type"], r["tag"]))
            if len(rows) >= BATCH:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class NodeSource(DataSource):
    """Options: path, id and html (columns of the table, page_id and html), split (bytes of files in a task)."""

    @classmethod
    def name(cls) -> str:
        return "dom_nodes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NodeReader:
        return NodeReader(self.options, schema)


def register_sources(spark: SparkSession) -> None:
    """Makes ``dom_nodes`` and ``html_files`` known to the session, and switches on its push-down into Python sources, without which Spark refuses sources that take conditions."""
    from .document_sink import DocumentSink

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NodeSource)
    spark.dataSource.register(DocumentSink)


def read_nodes(spark: SparkSession, path: str, columns: list[str] | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Nodes of all pages of a Parquet table; with ``columns`` only those are made.  A page without id or html has none."""
    kinds = {c.strip().split(" ")[0]: c.strip() for c in SCHEMA.split(", ")}
    made = SCHEMA if columns is None else ", ".join(kinds[c] for c in columns)
    return spark.read.format("dom_nodes").schema(made).option("id", id_col).option("html", html_col).load(path)
