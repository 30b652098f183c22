"""A Merkle tree over a dataset: roots, a proof for each row, and rows verified against the root."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, small_arrow_batches, tidy, with_row_id, written

#: Blocks of 2**SMALLEST leaves at least; larger ones as soon as there would be more than ROOTS of them, so that the top tree stays small.
SMALLEST, ROOTS = 8, 1 << 16
#: Block roots that the driver takes at most: ROOTS and one more for each group.
MOST_ROOTS = 1 << 20
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCK = "grp string, block long, size long, n int, ids array<long>, leaves binary, claims binary, node string"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    """Lowercase hex SHA-256 of a text."""
    return sha256(text.encode()).hexdigest()


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """A tree's levels from the leaves up: every 2 nodes become their hash, a last one alone its own; ``height`` levels, or up to one node."""
    out = [nodes]
    while len(nodes) > 1 if height is None else len(out) <= height:
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """For each level under the last, what the path from leaf ``at`` meets: < or > for the side of the sibling and its hash, or nothing."""
    out = []
    for row in tree[:-1]:
        other = at ^ 1
        out.append(("<" if at & 1 else ">") + row[other] if other < len(row) else "")
        at >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that a node and the siblings of its path lead to."""
    for s in path:
        node = digest(node if not s else s[1:] + node if s[0] == "<" else node + s[1:])
    return node


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 of values: - for null, else UTF-8 byte count, colon and value."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]), 256)


def _cut(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and place as one row for each block, with the hash of its top node."""
    kinds = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("leaves", pa.binary()), ("claims", pa.binary()), ("node", pa.string())])
    key, held = None, ([], [], [])

    def block() -> pa.RecordBatch:
        grp, no, size = key
        hexes = [x.hex() for x in held[1]]
        node = levels(hexes, None if size <= 1 << bits else bits)[-1][0]
        return pa.RecordBatch.from_pylist([{"grp": grp, "block": no, "size": size, "n": len(hexes), "ids": held[0], "leaves": b"".join(held[1]), "claims": b"".join(held[2]), "node": node}], kinds)

    for b in batches:
        for grp, no, size, i, leaf, claim in zip(*[b.column(c).to_pylist() for c in ("grp", "block", "size", "doc_id", "leaf", "claim")], strict=True):
            if (grp, no, size) != key:
                if key is not None:
                    yield block()
                key, held = (grp, no, size), ([], [], [])
            for x, v in zip(held, (i, leaf, claim), strict=True):
                x.append(v)
    if key is not None:
        yield block()


def _proofs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the paths above them as rows with their proofs, each folded to the root."""
    names = [x.split(" ")[0] for x in _PROOF.split(", ")]
    for b in batches:
        for r in b.to_pylist():
            split = lambda body: [body[i : i + 32].hex() for i in range(0, len(body), 32)]
            leaves, claims = split(r["leaves"]), split(r["claims"])
            tree = levels(leaves, None if r["size"] <= 1 << bits else bits)
            for start in range(0, len(leaves), 4096):
                rows = []
                for at in range(start, min(start + 4096, len(leaves))):
                    path = siblings(tree, at) + r["path"]
                    folded = fold(claims[at], path)
                    rows.append((r["ids"][at], leaves[at], r["subroot"], r["root"], digest("".join(s[1:] for s in path)), folded, folded == r["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.bool_() if i == 6 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names)


def top_tree(roots: list[tuple[str | None, int, str]]) -> list[tuple[str | None, int, list[str], str, str]]:
    """Group, block, path from the block's node to the root, subroot and root, for the nodes of all blocks."""
    groups: dict[str | None, list[str]] = {}
    for grp, _, node in sorted(roots, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        groups.setdefault(grp, []).append(node)
    trees = {grp: levels(nodes) for grp, nodes in groups.items()}
    over = levels([t[-1][0] for t in trees.values()]) if trees else []
    return [
        (grp, block, siblings(tree, block) + siblings(over, at), tree[-1][0], over[-1][0])
        for at, (grp, tree) in enumerate(trees.items()) for block in range(len(tree[0]))
    ]


def merkle_manifest(
    docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", claims: dict[str, Column] | None = None, block_bits: int | None = None
) -> DataFrame:
    """Leaf, roots, proof and verdict for each row of ``docs``.

    A leaf is the hash of a row's ``columns``.  In each group (``group_col``)
    leaves ascend by id, ties by their hash, a null id first; every two
    consecutive nodes become their hash, a last one alone its own, up to the
    group's subroot, and the subroots (a null group first, then bytewise) up to
    the root.  ``claims`` gives values that rows are verified with instead of
    their own, as after tampering: a row is verified if its claimed leaf and the
    siblings of the original fold to the root.

    Places come from one sort by ranges and counts of its partitions; only ids
    and hashes are moved.  Blocks of 2**k leaves are reduced where they lie.
    The driver gets a root for each block, at most about 65,536 and one for each
    group, since k grows with the rows; it builds the tree above them and
    broadcasts each block's path.  Executors finish proofs and fold each row.

    Returns doc_id, leaf, subroot, root, proof_sha256 (hash of the siblings from
    the leaf's up; of nothing if there is none), folded_root and verified.
    Repeated rows are leaves of their own.  An empty table gives no rows.  Other
    columns are not read.  More groups than MOST_ROOTS are an error.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    own = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_of([own[c] for c in columns])
    claim = leaf_of([(claims or {}).get(c, own[c]) for c in columns]) if claims else leaf
    hashed = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(leaf).alias("leaf"), F.unhex(claim).alias("claim"))
    hashed = written(hashed)
    order = ["grp", "doc_id", "leaf"]
    placed = written(with_row_id(hashed.repartitionByRange(*order).sortWithinPartitions(*order), "place").withColumn("part", F.shiftright("place", 33)))
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("k"), F.min("place").alias("from"))
    in_group = W.partitionBy("grp")
    starts = written(runs.select(
        F.col("grp").alias("_g"), F.col("part").alias("_p"), (F.sum("k").over(in_group.orderBy("part")) - F.col("k") - F.col("from")).alias("shift"), F.sum("k").over(in_group).alias("size"), "k"
    ))
    totals = starts.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("rows")).first()
    bits = max(SMALLEST, (totals["rows"] // ROOTS).bit_length()) if block_bits is None else block_bits
    starts = F.broadcast(starts) if totals["n"] <= BROADCAST_ROWS else starts.hint("merge")
    at = placed.join(starts, placed["grp"].eqNullSafe(starts["_g"]) & (placed["part"] == starts["_p"])).withColumn("pos", F.col("place") + F.col("shift"))
    at = at.select("grp", F.shiftright("pos", bits).alias("block"), "size", "pos", "doc_id", "leaf", "claim").repartition("grp", "block").sortWithinPartitions("grp", "pos")
    blocks = written(at.mapInArrow(tidy(lambda batches: _cut(batches, bits)), _BLOCK))
    if blocks.count() > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} block roots: {group_col} has too many values for one top tree")
    top = top_tree([tuple(r) for r in blocks.select("grp", "block", "node").collect()])
    paths = spark.createDataFrame(top, "_g string, _b long, path array<string>, subroot string, root string")
    found = blocks.join(F.broadcast(paths), blocks["grp"].eqNullSafe(paths["_g"]) & (blocks["block"] == paths["_b"]))
    return found.select("size", "ids", "leaves", "claims", "path", "subroot", "root").mapInArrow(tidy(lambda batches: _proofs(batches, bits)), _PROOF)
