"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, so that all are equally long and a larger inner
product is a shorter distance.  Each row's key is its nearest pivot and its
distance to it; rows lie sorted by key in blocks.  An anchor's distance to a
pivot and a block's interval of keys bound the scores in the block from both
sides (triangle inequality), so a search reads the blocks nearest in key, then
all whose bound still reaches the worst of what it has found; what remains can't
be among the first k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BROADCAST_ROWS, small_arrow_batches, tidy, with_row_id, written

#: Rows of the sample from which pivots come, which bounds what the driver gets.
PIVOTS = 32
#: Rows of a block, more as soon as there would be over DIRECTORY blocks; anchors searched together.
BLOCK, DIRECTORY, TOGETHER = 1024, 1 << 20, 256
#: Blocks nearest in key that a search begins with, for each anchor.
FIRST = 4
#: Bytes of anchors that are broadcast; beyond that the join shuffles.
BROADCAST_BYTES = 64 << 20

_ROWS = "row_id long, id long, label long, dim int, kind string, vector binary, norm double, anchor boolean"
_BLOCKS = "dim int, pivot int, lo double, hi double, n int, rows binary, ids array<long>, labels binary, kind string, vectors binary, norms binary"
_FOUND = "g long, qi int, slot int, score long, id long, row_id long"
_NONE, _ALL = -(1 << 62), 1 << 62


def _quantised(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Vectors as the smallest integers that hold floor(scale * x); rows whose product is not finite go."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            with np.errstate(over="ignore"):
                v = np.floor(np.asarray(r["vector"], np.float64) * scale)
            if not np.isfinite(v).all():
                continue
            most = np.abs(v).max(initial=0)
            kind = next((k for k, top in (("int16", 2**15), ("int32", 2**31)) if most < top), "float64")
            out.append({"row_id": r["row_id"], "id": r["id"], "label": r["label"], "dim": len(v), "kind": kind, "vector": v.astype(kind).tobytes(), "norm": float(v @ v), "anchor": r["anchor"]})
        yield pa.RecordBatch.from_pylist(out, _schema(_ROWS))


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in text.split(", "))])


def _keyed(batches: Iterator[pa.RecordBatch], pivots: list[tuple[int, np.ndarray]], longest: float) -> Iterator[pa.RecordBatch]:
    """Rows with their nearest pivot and distance.  Where no pivot has a vector's length it is -1, the origin."""
    for b in batches:
        dim, pivot, dist = np.array(b.column("dim")), np.full(b.num_rows, -1, np.int32), np.full(b.num_rows, np.sqrt(longest))
        for d in set(dim.tolist()):
            own, at = [i for i, p in pivots if len(p) == d], np.flatnonzero(dim == d)
            if own:
                x = np.stack([np.frombuffer(b.column("vector")[i].as_py(), b.column("kind")[i].as_py()).astype(np.float64) for i in at.tolist()])
                square = distances(x, np.stack([p for i, p in pivots if len(p) == d]), longest, np.array(b.column("norm"))[at])
                best = square.argmin(axis=1)
                pivot[at], dist[at] = np.array(own, np.int32)[best], np.sqrt(square[np.arange(len(at)), best])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(dist)], [*b.schema.names, "pivot", "dist"])


def distances(x: np.ndarray, pivots: np.ndarray, longest: float, norms: np.ndarray) -> np.ndarray:
    """Squared distances of lengthened rows and lengthened pivots."""
    rest = np.sqrt(np.maximum(longest - norms, 0))[:, None] * np.sqrt(np.maximum(longest - (pivots * pivots).sum(axis=1), 0))[None, :]
    return np.maximum(2 * longest - 2 * (x @ pivots.T + rest), 0)


def _blocks(batches: Iterator[pa.RecordBatch], most: int, by_pivot: bool) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys as blocks of ``most`` rows at most, which lie by id in a block."""
    key, held = None, []

    def block() -> pa.RecordBatch:
        rows = sorted(held, key=lambda r: (r["id"] is None, r["id"] or 0, r["row_id"]))
        kind = max((r["kind"] for r in rows), key=("int16", "int32", "float64").index)
        vectors = np.concatenate([np.frombuffer(r["vector"], r["kind"]).astype(kind) for r in rows]).tobytes()
        long = lambda c: np.array([r[c] for r in rows], np.int64).tobytes()
        dist = [r["dist"] for r in rows]
        return pa.RecordBatch.from_pylist([{
            "dim": rows[0]["dim"], "pivot": rows[0]["pivot"], "lo": min(dist), "hi": max(dist), "n": len(rows), "rows": long("row_id"), "ids": [r["id"] for r in rows],
            "labels": long("label"), "kind": kind, "vectors": vectors, "norms": np.array([r["norm"] for r in rows], np.float64).tobytes(),
        }], _schema(_BLOCKS))

    for b in batches:
        for r in b.to_pylist():
            now = (r["dim"], r["pivot"] if by_pivot else 0)
            if held and (now != key or len(held) >= most):
                yield block()
                held = []
            key = now
            held.append(r)
    if held:
        yield block()


def matrix(r: dict) -> np.ndarray:
    return np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["dim"]).astype(np.float64)


def windows(r: dict, ask: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor of a group asks for, by slot; a slot is asked for by a positive of score p: low * p <= 100 * score <= high * p."""
    if ask is None:
        return np.full((r["n"], 1), _NONE), np.full((r["n"], 1), _ALL)
    slots, low, high = ask
    lo, hi = np.ones((r["n"], slots), np.int64), np.zeros((r["n"], slots), np.int64)
    for p in r["positives"] or ():
        lo[p["qi"], p["slot"]], hi[p["qi"], p["slot"]] = -(-low * p["score"] // 100), high * p["score"] // 100
    return lo, hi


def _pairs(batches: Iterator[pa.RecordBatch], directory: dict, pivots: list[tuple[int, np.ndarray]], longest: float, ask: tuple | None, k: int, again: bool) -> Iterator[pa.RecordBatch]:
    """Blocks that each group of anchors has to read: those nearest in key, or (``again``) the others that can hold one of the first k."""
    centre = dict(pivots)
    for b in batches:
        for r in b.to_pylist():
            lo, hi = windows(r, ask)
            worst = lo.astype(np.float64)
            if again:
                seen = {}
                for f in r["found"] or ():
                    seen.setdefault((f["qi"], f["slot"]), []).append(f["score"])
                for (qi, slot), scores in seen.items():
                    if len(scores) >= k:
                        worst[qi, slot] = max(worst[qi, slot], min(scores))
            q, here = matrix(r), np.flatnonzero(directory["dim"] == r["dim"])
            norms = np.frombuffer(r["norms"])
            total = norms + longest
            to = {p: np.sqrt(np.maximum(total - (2 * (q @ centre[p]) if p >= 0 else 0), 0)) for p in set(directory["pivot"][here].tolist())}
            slack = 1e-6 * (1 + np.sqrt(total.max(initial=0)))
            first, needed = [], []
            for part in np.array_split(here, max(1, len(here) // 4096)):
                d = np.stack([to[p] for p in directory["pivot"][part].tolist()], axis=1) if len(part) else np.zeros((len(q), 0))
                near = np.maximum(np.maximum(d - directory["hi"][part], directory["lo"][part] - d) - slack, 0)
                far = d + directory["hi"][part] + slack
                most, least = (total[:, None] - near**2) / 2 + slack, (total[:, None] - far**2) / 2 - slack
                reach = np.zeros(len(part), bool)
                rank = np.full((len(q), len(part)), np.inf)
                for s in range(lo.shape[1]):
                    inside = (most >= worst[:, [s]]) & (least <= hi[:, [s]]) & (lo[:, [s]] <= hi[:, [s]])
                    reach |= inside.any(axis=0)
                    inside = (most >= lo[:, [s]]) & (least <= hi[:, [s]]) & (lo[:, [s]] <= hi[:, [s]])
                    rank = np.minimum(rank, np.where(inside, near + (hi[:, [s]] - np.minimum(most, hi[:, [s]])) / (1 + np.abs(hi[:, [s]])), np.inf))
                needed.append(part[reach])
                first.append((rank, part))
            rank, part = np.concatenate([x for x, _ in first], axis=1), np.concatenate([x for _, x in first])
            n = min(FIRST, len(part))
            some = np.argpartition(rank, n - 1, axis=1)[:, :n] if n else np.zeros((len(q), 0), np.int64)
            begun = np.unique(part[some[np.isfinite(np.take_along_axis(rank, some, axis=1))]])
            want = np.setdiff1d(np.concatenate(needed), begun) if again else begun
            yield pa.RecordBatch.from_arrays([pa.array(directory["block"][want]), pa.array(np.full(len(want), r["g"], np.int64))], ["block", "g"])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as long; a score that no long holds is an error."""
    if not q.shape[1] or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], object)
    return (whole(q) @ whole(x).T).astype(np.int64)


def _searched(batches: Iterator[pa.RecordBatch], ask: tuple | None, k: int) -> Iterator[pa.RecordBatch]:
    """The first k of what each anchor and slot finds in this task's blocks: same label without a window, another label with one."""
    best: dict[int, np.ndarray] = {}

    def out(g: int) -> pa.RecordBatch:
        a = best.pop(g)
        ids = pa.array([None if x else v for v, x in zip(a["id"].tolist(), a["none"].tolist(), strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), g)), pa.array(a["qi"]), pa.array(a["slot"]), pa.array(a["score"]), ids, pa.array(a["row"])], schema=_schema(_FOUND))

    for b in batches:
        for r in b.to_pylist():
            x, q = r["b"], r["a"]
            s = scores(matrix(q), matrix(x))
            rows = np.frombuffer(x["rows"], np.int64)
            same = np.frombuffer(q["labels"], np.int64)[:, None] == np.frombuffer(x["labels"], np.int64)[None, :]
            open_ = same & (np.frombuffer(q["rows"], np.int64)[:, None] != rows[None, :]) if ask is None else ~same
            lo, hi = windows(q, ask)
            ids, new = np.array([0 if i is None else i for i in x["ids"]], np.int64), []
            none = np.array([i is None for i in x["ids"]], bool)
            for slot in range(lo.shape[1]):
                ok = open_ & (s >= lo[:, [slot]]) & (s <= hi[:, [slot]])
                qi, at = np.nonzero(ok)
                if len(at) > k * len(s):
                    qi, at = _first(s, ok, k)
                new.append(np.rec.fromarrays([qi.astype(np.int32), np.full(len(at), slot, np.int32), s[qi, at], none[at], ids[at], rows[at]], names="qi,slot,score,none,id,row"))
            g = q["g"]
            best[g] = _kept(np.concatenate([*new, *([best.pop(g)] if g in best else [])]), k)
            if len(best) > 64:
                yield out(next(iter(best)))
    for g in list(best):
        yield out(g)


def _first(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k largest among those that are open; of equal ones the first stay."""
    width = s.shape[1]
    top = int(np.abs(s).max(initial=0))
    if top < (1 << 61) // width:
        rank = np.where(ok, s * width + (width - 1 - np.arange(width)), np.iinfo(np.int64).min)
        at = np.argpartition(rank, width - k, axis=1)[:, width - k :] if k < width else np.tile(np.arange(width), (len(s), 1))
    else:
        at = np.argsort(np.where(ok, -s, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    qi = np.repeat(np.arange(len(s)), at.shape[1])
    at = at.ravel()
    return qi[ok[qi, at]], at[ok[qi, at]]


def _kept(a: np.ndarray, k: int) -> np.ndarray:
    """The first k of each anchor and slot."""
    a = a[np.lexsort([a["row"], a["id"], a["none"], -a["score"], a["slot"], a["qi"]])]
    new = np.ones(len(a), bool)
    new[1:] = (a["qi"][1:] != a["qi"][:-1]) | (a["slot"][1:] != a["slot"][:-1])
    start = np.flatnonzero(new)
    return a[np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < k]


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot over all tasks, with their rank from 1."""
    order = W.partitionBy("g", "qi", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_group(found: DataFrame, name: str, *columns: str) -> DataFrame:
    return found.groupBy("g").agg(F.collect_list(F.struct(*columns)).alias(name))


def hard_negatives(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: Column | None = None, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, pivots: int = PIVOTS, block_rows: int = BLOCK,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of another label within a window of scores.

    Components are floor(``scale`` * x); a score is the inner product of these,
    exact; higher scores come first, ties by smaller id (null ids last), then by
    the scan.  An anchor's positives are its first ``positives`` other rows of
    its label; a positive of score p asks for the first ``negatives`` rows of
    other labels with low * p <= 100 * score <= high * p.  ``anchors`` is a
    condition on the columns of ``vectors`` (default: the id is divisible by
    100); a null condition is none.

    Rows with a null label or vector, or a component that is null or not finite
    (after scaling, too) take no part.  Vectors meet those of their own number
    of components only; one without components scores 0.  Rows that repeat are
    rows of their own, anchors too.  A score beyond a long is an error.  Other
    columns are not read; an empty table gives no rows.

    ``pivots`` rows, those of smallest hash of their number, are the fitted
    sample; every row is indexed, and nothing is approximate.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    v = F.col(f"`{vector_col}`")
    asked = F.col(f"`{id_col}`") % 100 == 0 if anchors is None else anchors
    rows = with_row_id(vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("anchor")
    ), "row_id").where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    rows = written(rows.mapInArrow(tidy(lambda batches: _quantised(batches, scale)), _ROWS))
    said = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("longest")).first()
    longest, most = said["longest"], max(block_rows, -(-said["n"] // DIRECTORY))
    sample = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(pivots).select("kind", "vector").collect()
    at = [(i, np.frombuffer(r["vector"], r["kind"]).astype(np.float64)) for i, r in enumerate(sample)]
    kept = _ROWS + ", pivot int, dist double"

    def sorted_blocks(part: DataFrame, most: int, by_pivot: bool, name: str) -> DataFrame:
        keyed = part.mapInArrow(tidy(lambda batches: _keyed(batches, at, longest)), kept).repartitionByRange("dim", "pivot", "dist", "row_id").sortWithinPartitions("dim", "pivot", "dist", "row_id")
        return written(keyed.mapInArrow(tidy(lambda batches: _blocks(batches, most, by_pivot)), _BLOCKS).withColumn(name, F.monotonically_increasing_id()))

    blocks, groups = sorted_blocks(rows, most, True, "block"), sorted_blocks(rows.where("anchor"), TOGETHER, False, "g")
    listed = blocks.select("block", "dim", "pivot", "lo", "hi").toArrow()
    directory = spark.sparkContext.broadcast({c: listed.column(c).to_numpy() for c in listed.column_names})
    small = groups.agg(F.coalesce(F.sum(F.length("vectors") + 32 * F.col("n")), F.lit(0))).first()[0] <= BROADCAST_BYTES

    def search(asking: DataFrame, ask: tuple | None, k: int) -> DataFrame:
        found, near = None, ["g", "rows", "labels", "n", "dim", "kind", "vectors", *(["positives"] if ask else [])]
        for again in (False, True):
            state = asking if found is None else asking.join(_by_group(found, "found", "qi", "slot", "score"), "g", "left")
            pairs = written(state.mapInArrow(tidy(_with(_pairs, directory, at, longest, ask, k, again)), "block long, g long"))
            few = pairs.count() <= BROADCAST_ROWS
            both = blocks.select("block", F.struct("rows", "ids", "labels", "n", "dim", "kind", "vectors").alias("b")).join(F.broadcast(pairs) if few else pairs.hint("merge"), "block")
            whose = asking.select("g", F.struct(*near).alias("a"))
            both = both.join(F.broadcast(whose) if small else whose.hint("merge"), "g").select("a", "b")
            new = both.mapInArrow(tidy(lambda batches: _searched(batches, ask, k)), _FOUND)
            found = written(_first_k(new if found is None else new.unionByName(found.drop("rank")), k))
        return found

    liked = search(groups, None, positives).withColumn("slot", (F.col("rank") - 1).cast("int"))
    asking = written(groups.join(_by_group(liked, "positives", "qi", "slot", "score"), "g"))
    disliked = search(asking, (positives, low, high), negatives)
    who = groups.select("g", F.posexplode("ids").alias("qi", "anchor_id"))
    chosen = liked.select("g", "qi", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(who, ["g", "qi"])
    out = disliked.select("g", "qi", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["g", "qi", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _with(f: Callable, directory, *rest) -> Callable[[Iterator], Iterator]:
    return lambda batches: f(batches, directory.value, *rest)
