"""N-gram Jaccard join by partitioning the universe of shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, only_rows, rejoin, small_arrow_batches, tidy, with_row_id, without_rows, written

#: Sizes of the bands of set sizes grow by this.
GROWTH = 1.35
#: Share of sets that a frequent shingle (of a passage that many texts have) is taken to be in.
FREQUENT = 0.1
#: Rounds in which nodes are tried with the fullest node of their buckets.
HUB_ROUNDS = 1
#: Counters of the table by which shingles are ranked, a byte each; the ranks give an order, so their coarseness costs tries and no links.
SLOTS = 1 << 22
#: Counters in each block of that table.
BLOCK = 1 << 16
#: Signatures in each part into which they are dealt, compactly held by a worker, and slices in which it looks at them.
PART_SIGNATURES, PART_SLICES = 1_000_000, 8
#: Sets of a component that are counted against as many others at once, about, and columns of their incidence table at once.
CROWD, COLUMNS = 128, 1 << 14
_SALT = np.uint64(0xA24BAED4963EE407)


def sets(t: W.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, one text after another, and where each begins.

    A text with fewer words has one shingle, of all its words.
    """
    hashes, n = t.hashes(), np.diff(t.first)
    h, place = W.windows(hashes, t.first, k)
    doc = np.searchsorted(t.first, place, "right") - 1
    for short in range(1, k):
        few = np.flatnonzero(n == short)
        if len(few):
            total = np.zeros(len(few), np.uint64)
            for i in range(short):
                total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[t.first[few] + i]
            h, doc = np.concatenate([h, W.mixed(total + np.uint64(short))]), np.concatenate([doc, few])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    at = np.searchsorted(doc, np.arange(len(t) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(t)))]).astype(np.int64)


def _set_ids(values: np.ndarray, at: np.ndarray, seed: int, bits: int = 64) -> np.ndarray:
    """A 64-bit number for each set; of fewer ``bits`` for tests."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(W.mixed(values ^ np.uint64(int(_SALT) * seed % 2**64)), out=total[1:])
    return (W.mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


@dataclass(frozen=True)
class Names:
    """Numbers of sets: their first hash, or another for those of which it is also a different set's (told by a second hash)."""

    bits: int
    other: dict

    def of(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = _set_ids(values, at, 1, self.bits)
        if self.other:
            same = np.flatnonzero(np.isin(out, np.array([n for n, _ in self.other], np.int64)))
            if len(same):
                check = _set_ids(values, at, 2)
                out[same] = [self.other.get((int(out[i]), int(check[i])), int(out[i])) for i in same]
        return out


def _renamed(rows: DataFrame, bits: int) -> tuple[DataFrame, Names]:
    """``rows`` with a number of its own for each different set, and how sets come by theirs."""
    shared = rows.where("node is not null").groupBy("node", "check").agg(F.lit(1)).groupBy("node").agg(F.array_sort(F.collect_set("check")).alias("checks"))
    # sets of one 64-bit hash: of 1e10 sets about three pairs
    clashes = shared.where(F.size("checks") > 1).select("node", "checks").collect()
    other = {}
    for r in clashes:
        for c in r["checks"][1:]:
            x = np.array([r["node"], c], np.int64).view(np.uint64)
            other[(r["node"], c)] = int(W.mixed(W.mixed(x[:1]) ^ x[1:] * _SALT).view(np.int64)[0])
    if not other:
        return rows, Names(bits, {})
    new = rows.sparkSession.createDataFrame([(n, c, x) for (n, c), x in other.items()], "node long, check long, _new long")
    rows = rows.join(F.broadcast(new), ["node", "check"], "left").withColumn("node", F.coalesce("_new", "node"))
    return written(rows.select("doc_id", "row_id", "n_shingles", "node", "check", "sketch")), Names(bits, other)


def sketch(v: np.ndarray) -> bytes:
    """Counts of a set's hashes by their first bits, about one for each 8 to 16; two sets' counts differ by no more than the sets."""
    bits = max(4, len(v).bit_length() - 4)
    return np.minimum(np.bincount((v >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def can_link(x: bytes, y: bytes, n: int, m: int, p: int, q: int) -> bool:
    """Whether sets of n and m shingles with these sketches can have similarity p / q."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(a), len(b))
    a, b = a.reshape(size, -1).sum(1), b.reshape(size, -1).sum(1)
    return int(np.abs(a - b).sum()) <= n + m - 2 * -(-p * (n + m) // (p + q))


def slots(v: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (v >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def rarest(v: np.ndarray, ranks: np.ndarray, p: int, q: int) -> np.ndarray:
    """The shingles of one set that come first by rank and hash, as many as two similar sets cannot both miss.

    Sets of similarity p / q have p / q of each in common.  In one order of all
    shingles, the first they share is among these of both.
    """
    return v[np.lexsort((v, ranks[slots(v)]))[: len(v) - -(-p * len(v) // q) + 1]]


def linked(sets_: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Which of these sorted sets have similarity p / q or more, as a table, true with themselves."""
    n = np.array([len(v) for v in sets_])
    h = np.concatenate(sets_)
    universe, column = np.unique(h, return_inverse=True)
    row = np.repeat(np.arange(len(sets_)), n)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(sets_), len(sets_)), np.int64)
    for a in range(0, len(universe), COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        table = np.zeros((len(sets_), min(COLUMNS, len(universe) - a)), np.float32)
        table[row[i:j], column[i:j] - a] = 1
        both += (table @ table.T).astype(np.int64)
    return both * q >= (n[:, None] + n[None, :] - both) * p


@dataclass(frozen=True)
class Band:
    """Sets of low to high - 1 shingles as the larger of a pair, and how they are cut into segments."""

    no: int
    low: int
    high: int
    segments: int = 0
    deletions: int = 0  # the first segments also give their subsets without one shingle
    weak: int = -1  # segments with so many shingles or fewer are not indexed
    spared: int = 0  # if a set has no more of them than this


@cache
def sizes(most: int) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def _poisson(mean: float, j: int) -> float:
    return math.exp(-mean) * mean**j / math.factorial(j)


def allocated(no: int, low: int, high: int, n_sets: int, p: int, q: int) -> Band:
    """The cheapest cut of a band: pairs of similarity p / q differ in at most H shingles.

    Of H + 1 + e exact segments more than e agree.  Equal segments are equally
    weak, so a set with at most e weak ones need not index these, which would
    bring unrelated sets together.  A segment that also gives its one-deletion
    subsets bears two differences, so fewer and larger ones do.  The cost is
    that of the signatures plus that of moving the sets of chance candidates,
    which grows with the sets in the band: both texts have a passage in common
    and nothing else in a segment.
    """
    most = 2 * (high - 1) * (q - p) // (q + p)
    if not most:
        return Band(no, low, high)  # only equal sets are similar
    n, best = (low + high) / 2, None

    def chance(m: int, weak: int) -> float:
        mean = n / m
        return n_sets * m * math.exp(-mean) * sum(_poisson(mean, j) * FREQUENT ** (j + (j > 0)) for j in range(weak + 1, weak + 8))

    for weak in range(-1, 4):
        spared = 0
        for _ in range(8 * (weak >= 0)):
            m = most + 1 + spared
            spared = int(1.6 * m * sum(_poisson(low / m, j) for j in range(weak + 1))) + 1
        m = most + 1 + spared
        if m <= 2 * most + 2:
            cost = m + n * chance(m, weak)
            if best is None or cost < best[0]:
                best = cost, Band(no, low, high, m, 0, weak, spared)
    for eighth in range(1, 9):
        deletions = (most + 1) * eighth // 16 or (eighth == 8)
        m = most + 1 - deletions
        if deletions <= m:
            cost = m + deletions * n / m + n * chance(m, -1) * (1 + n / m)
            if cost < best[0]:
                best = cost, Band(no, low, high, m, deletions)
    return best[1]


@cache
def _edges(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], np.uint64)


def signatures(v: np.ndarray, marks: np.ndarray, sums: np.ndarray, band: Band) -> np.ndarray:
    """Signatures of one sorted set: marks are its shingles' marks and sums their running sums from 0."""
    cut = np.concatenate([[0], np.searchsorted(v, _edges(band.segments)), [len(v)]])
    part = sums[cut[1:]] - sums[cut[:-1]]
    number = (np.arange(band.segments, dtype=np.uint64) + np.uint64(band.no << 32)) * np.uint64(0xD1342543DE82EF95)
    full = cut[1:] - cut[:-1] > band.weak
    keep = full if band.segments - np.count_nonzero(full) <= band.spared else slice(None)
    out = W.mixed(part * _SALT + number)[keep]
    if band.deletions:
        seg = np.repeat(np.arange(band.deletions), np.diff(cut[: band.deletions + 1]))
        out = np.concatenate([out, W.mixed((part[seg] - marks[: len(seg)]) * _SALT + number[seg])])
    return out


def _bands_of(n: int, bands: list[Band], starts: np.ndarray, p: int, q: int) -> list[Band]:
    """The band of n, and those above in which a similar larger set can be."""
    i = int(np.searchsorted(starts, n, "right")) - 1
    j = i + 1
    while j < len(bands) and bands[j].low * p <= n * q:
        j += 1
    return [b for b in bands[i:j] if b.segments]


def dealt(sigs: np.ndarray, nodes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Signatures and their nodes as one row for each part: 48 bits of each signature, and runs of equal nodes.

    A part holds about PART_SIGNATURES of them at any size, so 48 bits tell
    them apart; a chance clash costs a try.
    """
    part = ((sigs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, nodes = part[order], nodes[order]
    low = np.ascontiguousarray(sigs[order]).view(np.uint16).reshape(-1, 4)[:, :3]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    rows = [[], [], [], []]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        run = np.flatnonzero(np.concatenate([[True], nodes[a + 1 : b] != nodes[a : b - 1]]))
        for row, value in zip(rows, (int(part[a]), low[a:b].tobytes(), nodes[a:b][run].tobytes(), np.diff(np.append(run, b - a)).astype(np.uint32).tobytes()), strict=True):
            row.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]], ["part", "s", "x", "c"])


def undealt(part: int, s: bytes, x: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (48 bits, and the part above them) and nodes of a row of ``dealt``."""
    low = np.zeros((len(s) // 6, 4), np.uint16)
    low[:, :3] = np.frombuffer(s, np.uint16).reshape(-1, 3)
    low[:, 3] = part & 0xFFFF
    return low.view(np.int64).ravel(), np.repeat(np.frombuffer(x, np.int64), np.frombuffer(c, np.uint32))


class Leaders:
    """The first node of each signature of a part, while a part's signatures stream by: a hot one takes no memory."""

    def __init__(self):
        self.known, self.leads = np.empty(0, np.int64), np.empty(0, np.int64)

    def take(self, s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signature, leader and node, where these are two."""
        order = np.lexsort((x, s))
        s, x = s[order], x[order]
        begins = np.concatenate([[True], s[1:] != s[:-1]])
        one, lead = s[begins], x[begins]
        at = np.searchsorted(self.known, one)
        old = np.zeros(len(one), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == one[inside]
        lead[old] = self.leads[at[old]]
        self.known = np.insert(self.known, at[~old], one[~old])
        self.leads = np.insert(self.leads, at[~old], lead[~old])
        lead = lead[np.cumsum(begins) - 1]
        take = lead != x
        take[1:] &= begins[1:] | (x[1:] != x[:-1])
        return s[take], lead[take], x[take]


def _jump(parents: DataFrame) -> DataFrame:
    """A forest's edges node -> parent as node -> root, by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        new = written(rejoin(parents, up, ["parent"]).select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        parents = new.select("node", "parent")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, root (one node of its component) of all nodes of the edges a, b that aren't their own root.

    Each round, nodes point to their smallest neighbour if it is smaller, the
    forest is flattened, and the edges are contracted to its roots.
    """
    spark, found = edges.sparkSession, None
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        up = both.groupBy("node").agg(F.min("other").alias("parent")).where("parent < node")
        up = _jump(written(up))
        if found is None:
            found = up
        else:
            old = rejoin(found, up.toDF("parent", "_up"), ["parent"]).select("node", F.coalesce("_up", "parent").alias("parent"))
            found = written(old.unionByName(up.join(found.select("node"), "node", "left_anti")))
        edges = rejoin(edges, up.toDF("a", "_a"), ["a"]).select(F.coalesce("_a", "a").alias("a"), "b")
        edges = rejoin(edges, up.toDF("b", "_b"), ["b"]).select("a", F.coalesce("_b", "b").alias("b"))
        edges = written(edges.where("a <> b").distinct())
    if found is None:
        return spark.createDataFrame([], "node long, root long")
    return found.withColumnRenamed("parent", "root")


def _rooted(df: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Adds the root of column ``name`` as ``name``_root."""
    out = rejoin(df, roots.select(F.col("node").alias(name), F.col("root").alias("_root")), [name])
    return out.withColumn(f"{name}_root", F.coalesce("_root", name)).drop("_root")


def jaccard_join(
    docs: DataFrame, *, k: int = 4, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text", count_links: bool = True, hash_bits: int = 64
) -> DataFrame:
    """Components of the texts' similarity graph: one row for each row of ``docs``.

    A text's set holds its distinct k-word shingles (words between ASCII white
    space, A-Z lower-cased; fewer words: one shingle of all).  Two texts link
    when intersection * q >= union * p, with ``similarity`` = (p, q).

    Equal sets become one node.  The universe of shingle hashes is partitioned
    into segments, as many as a band of set sizes needs; nodes with an equal
    segment (or one with a shingle deleted) are in one bucket.  Signatures move
    in compact rows, dealt to parts of one size by their hash, and stream by
    there; a node is first tried with the first node of most of its buckets, then HUB_ROUNDS times
    with the node that is in the fullest buckets (an original is in more of them than its
    altered copies).  Nodes of buckets that then have several components
    are paired once more by their rarest shingles, which similar sets cannot
    miss, nor have too far back: a passage that many texts have makes no pairs,
    and texts with many words of their own few.  A try compares sketches, which bound the
    difference, then the whole sets.  So every link lies within a component,
    yet finding a group of near copies costs a pair for each of its nodes.

    All links of a component's nodes are counted once the components are known:
    its nodes are dealt into blocks of about CROWD, and each two blocks meet in
    one place, where whole sets are compared.  That makes a row for each node
    and block of its component, the work of a component growing with the square
    of its distinct sets; ``count_links`` leaves it out (n_links is null).

    A set's number is a 64-bit hash; where a second hash tells that two sets have
    one, they get others.  ``hash_bits`` below 64 weakens the first (for tests).

    Returns doc_id, n_shingles, component_id (smallest id reachable), n_links
    (other nodes, thus distinct sets, that the row's node links to), row_id and root (a
    number of the component, null for an empty set).  A null
    or empty text has an empty set and its own component; a null id does not
    count as smallest (a component of null ids has a null one); rows that repeat
    are in one component; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    small_arrow_batches(docs.sparkSession)
    p, q = similarity
    base = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), "row_id")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                v, at = sets(t, k)
                n = np.diff(at)
                cols = [b.column(c).slice(t.rows.start, len(t)) for c in ("doc_id", "row_id")]
                cols += [pa.array(n), pa.array(_set_ids(v, at, 1, hash_bits), mask=n == 0), pa.array(_set_ids(v, at, 2), mask=n == 0)]
                cols.append(pa.array([sketch(v[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_id", "n_shingles", "node", "check", "sketch"])

    rows = written(base.mapInArrow(tidy(name), "doc_id long, row_id long, n_shingles long, node long, check long, sketch binary"))
    rows, names = _renamed(rows, hash_bits)
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row_id").alias("row_id"), F.first("n_shingles").alias("n")))
    largest = nodes.agg(F.max("n")).first()[0] or 1
    starts = sizes(largest)
    low = F.array(*[F.lit(s) for s in starts])
    held = {r.band: r["count"] for r in nodes.groupBy(F.size(F.filter(low, lambda s: s <= F.col("n"))).alias("band")).count().collect()}  # one row for each band
    bands = [allocated(i, a, b, held.get(i + 1, 0) + held.get(i, 0), p, q) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))]
    lows = np.array([b.low for b in bands])

    total = sum(
        held.get(i + 1, 0) * sum(c.segments + (c.deletions * b.high // c.segments) for c in _bands_of(b.low, bands, lows, p, q)) for i, b in enumerate(bands)
    )
    parts = max(1, -(-total // PART_SIGNATURES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: its copies need no second index
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                v, at = sets(t, k)
                ids = names.of(v, at)
                marks = W.mixed(v ^ _SALT)
                sums = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(marks, out=sums[1:])
                sigs, owners = [], []
                for node, lo, hi in zip(ids.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if hi == lo or node in seen:
                        continue
                    seen.add(node)
                    for band in _bands_of(hi - lo, bands, lows, p, q):
                        sigs.append(signatures(v[lo:hi], marks[lo:hi], sums[lo : hi + 1], band))
                        owners.append(np.full(len(sigs[-1]), node, np.int64))
                if sigs:
                    yield dealt(np.concatenate(sigs), np.concatenate(owners), parts)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i, lead in enumerate(leaders):
                some = [(s[m], x[m]) for s, x in (undealt(*r) for r in rows) if (m := s & (PART_SLICES - 1) == i).any()]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in lead.take(*map(np.concatenate, zip(*some, strict=True)))], ["sig", "leader", "node"])

        now, leaders, waiting, n = None, [], [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != now or n > PART_SIGNATURES:
                    yield from out(waiting)
                    waiting, n = [], 0
                    if row[0] != now:
                        now, leaders = row[0], [Leaders() for _ in range(PART_SLICES)]
                waiting.append(row)
                n += len(row[1]) // 6
        yield from out(waiting)

    sigs = base.select("t").mapInArrow(tidy(index), "part long, s binary, x binary, c binary").repartition(parts, "part").sortWithinPartitions("part")
    members = written(sigs.mapInArrow(tidy(buckets), "sig long, leader long, node long"))
    tried = written(members.groupBy("leader", "node").count().select(F.col("leader").alias("a"), F.col("node").alias("b"), "count"))

    sketches = written(rows.join(nodes.select("node", "row_id"), ["node", "row_id"]).select("node", "n_shingles", "sketch"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = [can_link(x, y, n, m, p, q) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True)]
            yield b.filter(pa.array(fit, pa.bool_())).select(["a", "b"])

    def sifted(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches leave open."""
        pairs = rejoin(pairs.select("a", "b"), sketches.toDF("b", "nb", "sb"), ["b"], "inner")
        pairs = rejoin(pairs, sketches.toDF("a", "na", "sa"), ["a"], "inner")
        pairs = pairs.where((F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p))
        return written(pairs.mapInArrow(tidy(possible), "a long, b long"))  # a table of its own, which verified() discards

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                v, at = sets(t, k)
                body = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names.of(v, at)), body], ["node", "s"])

    def verified(pairs: DataFrame) -> DataFrame:
        sieved = pairs = sifted(pairs)
        asked = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
        wanted = written(nodes.join(asked, "node").select("row_id"))
        whole = only_rows(base.select("row_id", "t"), wanted, "row_id", keep=True).select("t").mapInArrow(tidy(collect), "node long, s array<long>")
        whole = written(whole)
        pairs = rejoin(pairs, whole.toDF("b", "sb"), ["b"], "inner")
        pairs = rejoin(pairs, whole.toDF("a", "sa"), ["a"], "inner")
        both = F.size(F.array_intersect("sa", "sb"))
        found = written(pairs.where(both * (p + q) >= (F.size("sa") + F.size("sb")) * p).select("a", "b"))
        discard(sieved, wanted, whole)
        return found

    best = tried.groupBy("b").agg(F.max_by("a", "count").alias("a")).select("a", "b")
    links = verified(best)
    roots = components(links)
    apart = lambda df: _rooted(_rooted(df, roots, "a"), roots, "b").where("a_root <> b_root")

    def unsettled() -> DataFrame:
        """Nodes of buckets that have nodes of several components: sig, a, a_root."""
        open_ = written(apart(members.toDF("sig", "a", "b")).select("sig").distinct())
        found = rejoin(members, open_.withColumn("open", F.lit(True)), ["sig"], "inner")
        found = found.select("sig", F.col("node").alias("a")).union(found.select("sig", "leader")).distinct()
        found = written(_rooted(found, roots, "a"))
        discard(open_)
        return found

    inside = unsettled()
    for _ in range(HUB_ROUNDS):
        if inside.isEmpty():
            break
        held = inside.groupBy("sig").agg(F.count("*").alias("many"))
        weight = rejoin(inside.select("sig", "a"), held, ["sig"]).groupBy("a").agg(F.sum("many").alias("weight"))
        weighed = written(rejoin(inside, weight, ["a"]))
        hubs = weighed.groupBy("sig").agg(F.max_by("a", F.struct("weight", "a")).alias("b"), F.max_by("a_root", F.struct("weight", "a")).alias("b_root"))
        near = rejoin(weighed, hubs, ["sig"]).where("a_root <> b_root").groupBy("a", "b").agg(F.count("*").alias("many"))
        near = near.groupBy("a").agg(F.max_by("b", F.struct("many", "b")).alias("b"))
        new = verified(near)
        discard(weighed)
        if new.isEmpty():
            break
        links = written(links.unionByName(new.select("a", "b")))
        roots = components(links)
        discard(inside)
        inside = unsettled()

    def crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                at, many = np.unique(slots(sets(t, k)[0]), return_counts=True)
                counts[at] += many.astype(np.uint32)
        used = np.flatnonzero(counts)
        cut = np.searchsorted(used, np.arange(0, SLOTS + 1, BLOCK))
        some = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        place, many = (used % BLOCK).astype(np.uint16), counts[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in some], pa.int64()), pa.array([place[a:b].tobytes() for _, a, b in some], pa.binary()), pa.array([many[a:b].tobytes() for _, a, b in some], pa.binary())], ["block", "place", "many"]
        )

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, place, many in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total.setdefault(block, np.zeros(BLOCK, np.uint64))[np.frombuffer(place, np.uint16)] += np.frombuffer(many, np.uint32)
        body = [np.minimum(255, 6 * np.log2(1 + c.astype(float))).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(body, pa.binary())], ["block", "ranks"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                v, at = sets(t, k)
                first = [rarest(v[i:j], ranks, p, q) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = np.array([len(f) for f in first])
                h = np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(names.of(v, at), n)), pa.array(np.repeat(np.diff(at), n)), pa.array(np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n))], ["h", "node", "n", "i"])

    open_nodes = written(rejoin(inside.select(F.col("a").alias("node")).distinct(), nodes.select("node", "row_id"), ["node"], "inner").select("row_id"))
    texts = only_rows(base.select("row_id", "t"), open_nodes, "row_id", keep=True).select("t")
    ranks = np.zeros(SLOTS, np.uint8)
    # SLOTS bytes, whatever the input
    for r in texts.mapInArrow(tidy(crowds), "block long, place binary, many binary").repartition("block").mapInArrow(tidy(ranked), "block long, ranks binary").collect():
        ranks[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["ranks"], np.uint8)
    firsts = written(_rooted(texts.mapInArrow(tidy(rare), "h long, node long, n long, i long"), roots, "node"))
    # the largest component of a shingle needs no pairs of its own nodes
    held = firsts.groupBy("h", "node_root").agg(F.count("*").alias("many")).groupBy("h").agg(F.max_by("node_root", "many").alias("big"), F.count("*").alias("roots"))
    firsts = written(rejoin(firsts, held.where("roots > 1"), ["h"], "inner").select("h", "node", "n", "i", "node_root", "big"))
    one = firsts.where("node_root <> big").select("h", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("node_root").alias("a_root"), "big")
    two = firsts.select(F.col("h").alias("h2"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("node_root").alias("b_root"))
    # what comes before the first shingle that both have is in one of them only
    fits = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (p + q) >= (F.col("na") + F.col("nb")) * p
    once = (F.col("a") < F.col("b")) | (F.col("b_root") == F.col("big"))
    pairs = one.join(two, (F.col("h") == F.col("h2")) & (F.col("a_root") != F.col("b_root")) & fits & once)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links.unionByName(verified(pairs)))
    roots = components(links)
    named = _rooted(nodes.select("node", "first_id"), roots, "node")
    firsts = named.groupBy("node_root").agg(F.min("first_id").alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(one: int, two: int, group: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            link = linked([v for _, _, v in group], p, q)
            np.fill_diagonal(link, False)
            if one != two:  # links within a block are counted where it meets itself
                block = np.array([x for _, x, _ in group])
                link &= block[:, None] != block[None, :]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in group], pa.int64()), pa.array(link.sum(1).astype(np.int64))], ["node", "many"])

        now, group = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("node_root", "one", "two", "node", "block")]
            for root, one, two, node, block, v in zip(*cols, b.column("s"), strict=True):
                if (root, one, two) != now:
                    if group:
                        yield out(*now[1:], group)
                    now, group = (root, one, two), []
                group.append((node, block, v.values.to_numpy().view(np.uint64).copy()))
        if group:
            yield out(*now[1:], group)

    if count_links:
        held = named.groupBy("node_root").agg(F.count("*").alias("many")).where("many > 1")
        mates = written(rejoin(named.select("node", "node_root"), held.withColumn("blocks", F.ceil(F.col("many") / CROWD)), ["node_root"], "inner").select("node", "node_root", "blocks"))
        wanted = written(rejoin(mates.select("node"), nodes.select("node", "row_id"), ["node"], "inner").select("row_id"))
        whole = written(only_rows(base.select("row_id", "t"), wanted, "row_id", keep=True).select("t").mapInArrow(tidy(collect), "node long, s array<long>"))
        mates = rejoin(whole, mates, ["node"], "inner").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        mates = mates.select("node", "node_root", "block", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        mates = mates.select("node", "node_root", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "s")
        meet = mates.repartition("node_root", "one", "two").sortWithinPartitions("node_root", "one", "two")
        degree = written(meet.mapInArrow(tidy(count), "node long, many long").groupBy("node").agg(F.sum("many").alias("n_links")))
        named = rejoin(named, degree, ["node"])
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    named = rejoin(named, firsts, ["node_root"]).select("node", F.col("node_root").alias("root"), "component_id", "n_links")
    out = rejoin(rows, named, ["node"])
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.coalesce("n_links", F.lit(0)) if count_links else F.col("n_links")).cast("long").alias("n_links"), "row_id", "root",
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of smallest id stays (null ids last, then by place)."""
    found = written(jaccard_join(docs, count_links=False, **how).where("root is not null").select("row_id", "doc_id", "root"))
    stay = found.groupBy("root").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first_id"))
    first = rejoin(found, stay, ["root"]).where(F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("first_id"))
    first = first.groupBy("root").agg(F.min("row_id").alias("first_row"))
    return without_rows(docs, rejoin(found, first, ["root"]).where("row_id <> first_row"))
