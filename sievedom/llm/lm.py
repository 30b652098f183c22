"""A language model in Elias-Fano n-gram tries."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import shared_dir, small_arrow_batches, swept, tidy

#: Stands for the end of a text; as a context it also stands before the first word.
END = np.uint64(0x5EED0FE2D)
#: Characters of text for each shard of the model, and tokens gathered before their counts are sent on.
SHARD_CHARS, GATHERED = 24 << 20, 1_500_000
DISCOUNT = 0.75
ONE = np.uint64(1)


class EliasFano:
    """Ascending 64-bit numbers: their low bits packed, the number of each high part in unary.

    ``find`` looks up values by the zeros of the unary part (the successor
    search), ``get`` the values at some ranks by its ones.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self._ones = np.concatenate([[0], np.cumsum(ones)])
        self._zeros = np.arange(len(high) + 1) * 64 - self._ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            place = np.arange(n) * bits
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            np.add.at(low, word, part << shift)
            over = (place & 63) + bits > 64
            np.add.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, np.uint64)
        np.add.at(high, place >> 6, ONE << (place & 63).astype(np.uint64))
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i * self.bits
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        right = self.low[word] >> shift
        left = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (right | left) & np.uint64((1 << self.bits) - 1)

    def _select(self, j: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the j-th one or zero of the unary part."""
        before = self._ones if ones else self._zeros
        word = np.searchsorted(before, j, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        left = j - before[word]
        x = self.high[word] if ones else ~self.high[word]
        at = np.zeros(len(j), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((x >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= here
            left -= here * go
            at += step * go
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Rank of each value, -1 if it is not there."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high, most = values >> np.uint64(self.bits), int(self._zeros[-1]) - 1
        inside = high <= np.uint64(most)
        h = np.minimum(high, np.uint64(most)).astype(np.int64)
        low = values & np.uint64((1 << self.bits) - 1)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - h + 1, 0)
        hi = np.minimum(self._select(h, False) - h, self.n)
        end = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        there = inside & (lo < end)
        there[there] = self._low(lo[there]) == low[there]
        return np.where(there, lo, -1)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high]


def _file(spark_dir: str, name: str):
    """A file system and a path in it for a file of the shared folder."""
    from pyarrow import fs

    url = urlparse(spark_dir)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), f"{url.path}/{name}"
    system, path = fs.FileSystem.from_uri(spark_dir)
    return system, f"{path}/{name}"


def _store(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays under a name of this attempt and then moves them to ``name``, so a second attempt does no harm."""
    system, path = _file(folder, name)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(struct.pack("<q", len(arrays)))
        for a in arrays:
            out.write(struct.pack("<qq", len(a), " bBiIqQfd".index(a.dtype.char if a.dtype.char not in "lL" else {"l": "q", "L": "Q"}[a.dtype.char])))
        for a in arrays:
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    system.move(own, path)


def _load(folder: str, name: str) -> list[np.ndarray]:
    """The arrays, mapped into memory where the folder is a local one, else read."""
    system, path = _file(folder, name)
    if system.type_name == "local":
        body = pa.memory_map(path).read_buffer()
    else:
        with system.open_input_file(path) as f:
            body = f.read_buffer()
    (n,) = struct.unpack_from("<q", body, 0)
    at, out = 8 + 16 * n, []
    for i in range(n):
        size, kind = struct.unpack_from("<qq", body, 8 + 16 * i)
        a = np.frombuffer(body, np.dtype(" bBiIqQfd"[kind]), size, at)
        out.append(a)
        at += a.nbytes + -a.nbytes % 8
    return out


class Level:
    """All shards of a level, opened as they are needed."""

    def __init__(self, folder: str, kind: str, shards: int):
        self.folder, self.kind, self.shards, self.open = folder, kind, shards, {}

    def shard(self, s: int) -> list:
        if s not in self.open:
            a = _load(self.folder, f"{self.kind}-{s}")
            fano = lambda i: EliasFano(int(a[i][0]), int(a[i][1]), a[i + 1], a[i + 2])
            self.open[s] = [fano(0), a[3]] if self.kind == "words" else [fano(0), fano(3), a[6], a[7]]
        return self.open[s]


class Model:
    """Level 1: words (hashes) and counts.  Level 2: each word's successors, by rank, and quantised probabilities."""

    def __init__(self, folder: str, shards: int, starts: list[int], tokens: int):
        self.folder, self.shards, self.starts, self.tokens = folder, shards, np.array(starts, np.int64), tokens
        self.types = starts[-1]
        self.words, self.pairs = Level(folder, "words", shards), Level(folder, "pairs", shards)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: unknown) and count of each word hash."""
        rank, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        at = shard_of(hashes, self.shards)
        for s in np.unique(at):
            mine = np.flatnonzero(at == s)
            fano, counts = self.words.shard(int(s))
            found = fano.find(hashes[mine])
            known = found >= 0
            rank[mine[known]] = found[known] + self.starts[s]
            count[mine[known]] = counts[found[known]]
        return rank, count

    def counts(self, rank: np.ndarray) -> np.ndarray:
        """Counts of words by rank; opens the shards of these words alone, one after another."""
        out = np.zeros(len(rank), np.int64)
        at = np.searchsorted(self.starts, rank, "right") - 1
        for s in np.unique(at):
            mine = np.flatnonzero(at == s)
            out[mine] = self.words.shard(int(s))[1][rank[mine] - self.starts[s]]
            self.words.open.pop(int(s))
        return out

    def first_rank(self, s: int) -> int:
        """Contexts are dealt to the shards of pairs by rank."""
        return -(-s * self.types // self.shards)

    def uniform(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.1) / (self.tokens + 0.1 * (self.types + 1))

    def log10(self, before: np.ndarray, word: np.ndarray, n_before: np.ndarray, n_word: np.ndarray) -> np.ndarray:
        """log10 P(word | before), by ranks and counts: quantised where the pair was seen, else backed off to the word."""
        out = np.log10(self.uniform(n_word))
        seen = np.flatnonzero(before >= 0)
        key = before[seen].astype(np.uint64) * np.uint64(self.types + 1) + (word[seen] + 1).astype(np.uint64)
        key, first, back = np.unique(key, return_index=True, return_inverse=True)
        b, w, nb = before[seen][first], word[seen][first], n_before[seen][first]
        value = out[seen][first]
        shard = b * self.shards // self.types
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            pointers, successors, codes, book = self.pairs.shard(int(s))
            c = b[mine] - self.first_rank(int(s))
            kinds = (pointers.get(c + 1) - pointers.get(c)).astype(np.float64)
            value[mine] += np.log10(np.maximum(DISCOUNT * kinds, 1e-9) / nb[mine])
            ask = np.where(w[mine] >= 0, w[mine], 0).astype(np.uint64) + c.astype(np.uint64) * np.uint64(self.types)
            found = successors.find(ask)
            hit = (found >= 0) & (w[mine] >= 0)
            value[mine[hit]] = book[codes[found[hit]]]
        out[seen] = value[back]
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _with_end(t: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text's words, and the places where texts begin."""
    first = t.first + np.arange(len(t) + 1)
    out = np.empty(first[-1], np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[first[1:] - 1] = True
    out[is_end], out[~is_end] = END, t.hashes()
    return out, first


def _before(tokens: np.ndarray, first: np.ndarray, end) -> np.ndarray:
    out = np.roll(tokens, 1)
    out[first[:-1]] = end
    return out


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True)


def _merged(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in rows]), np.concatenate([np.frombuffer(c, np.uint32) for _, c in rows])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _send(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their counts as one row for each shard, so a shuffle moves few, compact rows."""
    cut = np.flatnonzero(np.diff(shard)) + 1
    lo, hi = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(keys)]]).astype(int)
    live = [(a, b) for a, b in zip(lo, hi, strict=True) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(shard[a]) for a, _ in live], pa.int64()),
            pa.array([keys[a:b].tobytes() for a, b in live], pa.binary()),
            pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in live], pa.binary()),
        ],
        ["shard", "k", "c"],
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows of one shard after another; rows come sorted by shard."""
    now, rows = None, []
    for b in batches:
        for s, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append((k, c))
    if rows:
        yield now, rows


def train(docs: DataFrame) -> Model:
    """Counts the texts of ``docs`` (column t) and writes the model's shards into the shared folder."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    folder = f"{shared_dir(spark)}/sievedom-lm-{uuid.uuid4().hex}"
    chars = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                kept.append(_with_end(t)[0])
                n += len(kept[-1])
                if n > GATHERED:
                    k, c = _counted(kept)
                    yield _send(k, c, shard_of(k, shards))
                    kept, n = [], 0
        if n:
            k, c = _counted(kept)
            yield _send(k, c, shard_of(k, shards))

    def build_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _shards(batches):
            k, c = _merged(rows)
            _store(folder, f"words-{s}", [*EliasFano.of(k, 1 << 64).parts(), c])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["shard", "n", "tokens"])

    rows = "shard long, k binary, c binary"
    sent = docs.mapInArrow(tidy(words), rows).repartition(shards, "shard").sortWithinPartitions("shard")
    with swept(spark):
        made = {r.shard: r for r in sent.mapInArrow(tidy(build_words), "shard long, n long, tokens long").collect()}  # one row for each shard
    for s in set(range(shards)) - set(made):
        _store(folder, f"words-{s}", [*EliasFano.of(np.empty(0, np.uint64), 1 << 64).parts(), np.empty(0, np.int64)])
    starts = [0]
    for s in range(shards):
        starts.append(starts[-1] + (made[s].n if s in made else 0))
    if starts[-1] >= 1 << 31:
        raise ValueError("over 2**31 distinct words: a pair of ranks does not fit 64 bits")
    model = Model(folder, shards, starts, sum(r.tokens for r in made.values()))
    if not model.types:
        return model

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(folder, shards, starts, model.tokens)
        kept, n = [], 0

        def flush() -> pa.RecordBatch:
            hashes, back = np.unique(np.concatenate([h for h, _ in kept]), return_inverse=True)
            rank = own.look_up(hashes)[0]
            end = int(rank[np.searchsorted(hashes, END)])
            at, keys = 0, []
            for h, first in kept:
                r = rank[back[at : at + len(h)]]
                keys.append(_before(r, first, end).astype(np.uint64) * np.uint64(own.types) + r.astype(np.uint64))
                at += len(h)
            k, c = _counted(keys)
            return _send(k, c, ((k // np.uint64(own.types)).astype(np.int64) * shards) // own.types)

        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                kept.append(_with_end(t))
                n += len(kept[-1][0])
                if n > GATHERED:
                    yield flush()
                    kept, n = [], 0
        if n:
            yield flush()

    def build_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(folder, shards, starts, model.tokens)
        for s, rows in _shards(batches):
            k, c = _merged(rows)
            lo, hi = own.first_rank(s), own.first_rank(s + 1)
            before, word = (k // np.uint64(own.types)).astype(np.int64), (k % np.uint64(own.types)).astype(np.int64)
            pointers = np.searchsorted(before, np.arange(lo, hi + 1))
            kinds = np.diff(pointers)
            total = np.add.reduceat(np.append(c, 0), np.minimum(pointers[:-1], len(c))) * (kinds > 0)
            kinds_of, back = np.unique(word, return_inverse=True)
            held = own.counts(kinds_of)[back] if len(k) else np.empty(0)
            ctx = before - lo
            p = (c - DISCOUNT) / total[ctx] + DISCOUNT * kinds[ctx] / total[ctx] * own.uniform(held)
            lp = np.log10(p)
            least = float(lp.min()) if len(lp) else 0.0
            book = least * (1 - np.arange(256) / 255)
            codes = np.rint((1 - lp / least) * 255).astype(np.uint8) if least < 0 else np.full(len(lp), 255, np.uint8)
            relative = k - np.uint64(lo * own.types)
            _store(folder, f"pairs-{s}", [*EliasFano.of(pointers.astype(np.uint64), len(k) + 1).parts(), *EliasFano.of(relative, (hi - lo) * own.types).parts(), codes, book])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(k)], pa.int64())], ["shard", "n"])

    sent = docs.mapInArrow(tidy(pairs), rows).repartition(shards, "shard").sortWithinPartitions("shard")
    with swept(spark):
        built = {r.shard for r in sent.mapInArrow(tidy(build_pairs), "shard long, n long").collect()}  # one row for each shard
    for s in set(range(shards)) - built:
        lo, hi = model.first_rank(s), model.first_rank(s + 1)
        _store(folder, f"pairs-{s}", [*EliasFano.of(np.zeros(hi - lo + 1, np.uint64), 1).parts(), *EliasFano.of(np.empty(0, np.uint64), 1).parts(), np.empty(0, np.uint8), np.zeros(256)])
    return model


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0) -> DataFrame:
    """log10 probability of every whole text under a bigram model of the training texts.

    Trained on all rows whose crc32(id as text) modulo ``folds`` is not
    ``held_fold``.  Tokens are words between ASCII white space, A-Z lower-cased,
    then one end.  Words are counted exactly; their successors' probabilities,
    discounted and interpolated with the words', are quantised to 8 bits.  The
    model lies in shards that grow with the corpus, each built by one task from
    compact counts and mapped into memory where it is asked.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    A null or empty text is its end alone; a null id counts as empty text in
    the split (crc32 0); rows that repeat count and score each for itself; an
    empty table gives no rows, and with no training rows every token is unknown;
    other columns are not read, whatever their names.
    """
    part = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held_fold
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    made = train(base.where("not held_out").select("t"))
    about = made.folder, made.shards, made.starts.tolist(), made.tokens
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*about)
        for b in batches:
            for t in W.texts(b.column("t"), lower=True):
                tokens, first = _with_end(t)
                hashes, back = np.unique(tokens, return_inverse=True)
                rank, count = model.look_up(hashes)
                end = int(rank[np.searchsorted(hashes, END)])
                r, c = rank[back], count[back]
                base_log = np.log10(model.uniform(c))
                n_end = int(count[np.searchsorted(hashes, END)])
                log = model.log10(_before(r, first, end), r, _before(c, first, n_end), c) if model.types else base_log
                each = lambda v: np.add.reduceat(v, first[:-1])
                n = np.diff(first)
                out = [b.column("doc_id").slice(t.rows.start, len(t)), b.column("held_out").slice(t.rows.start, len(t)), pa.array(n), pa.array(each((c > 0).astype(np.int64)))]
                out += [pa.array(np.full(len(t), model.tokens, np.int64)), pa.array(each(base_log)), pa.array(each(log))]
                yield pa.RecordBatch.from_arrays(out, names)

    return base.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
