"""Harmonic packing of token ids into sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import release, small_arrow_batches, tidy, written
from .words import texts

END = 1
#: Places for entries of a worker's table of white-space-free pieces of text (20 bytes each, half of them at most are used), and ids that it holds at most.
PLACES, IDS = 1 << 21, 1 << 22
#: Reciprocal pieces cut from what remains of a document after its full sequences.
CUTS = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(n: int, capacity: int, cuts: int = CUTS) -> list[int]:
    """Lengths into which n ids are cut: full sequences, then reciprocals of the capacity, then the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for _ in range(cuts):
        if not n:
            break
        k = -(-capacity // n)
        while capacity // k > n:
            k += 1
        out.append(capacity // k)
        n -= capacity // k
    return out + [n] * (n > 0)


#: What a tokenizer file must say for its texts to be taken apart at spaces; fixed values of the file's format.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Latin letters that have one lower case each, and marks after them that begin nothing else: no apostrophe, and no "<", with which special tokens begin.
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([.,;:!?#$%&*()\[\]{}=+/\\\"@^~>|-]*)").fullmatch


class Pieces:
    """Ids of pieces of text by two hashes of theirs, 96 bits in all; a numpy table with linear probing."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint32)
        self.start, self.size = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int32)
        self.ids, self.used, self.held = np.empty(1 << 16, np.uint32), 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each piece, -1 if it is not there."""
        at = (key >> np.uint64(65 - PLACES.bit_length())).astype(np.int64)
        here = self.key[at]
        out = np.where((here == key) & (self.check[at] == check), at, -1)
        todo = np.flatnonzero((out < 0) & (here != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % PLACES
            here = self.key[at[todo]]
            hit = (here == key[todo]) & (self.check[at[todo]] == check[todo])
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (here != 0)]
        return out

    def put(self, key: np.ndarray, check: np.ndarray, ids: list[bytes]) -> None:
        """Pieces that are not there, each once."""
        size = np.array([len(x) // 4 for x in ids], np.int32)
        start, body = self.held + np.cumsum(size, dtype=np.int64) - size, np.frombuffer(b"".join(ids), "<u4")
        if self.held + len(body) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], np.empty(max(len(body), self.held), np.uint32)])
        self.ids[self.held : self.held + len(body)] = body
        self.held, self.used = self.held + len(body), self.used + len(key)
        at, todo = (key >> np.uint64(65 - PLACES.bit_length())).astype(np.int64), np.arange(len(key))
        while len(todo):
            free = self.key[at[todo]] == 0
            place, first = np.unique(at[todo[free]], return_index=True)
            own = todo[free][first]
            self.key[place], self.check[place], self.start[place], self.size[place] = key[own], check[own], start[own], size[own]
            todo = np.setdiff1d(todo, own, assume_unique=True)
            at[todo] = (at[todo] + 1) % PLACES


class Encoder:
    """Token ids of texts, as the tokenizer gives them for each whole text.

    A tokenizer of the form above (white space dropped, lower case, words of
    letters, a mark on the last token of a word) gives a text the ids of its
    pieces between white space, one after another.  Each piece is encoded once
    while the table of pieces lasts.  Texts go whole to a tokenizer of another
    form.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer, self.pieces, self.tails = Tokenizer.from_file(path), Pieces(), {"": b""}
        model, special = said["model"], [x["content"] for x in said["added_tokens"]]
        suffix = model.get("end_of_word_suffix")
        self.by_piece = (
            (said["normalizer"] or {}).get("normalizers") == NORMALIZERS and (said["pre_tokenizer"] or {}).get("pretokenizers") == [SPLIT, BYTES]
            and model["type"] == "BPE" and bool(suffix) and not model["dropout"] and not model["unk_token"] and not model["ignore_merges"]
            and all(x.startswith("<|") and x.isascii() and not x.split()[1:] for x in special)
        )
        if self.by_piece:
            # words alone, with the same model: no normaliser, cut at spaces; a word's last id bears the suffix
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for x, i in model["vocab"].items() if x.endswith(suffix)]] = True
        del said, model
        release()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of Latin letters, encoded 500 at once."""
        out = {}
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            body, start = ids.tobytes(), 0
            for word, end in zip(some, (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), strict=True):
                out[word] = body[start:end]
                start = end
        return out

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of text."""
        out: list = []
        for p in pieces:
            # Latin letters lower-case one by one and stay composed, and marks after them are a token part of their own
            m = WORD(p)
            if m:
                word, tail = m.groups()
                if tail not in self.tails:
                    if len(self.tails) > 50_000:
                        self.tails = {"": b""}
                    self.tails[tail] = self._whole(tail)
                out.append((word.lower(), self.tails[tail]))
            else:
                out.append(self._whole(p))
        words = self._encoded(sorted({x[0] for x in out if type(x) is tuple}))
        return [words[x[0]] + x[1] if type(x) is tuple else x for x in out]

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column (null: none)."""
        if not self.by_piece:
            for t in column.to_pylist():
                yield np.frombuffer(self._whole(t or ""), "<u4")
            return
        table = self.pieces
        for t in texts(column):
            key, check = t.hashes() | np.uint64(1), t.hashes(other=True).astype(np.uint32)
            if 2 * table.used > PLACES - 2 * len(key) or table.held > IDS:
                table.clear()
            at = table.find(key, check)
            new = np.flatnonzero(at < 0)
            body = bytes(t.data)
            if 2 * (table.used + len(new)) > PLACES:  # a text of so many pieces
                for a, b in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True):
                    yield np.frombuffer(b"".join(self._new(SPACES.split(body[a:b].decode()))), "<u4")
                continue
            while len(new):  # twice if two pieces have one key
                one = new[np.unique(key[new], return_index=True)[1]]
                table.put(key[one], check[one], self._new([body[a:b].decode() for a, b in zip(t.start[one].tolist(), t.end[one].tolist(), strict=True)]))
                at[new] = table.find(key[new], check[new])
                new = new[at[new] < 0]
            size = table.size[at].astype(np.int64)
            end = np.cumsum(size)
            ids = table.ids[np.repeat(table.start[at] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
            cut = np.concatenate([[0], end])[t.first]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield ids[a:b]


def pack(
    docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Every token id of ``docs`` in exactly one piece, every piece in a sequence of at most ``capacity`` ids.

    A document's ids are cut into full sequences, then into pieces of exactly
    capacity // k ids, then the rest.  A piece of length n is of class
    capacity // n, and a sequence of that class takes this many pieces.  Workers
    number the pieces of each class on their own; with what all workers before
    have (one count for each worker and class), a number tells the sequence and
    the place, so only the last sequence of a class is not full.  These, at most
    about 16,000 pieces (the sum of capacity / k) whatever the input, are packed
    together by first fit.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (binary) if ``with_ids``.  A null or empty text is its end id alone;
    rows that repeat are packed each for itself; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    small_arrow_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "nth"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, nth long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, worker = Encoder(path), defaultdict(int), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            out: dict[str, list] = {n: [] for n in names}
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.ids(b.column("t")), strict=True):
                ids = ids.tobytes() + end
                at, n = 0, len(ids) // 4
                for length in pieces(n, capacity):
                    k = capacity // length
                    part = ids[4 * at : 4 * (at + length)]
                    row = [doc_id, at, length, zlib.crc32(part), n, worker, seen[k]] + [part] * with_ids
                    for c, v in zip(names, row, strict=True):
                        out[c].append(v)
                    seen[k] += 1
                    at += length
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(names, kinds, strict=True)], names)

    cut = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as t").mapInArrow(tidy(run), schema)
    cut = written(cut).withColumn("class", F.floor(F.lit(capacity) / F.col("length")))
    counts = cut.groupBy("class", "worker").agg(F.count("*").alias("n"))
    by = W.partitionBy("class")
    # one row for each class (at most about 90) and worker
    starts = counts.select("class", "worker", F.coalesce(F.sum("n").over(by.orderBy("worker").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by).alias("all"))
    placed = cut.join(starts, ["class", "worker"]).withColumn("no", F.col("before") + F.col("nth"))
    placed = placed.withColumn("bin", F.floor(F.col("no") / F.col("class")))
    full = placed.where((F.col("bin") + 1) * F.col("class") <= F.col("all"))
    inside = W.partitionBy("class", "bin").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    # class by class, bin by bin: a class has under 2**44 sequences
    full = full.withColumn("sequence_id", F.col("class") * F.lit(1 << 44) + F.col("bin"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "class", "no"], ascending=[False, True, True], kind="stable")
        free: list[int] = []
        by_space: dict[int, list[int]] = defaultdict(list)  # open bins by their free space
        seq, off = [], []
        for n in rest["length"]:
            space = next((s for s in range(n, capacity + 1) if by_space.get(s)), None)
            if space is None:
                free.append(capacity)
                b = len(free) - 1
            else:
                b = by_space[space].pop()
            seq.append(b)
            off.append(capacity - free[b])
            free[b] -= n
            by_space[free[b]].append(b)
        rest = rest.assign(sequence_id=np.array(seq, "int64"), offset=np.array(off, "int64"))
        return rest[["doc_id", "start", "sequence_id", "offset", "worker", "nth", "class"]]

    # bounded by the capacity, not by the input: under one sequence of each class
    open_ = placed.where((F.col("bin") + 1) * F.col("class") > F.col("all"))
    small = open_.select("doc_id", "start", "length", "class", "no", "worker", "nth", F.lit(0).alias("all_rest"))
    fitted = small.groupBy("all_rest").applyInPandas(fit, "doc_id long, start long, sequence_id long, offset long, worker long, nth long, class long")
    rest = open_.join(fitted.select("worker", "nth", "class", "sequence_id", "offset"), ["worker", "nth", "class"])
    return full.select(*keep).unionByName(rest.select(*keep))
