"""Token counts of whole texts by a shortcut for pieces that are one token."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_arrow_batches

#: How byte-level tokenizers cut a text into pieces before merging; fixed value of the file format.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: What a tokenizer file must say for its pieces to be those above; fixed values of the file's format.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Merged pieces that a worker keeps, and the longest of them; over this it starts anew.
KEPT, LONGEST = 1 << 18, 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole_tokens(spec: str) -> list[str]:
    """The vocabulary's strings that, alone, are one piece and one token: proved for each by the tokenizer itself.

    A piece's tokens depend on the piece alone, so wherever such a string is a
    piece of a text, it counts 1.  Strings that are no whole characters, that
    the merges never reach, or that are cut into pieces are not among them.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    named = [(tokenizer.decode([i], skip_special_tokens=False), i) for i in tokenizer.get_vocab(with_added_tokens=False).values()]
    named = [(s, i) for s, i in named if s and PIECE.fullmatch(s) and PIECE.match(s).end() == len(s)]
    ids = tokenizer.encode_batch_fast([s for s, _ in named], add_special_tokens=False)
    return sorted(s for (s, i), e in zip(named, ids, strict=True) if e.ids == [i])


def cut_as_expected(spec: dict) -> bool:
    """Whether texts can be taken apart into pieces here: no normaliser, byte-level pieces, plain merges, special strings that end nothing beside them."""
    model = spec["model"]
    return (
        spec["normalizer"] is None and spec["pre_tokenizer"] == BYTES and model["type"] == "BPE" and not model["dropout"] and model["unk_token"] is None
        and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"] and not model["ignore_merges"] and spec["truncation"] is None
        and not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"])
    )


@cache
def _unassigned() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


def odd(text: str) -> bool:
    """Whether a text has code points without a category here: newer libraries may take them for letters."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


class Counts(dict):
    """Tokens of pieces: 1 for those proved, the number that the merges leave for others, which are kept within a bound."""

    def __init__(self, tokenizer, whole: list[str]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = whole
        self.merges = Tokenizer(tokenizer.model)  # a piece as it is, not cut again
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.update(dict.fromkeys(whole, 1))

    def __missing__(self, piece: str) -> int:
        n = len(self.merges.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.whole) + KEPT:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class Counter:
    """Numbers of tokens of texts, as the library gives them."""

    def __init__(self, spec: str, whole: list[str] | None):
        from tokenizers import Tokenizer

        self.tokenizer, said = Tokenizer.from_str(spec), json.loads(spec)
        self.counts = Counts(self.tokenizer, whole) if whole is not None else None
        special = sorted((x["content"] for x in said["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.counts is None or odd(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, PIECE.findall(p))) for p in parts)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """The number of tokens of each whole text, one row for each row.

    ``tokenizer`` is a file of the tokenizers library, read on the driver; its
    text and the strings proved to be one token (bounded by its vocabulary) are
    broadcast.  A text is cut into pieces, those strings count 1, and only the
    rest is merged.  Special strings inside a text are one token each, as is the
    library's default.  Texts with code points that this Python has no category
    for, and files of another form, go to the library whole.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than
    ``limit`` tokens).  A null text counts as empty and has none; ids can be
    null or repeat; other columns are not read, whatever their names; an empty
    table gives no rows.  Nothing is shuffled.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec) if cut_as_expected(json.loads(spec)) else None))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(*shared.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")
        del counter
        release()

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select("doc_id", F.octet_length("_t").cast("long").alias("n_bytes"), n_tokens("_t").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
