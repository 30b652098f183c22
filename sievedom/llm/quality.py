"""Quality rules: characters inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import small_arrow_batches, tidy, with_row_id, without_rows

#: Most of a text's word characters that may lie in n-grams found twice or more, by n.
LIMITS = {5: 0.25, 8: 0.20, 10: 0.15}
#: Most of them that may lie in repeated lines (all but the first of equal ones).
LINE_LIMIT = 0.30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _repeats(t: W.Texts, hashes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Of each word, whether it is in a k-word window that its text has twice or more."""
    h, place = W.windows(hashes, t.first, k)
    inside = np.zeros(len(hashes) + k + 1, np.int32)
    if len(h):
        key = W.mixed(h + doc[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = place[count[back] > 1]
        np.add.at(inside, again, 1)
        np.add.at(inside, again + k, -1)
    return np.cumsum(inside)[: len(hashes)] > 0


def _lines(t: W.Texts, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word that are equal to an earlier line, and the word characters in them."""
    n = len(t.data)
    cut = np.flatnonzero(t.data == 10)
    begin = np.unique(np.concatenate([t.at[:-1], cut + 1]))
    begin = begin[begin < n]
    if not len(begin):
        return np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    doc = np.searchsorted(t.at, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], n), t.at[doc + 1])
    end -= (end > begin) & (t.data[np.maximum(end, 1) - 1] == 10)
    total = np.concatenate([[0], np.cumsum(letters)])
    chars = total[end] - total[begin]
    full = chars > 0
    begin, end, doc, chars = begin[full], end[full], doc[full], chars[full]
    key = W.mixed(W.span_hashes(t.data, begin, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    later = np.ones(len(key), bool)
    later[np.unique(key, return_index=True)[1]] = False
    return np.bincount(doc[later], minlength=len(t)), np.bincount(doc[later], weights=chars[later], minlength=len(t)).astype(np.int64)


def measures(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The measures of some texts at a time."""
    for t in W.texts(column):
        hashes, doc = t.hashes(), t.doc_of_word()
        letters = ((t.data & 0xC0) != 0x80) & ~W._SPACE[t.data]
        total = np.concatenate([[0], np.cumsum(letters)])
        length = total[t.end] - total[t.start]
        out = {
            "n_words": np.diff(t.first).astype(np.int64),
            "word_chars": np.diff(total[t.at]),
            "n_symbols": W.sums_by_text(_SYMBOL[t.data], t.at),
        }
        out["n_dup_lines"], dup_chars = _lines(t, letters)
        chars = np.maximum(out["word_chars"], 1)
        out["dup_line_share"] = dup_chars / chars
        for k in LIMITS:
            inside = _repeats(t, hashes, doc, k)
            if k == 5:
                out["n_repeat_words"] = W.sums_by_text(inside, t.first)
            out[f"dup_{k}_share"] = W.sums_by_text(inside * length, t.first) / chars
        out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
        good = ~out["base_failed"] & (out["dup_line_share"] <= LINE_LIMIT)
        for k, most in LIMITS.items():
            good &= out[f"dup_{k}_share"] <= most
        out["kept"] = good
        yield out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", *[f"dup_{k}_share" for k in LIMITS])


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with its repetition measures and the verdict.

    Words stand between ASCII white space, in the case they have.  A text fails
    the base rules with fewer than 10 words or with over 20 % of its words in
    5-word windows that it has twice or more; it is kept if it passes these,
    LIMITS and LINE_LIMIT.  Everything is per text, in slices of some texts, so
    there is no shuffle.  A null or empty text has no words and fails; rows that
    repeat get the same; an empty table gives no rows; other columns are not read,
    whatever their names.

    Returns doc_id, MEASURES and row_id.
    """
    small_arrow_batches(docs.sparkSession)
    kinds = {"base_failed": "boolean", "kept": "boolean"}
    schema = "doc_id long, row_id long, " + ", ".join(f"{m} {kinds.get(m, 'double' if 'share' in m else 'long')}" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for m in measures(b.column("t")):
                n = len(m["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(done, n), b.column("row_id").slice(done, n), *[pa.array(m[k]) for k in MEASURES]], ["doc_id", "row_id", *MEASURES]
                )
                done += n

    base = with_row_id(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as t"), "row_id")
    return base.mapInArrow(tidy(run), schema)


def good_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, of any names."""
    return without_rows(docs, quality_rules(docs, **how).where("not kept"))
