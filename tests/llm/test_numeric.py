"""Quality rules, the language model and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sievedom.llm import lm, packing, quality, words

from . import cases

WORD = r"[^\x20\x09-\x0D]+"
TEXTS = [
    "one two three four five six seven eight nine ten\none two three four five six", "", None, " \n\t", "a b c d e a b c d e a b c d e x", "l1 x\nl1 x\n\n\nl1 x",
    "é # $$ ü word next " * 40, "word " * 30000, "It's 3D <b>&amp;</b> " + "z" * 9000, "Ünï cödé it's <|endoftext|> 12",
]


def frame(spark, kind):
    return cases.frame(spark, TEXTS) if kind == "cases" else spark.read.parquet(f"{cases.SMALL}/documents.parquet")


def quality_brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


@pytest.mark.parametrize("kind", ["cases", "documents"])
def test_quality(spark, kind):
    docs = frame(spark, kind)
    got = quality.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *quality_brute(r.text)) for r in docs.collect())
    assert all(not (r.base_failed and r.kept) for r in got)
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_empty_tables(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    assert quality.quality_rules(none).count() == lm.score_documents(none).count() == packing.pack(none).count() == 0


def tokens(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def model_brute(rows):
    """Per row: tokens, known, N, base score, and the bigram score without quantising."""
    plain = [(i, tokens(t)) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    uni, bi = Counter(), defaultdict(Counter)
    for i, w in plain:
        if not held(i):
            uni.update(w)
            for a, b in zip([None, *w], w, strict=False):
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))

    def p2(a, b):
        if not bi.get(a):
            return p1(b)
        c = sum(bi[a].values())
        return max(bi[a][b] - lm.DISCOUNT, 0) / c + lm.DISCOUNT * len(bi[a]) / c * p1(b)

    for i, w in plain:
        yield i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p2(a, b)) for a, b in zip([None, *w], w, strict=False))


@pytest.mark.parametrize(("kind", "chars"), [("cases", 40_000), ("documents", 100_000)])
def test_model(spark, kind, chars, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CHARS", chars)
    docs = frame(spark, kind)
    want = sorted(model_brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    got = sorted((tuple(r) for r in lm.score_documents(docs).collect()), key=str)
    key = lambda r: (str(r[0]), round(r[5], 3))
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(a[5]) and abs(a[6] - b[6]) < 0.02 * a[2]
    held = [r for r in got if r[1] and r[0] is not None]
    if kind == "documents":
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values, universe in ((rng.integers(0, 10**12, 5000, np.uint64), 10**12), (np.arange(3000, dtype=np.uint64), 3000), (rng.integers(0, 2**64, 4000, np.uint64), 2**64), (np.empty(0, np.uint64), 9)):
        v = np.unique(values)
        e = lm.EliasFano.of(v, universe)
        assert (e.get(np.arange(len(v))) == v).all() and (e.find(v) == np.arange(len(v))).all()
        other = np.setdiff1d(np.concatenate([v + np.uint64(1), np.array([0, 2**63], np.uint64)]), v)
        assert (e.find(other) == -1).all()
    steps = np.sort(rng.integers(0, 50, 400)).astype(np.uint64)
    assert (lm.EliasFano.of(steps, 50).get(np.arange(400)) == steps).all()


@pytest.mark.parametrize(("kind", "capacity"), [("cases", 2048), ("documents", 2048), ("documents", 60)])
def test_packing(spark, kind, capacity):
    from tokenizers import Tokenizer

    docs = frame(spark, kind)
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in docs.collect())
    got = packing.pack(docs, capacity=capacity, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
        by_seq[r.sequence_id].append((r.offset, r.length))
    if kind == "documents":
        assert Counter((k[0], sum((p for _, p in sorted(v)), ())) for k, v in by_doc.items()) == want
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    for v in by_seq.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    if kind == "documents":
        assert sum(r.length for r in got) > 0.93 * capacity * len(by_seq)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder(file, monkeypatch):
    """Texts of all sorts of characters, by the tokenizer itself; the other file's texts can't be cut at spaces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    path = public_tokenizers.path(file)
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    assert enc.by_piece == (file == "word_bpe_49k.json")
    some = ["a", "Word", "É", "é", "e\u0301", "İ", "ß", "ŉ", "Σ", "ς", "中文", "١", "9", "'s", "'T", "'", ".", ",", "!?", "#", "<", "<|endoftext|>", "|>", "\u00a0", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u0301", "\u200d", "😀", " ", "  ", "\n", "\r\n", "ǅ", "ʰ", "_", "ª", "²", "½", "Å", "\u2126"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "\n"]
    for places, slice_ in ((1 << 22, 1 << 20), (1 << 12, 2000), (64, 1000)):
        monkeypatch.setattr(packing, "PLACES", places)
        monkeypatch.setattr(words, "SLICE", slice_)
        enc.pieces.clear()
        for text, ids in zip(texts, enc.ids(pa.array([*texts, None])[:-1]), strict=True):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces():
    for capacity in (1, 10, 2048):
        for n in random.Random(2).sample(range(1, 9000), 200):
            cut = packing.pieces(n, capacity)
            assert sum(cut) == n and max(cut) <= capacity and min(cut) > 0
