"""Merkle manifests, hard negatives and token counts against brute force on small tables with the hard cases."""

import functools
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievedom.llm import merkle, negatives, queries, tokens

from . import cases


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def run_up(nodes):
    """Root of a list of nodes, and each one's siblings, level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, w in enumerate(where):
            paths[i].append((w & 1, nodes[w ^ 1] if w ^ 1 < len(nodes) else None))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        where = [w // 2 for w in where]
    return (nodes or [None])[0], paths


def manifest(rows, tampered):
    """rows: doc_id, source, lang, n_chars, text."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    of = {g: sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r)))) for g in order}
    subs = {g: run_up([leaf(r) for r in of[g]]) for g in order}
    root, over = run_up([subs[g][0] for g in order])
    out = []
    for g, up in zip(order, over, strict=True):
        for r, path in zip(of[g], subs[g][1], strict=True):
            h, path = leaf(tampered(r)), path + up
            for side, s in path:
                h = sha(h if s is None else s + h if side else h + s)
            out.append((r[0], leaf(r), subs[g][0], root, sha("".join(s for _, s in path if s)), h, h == root))
    return out


def crc_tampered(r):
    bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
    return (*r[:3], r[3] + 1, r[4]) if bad else r


def merkle_rows():
    rnd = random.Random(5)
    rows = [(i, f"s{i % 3}" if i % 4 else None, rnd.choice(["en", "en", "en", "en", "de", "é"]), len(str(i)), f"text {i} ünd ☃" if i % 6 else "") for i in range(700)]
    return [*rows, rows[3], rows[3], (rows[3][0], "other", rows[3][2], 1, "x"), (None, None, None, None, None), (7, None, None, 2**63 - 1, None), (-5, "s", "xx", 0, "long " * 50_000), (None, "s", "en", 4, "b"), (9, "a|b", "", -1, "0:")]


@pytest.mark.parametrize("bits", [None, 0, 1, 3])
def test_merkle(spark, bits):
    rows = merkle_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    got = merkle.merkle_manifest(docs, claims={"n_chars": tampered}, block_bits=bits)
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest(rows, crc_tampered), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_merkle_small(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("root", F.lit(1)).withColumn("_g", F.lit(1)).withColumn("LEAF", F.lit(1))
    got = merkle.merkle_manifest(docs).collect()
    assert sorted(map(tuple, got)) == sorted(manifest(rows, lambda r: r))
    assert all(r.verified for r in got)
    if n == 1:
        assert got[0].leaf == got[0].root and got[0].proof_sha256 == sha("")


def negatives_of(rows, positives=5, wanted=10):
    """rows: id, vector, label."""
    whole = []
    for at, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v], label, at))
    first = lambda some, n: sorted(some, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:n]
    out = []
    for i, v, label, at in whole:
        if i is None or i % 100:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        others = [(score(w), j, k, other) for j, w, other, k in whole if k != at and len(w) == len(v)]
        for p, pid, *_ in first([x for x in others if x[3] == label], positives):
            some = first([x for x in others if x[3] != label and 30 * p <= 100 * x[0] <= 90 * p], wanted)
            out += [(i, pid, rank + 1, x[1], p, x[0]) for rank, x in enumerate(some)]
    return sorted(out, key=str)


def vector_rows(seed, n=900, dim=8, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] * (i % 2) + spread * rnd.normal(size=dim)).tolist(), int(rnd.integers(4))) for i in range(n)]
    return rows


def same_negatives(spark, rows, **how):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).withColumn("score", F.lit(1)).withColumn("row_id", F.lit(2))
    got = sorted(map(tuple, negatives.hard_negatives(vectors, **how).collect()), key=str)
    assert got == negatives_of(rows)
    return got


def test_negatives(spark):
    assert same_negatives(spark, vector_rows(1), block_rows=16, pivots=7)
    assert same_negatives(spark, vector_rows(2, dim=3, spread=0.1), block_rows=8, pivots=4)


def test_negatives_hard_cases(spark):
    rows = vector_rows(3, 300, 4)
    same = [0.5, 0.25, 0.0, 1.0]
    rows += [(1000 + i, same, i % 2) for i in range(250)]  # one vector in many copies: ties go by id
    rows += [(100, same, 1), (100, same, 1), (None, same, 0), (None, same, 1), (5000, None, 1), (5100, same, None), (5200, [0.5, None, 0.0, 1.0], 1), (5300, [math.nan, 0.0, 0.0, 0.0], 1), (5400, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(5500, [1.0, 2.0], 1), (5501, [1.0, 2.5], 1), (5502, [0.5, 1.0], 2), (5600, [], 1), (5601, [], 1), (5602, [], 2), (5700, [0.0] * 4, 3), (5800, [1e6, -3e5, 1.0, 0.0], 2), (5801, [9e5, 1.0, 1.0, 0.0], 2), (5802, [3e5, 1.0, 1.0, 0.0], 1)]
    assert same_negatives(spark, rows, block_rows=32, pivots=5)
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_negatives_great_scores(spark):
    rows = [(100 * i, [2e6 + i, -1e6], i % 2) for i in range(12)] + [(1, [1.2e6, 5e5], 0), (2, [1.1e6, 5e5], 1)]
    assert same_negatives(spark, rows, block_rows=4)


def test_negatives_of_clusters(spark):
    """Few different vectors, so ties at every bound."""
    rows = [(i, [math.cos(i % 40), math.sin(i % 40), (i % 13) / 1000], i % 3) for i in range(2000)]
    some = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    assert sorted(map(tuple, negatives.hard_negatives(some, block_rows=20).collect()), key=str) == negatives_of(rows)


SPEC = open(tokens.tokenizer_path(), encoding="utf-8").read()
TEXTS = ["", None, " ", "\n\n  x", "it's  we'll 'tis a''s", "Hello world, 123 4567!!", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "naïve façade ☃☃ 漢字かな  　x", "\x1c\x1d\u0085  a", "𝒳😀 👩‍👩‍👧", "\U0001fae9 new", "࢏ odd", "x" * 200_000, "ab " * 50_000, "\t" * 5000 + "y", "\x00\x01", "Ġ Ċ", "don't DON'T 's's"]


@functools.cache
def library_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(SPEC)


def library(texts):
    return [len(library_tokenizer().encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts(spark):
    docs = cases.frame(spark, TEXTS).withColumn("n_tokens", F.lit(-1))
    want = sorted((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(cases.rows(TEXTS), library([r[1] for r in cases.rows(TEXTS)]), strict=True) if r[0] is not None)
    got = tokens.count_tokens(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want and len(got) == len(cases.rows(TEXTS))
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_token_counts_of_documents(spark):
    rows = cases.documents()
    got = {r.doc_id: r.n_tokens for r in queries.op13_token_counts(spark, cases.SMALL).collect()}
    assert got == dict(zip([r[0] for r in rows], library([r[1] for r in rows]), strict=True))


COUNTER = tokens.Counter(SPEC, tokens.whole_tokens(SPEC))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdmtrevl<|>endofx019.,-é漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_counter(text):
    assert COUNTER.count(text) == library([text])[0]


def test_classes_of_characters():
    """Letters, digits and spaces are the library's for all code points that have a category here."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_str(SPEC).pre_tokenizer
    for c in range(0, 0x110000, 1):
        if 0xD800 <= c < 0xE000 or c > 0x3FFFF and c % 97:
            continue
        s = f"a{chr(c)}1{chr(c)}.{chr(c)} "
        if not tokens.odd(s):
            assert [x[1] for x in cut.pre_tokenize_str(s)] == [m.span() for m in tokens.PIECE.finditer(s)], hex(c)


def test_whole_tokens():
    whole = set(tokens.whole_tokens(SPEC))
    assert {" the", "The", "'s", "\n"} <= whole and "<|endoftext|>" not in whole and "the quick" not in whole
    assert len(whole) > 40_000 and library(sorted(whole)) == [1] * len(whole)


def test_other_tokenizer_files(spark, tmp_path):
    """A file that cuts in another way goes to the library."""
    said = json.loads(SPEC)
    said["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(path))
    got = tokens.count_tokens(cases.frame(spark, ["HELLO World", "x"]), tokenizer=str(path), limit=1).collect()
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in got if r.doc_id is not None} == {0: (len(t.encode("HELLO World").ids), True), 1: (1, False)}
