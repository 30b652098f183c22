"""The n-gram Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievedom.llm import ngram_join, words

from . import cases


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, p, q):
    """Per row: its id, its set's size and the smallest id reachable."""
    s = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and min(len(s[i]), len(s[j])) * q >= max(len(s[i]), len(s[j])) * p and q * len(s[i] & s[j]) >= p * len(s[i] | s[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s[i]), least.get(top(i)) if s[i] else d) for i, (d, _) in enumerate(rows))


def families(seed):
    """Texts with near copies around the threshold, from few to many words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(40):
        base = [word() for _ in range(int(2 ** rng.uniform(1, 9.5)))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 8])):
            w = list(base)
            for _ in range(int(rng.uniform(0, 0.06) * len(w))):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [word()], [word(), w[i]]])
            out.append(" ".join(w).replace(" ", rng.choice([" ", "  ", "\n"]), 1))
    rng.shuffle(out)
    return out + ["", None, " ", "one", "ONE", "one two", "one two three", "É é É é", "é é É é"]


@pytest.mark.parametrize(("k", "p", "q"), [(4, 85, 100), (5, 80, 100)])
@pytest.mark.parametrize("kind", ["families", "documents"])
def test_join(spark, kind, k, p, q):
    docs = cases.frame(spark, families(k)) if kind == "families" else spark.read.parquet(f"{cases.SMALL}/documents.parquet")
    got = ngram_join.jaccard_join(docs, k=k, similarity=(p, q)).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, p, q)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    if kind == "families" and k == 4:
        kept = ngram_join.one_of_each(docs, k=k, similarity=(p, q))
        assert kept.columns == docs.columns
        assert kept.where("doc_id is not null").count() == sum(1 for (d, n, c), m in want.items() if d is not None and d == c)


def test_every_link_is_counted(spark, monkeypatch):
    """Degrees over distinct sets, in a group of near copies of several blocks too."""
    monkeypatch.setattr(ngram_join, "CROWD", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = families(4)[:60] + [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in rng.sample(range(120), 40)] + [" ".join(base)]
    got = ngram_join.jaccard_join(cases.frame(spark, texts)).collect()
    rows = cases.rows(texts)
    s = [frozenset(shingles(r[1], 4)) for r in rows]
    links = {x: sum(100 * len(x & y) >= 85 * len(x | y) for y in set(s) if y and x != y) for x in set(s)}
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == Counter((r[0], len(x), links[x] if x else 0) for r, x in zip(rows, s, strict=True))


def test_sets_of_one_hash_get_other_numbers(spark):
    """With a first hash of 8 bits nearly every set shares its number with others."""
    rows = cases.rows(families(5)[:150])
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, cases.SCHEMA), hash_bits=8).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([(r[0], r[1]) for r in rows], 4, 85, 100)


def test_linked(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 5)
    rng = np.random.default_rng(1)
    v = [np.unique(rng.integers(0, 30, n).astype(np.uint64)) for n in (5, 20, 90, 90, 200, 200)]
    want = [[len(np.intersect1d(x, y)) * 100 >= 85 * len(np.union1d(x, y)) for y in v] for x in v]
    assert ngram_join.linked(v, 85, 100).tolist() == want


def test_empty_table(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], cases.SCHEMA)).count() == 0


@pytest.mark.parametrize("crowd", [1, 10**6, 10**12])
def test_similar_sets_share_a_signature(crowd):
    """At the largest difference that a similar pair can have, for cheap and for costly crowds."""
    rng = np.random.default_rng(crowd % 97)
    starts = ngram_join.sizes(3000)
    bands = [ngram_join.allocated(i, a, b, crowd, 85, 100) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))]
    assert crowd == 1 or any(b.deletions for b in bands)
    lows = np.array([b.low for b in bands])

    def sigs(v):
        v = np.sort(v)
        marks = words.mixed(v ^ ngram_join._SALT)
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(marks, out=sums[1:])
        return {int(s) for b in ngram_join._bands_of(len(v), bands, lows, 85, 100) for s in ngram_join.signatures(v, marks, sums, b)}

    def linkable(a, b):
        a, b = np.sort(a), np.sort(b)
        return ngram_join.can_link(ngram_join.sketch(a), ngram_join.sketch(b), len(a), len(b), 85, 100)

    for n in [7, 8, 12, 13, 14, 30, 61, 100, 250, 999] * 12:
        both = rng.integers(0, 2**64, n, np.uint64)
        free = (100 * n) // 85 - n  # 100 * n >= 85 * union
        x = int(rng.integers(0, free + 1))
        a = np.concatenate([both, rng.integers(0, 2**64, x, np.uint64)])
        b = np.concatenate([both, rng.integers(0, 2**64, free - x, np.uint64)])
        assert sigs(a) & sigs(b) and linkable(a, b)
    assert not linkable(rng.integers(0, 2**64, 500, np.uint64), rng.integers(0, 2**64, 500, np.uint64))


def test_sets_of_slices():
    t = next(words.texts(pa.array(["a b c d e a b c d", "a", "", None, "a b c d"]), lower=True))
    v, at = ngram_join.sets(t, 4)
    assert np.diff(at).tolist() == [5, 1, 0, 0, 1] and v[-1] in v[:5]


@pytest.mark.parametrize("parts", [1, 7])
def test_dealt_signatures_come_back_and_lead(parts):
    """Rows of parts hold every signature and node; over several calls each node but the leader is told with one leader."""
    rng = np.random.default_rng(parts)
    pool = rng.integers(0, 2**64, 300, np.uint64)
    whole, members, leaders = {}, {}, {}
    for _ in range(3):
        sigs, nodes = rng.choice(pool, 1000), np.sort(rng.integers(-50, 50, 1000))
        batch = ngram_join.dealt(sigs, nodes, parts)
        back = [ngram_join.undealt(*row.values()) for row in batch.to_pylist()]
        key = lambda s: (int(s) & (1 << 48) - 1, (int(s) >> 32) * parts >> 32)
        want = Counter((key(s), n) for s, n in zip(sigs, nodes.tolist(), strict=True))
        assert want == Counter((((int(s) & (1 << 48) - 1), int(s) >> 48), n) for a, b in back for s, n in zip(a, b.tolist(), strict=True))
        for row, (s, x) in zip(batch.to_pylist(), back, strict=True):
            for a, b in zip(s.tolist(), x.tolist(), strict=True):
                whole.setdefault(a, set()).add(b)
            for a, lead, b in zip(*(c.tolist() for c in leaders.setdefault(row["part"], ngram_join.Leaders()).take(s, x)), strict=True):
                members.setdefault(a, {}).setdefault(lead, set()).add(b)
    for a, nodes in whole.items():
        led = members.get(a, {})
        assert len(led) == (len(nodes) > 1)
        assert all(nodes == {lead, *others} and lead not in others for lead, others in led.items())


@pytest.mark.parametrize(("p", "q"), [(85, 100), (80, 100)])
def test_similar_sets_share_a_rare_shingle(p, q):
    """In any order, similar sets have a first common shingle among the rarest of both, and not too far back."""
    rng = np.random.default_rng(7)
    ranks = rng.integers(0, 5, ngram_join.SLOTS).astype(np.uint8)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        pool = rng.integers(0, 1 << 64, n + 20, dtype=np.uint64)
        x, y = (np.unique(pool[rng.random(len(pool)) < 0.93]) for _ in range(2))
        both = len(np.intersect1d(x, y))
        if not both or both * q < (len(x) + len(y) - both) * p:
            continue
        tried += 1
        a, b = (ngram_join.rarest(v, ranks, p, q).tolist() for v in (x, y))
        assert any(min(len(x) - i, len(y) - b.index(h)) * (p + q) >= (len(x) + len(y)) * p for i, h in enumerate(a) if h in b)
    assert tried > 300


def test_crowd_with_a_common_passage(spark):
    """Many texts that are mostly one passage, altered in each: none, some and all of them linked."""
    rng = random.Random(11)
    passage = [f"w{i}" for i in range(150)]
    out = []
    for j in range(160):
        w = list(passage)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"x{j}"
        out.append(" ".join(w + [f"y{j}"] * (j % 4) * 9))
    docs = cases.frame(spark, out)
    got = ngram_join.jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)
