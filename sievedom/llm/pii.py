"""Personal data: base patterns, and identifiers found by bootstrapped context patterns."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rejoin, small_arrow_batches, tidy, with_row_id, written

KINDS = ("email", "ip", "card", "phone")
#: What the method finds besides.
FOUND = "id"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|"
#: Where cards and phone numbers can be, with or without a plus, and its pieces.
_AREA = re.compile(r"\+?\(?[0-9][\x20().0-9-]*[0-9]")
_PIECE = re.compile(r"[^\x20]+")
#: Digits that a token or a run of pieces needs to be looked at, unless a token has an @; and those that a seed of several pieces has at most.
DIGITS, MOST = 5, 19


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end), by kind, then start.  Each kind takes time in proportion to the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _shape(s: str) -> str:
    return re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", _DIGIT.sub("9", s)))


def _patterns(left: str, value: str, right: str) -> list[str]:
    """Lexical patterns of an occurrence: the word before or after, with the value's outline and alone, and its exact shape.

    The ends of a text and words of punctuation alone give none without the outline.
    """
    outline = re.sub(r"9+", "9", _shape(value))
    alone = [f"{side} {word}" for side, word, end in (("L", left, "^"), ("R", right, "$")) if word not in ("", end)]
    return [f"L {left}|{outline}", f"R {right}|{outline}", f"S {_shape(value)}", *alone]


def runs(text: str) -> list[tuple[int, int]]:
    """Start and end of what can be a card or phone number by the seeds' grammar: one piece of an area or neighbouring ones, of DIGITS to MOST digits."""
    out = []
    for m in _AREA.finditer(text):
        pieces = [(m.start() + x.start(), m.start() + x.end(), len(_DIGIT.findall(x[0]))) for x in _PIECE.finditer(m[0])]
        if m.start() and text[m.start() - 1].isalnum():
            del pieces[:1]
        if text[m.end() : m.end() + 1].isalnum():
            del pieces[-1:]
        for a, (i, _, n) in enumerate(pieces):
            digits = 0
            for _, j, more in pieces[a:] if n else ():
                digits += more
                if digits > MOST:
                    break
                if digits >= DIGITS and more:
                    value = text[i:j]
                    lead = len(value) - len(value.lstrip(").-"))
                    value = value[lead:].rstrip("(.-")
                    if value[-1] == ")" and value.count(")") > value.count("("):
                        value = value.rstrip(").-")
                    if value[0] == "(" and value.count("(") > value.count(")"):
                        lead, value = lead + 1, value[1:]
                    out.append((i + lead, i + lead + len(value)))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[int], list[float], str | None]]:
    """Occurrences of seeds and of what is like an identifier: start, end, instance, patterns (hashes) and their weights, the seed's kind.

    Readings of one place that share a pattern share its weight.
    """
    if not spans and not _DIGIT.search(text) and "@" not in text:
        return []
    words = [(m.start(), m.end(), m[0].strip(_EDGE).lower()) for m in _TOKEN.finditer(text)]
    starts, out = [w[0] for w in words], []

    def tokens(i: int, j: int) -> tuple[int, int]:
        return bisect_right(starts, i) - 1, bisect_right(starts, j - 1) - 1

    def add(i: int, j: int, kind: str | None, begin: int = 1, end: int = 1) -> None:
        first, last = tokens(i, j)
        left = text[words[first][0] : i].strip(_EDGE).lower() or (words[first - 1][2] if first > 0 else "^")
        right = text[j : words[last][1]].strip(_EDGE).lower() or (words[last + 1][2] if last + 1 < len(words) else "$")
        value = text[i:j]
        patterns = _patterns(left, value, right)
        weights = [1 / {"L": begin, "R": end, "S": 1}[x[0]] for x in patterns]
        out.append((i, j, xxhash.xxh3_64_intdigest(value) >> 1, [xxhash.xxh3_64_intdigest(x) >> 1 for x in patterns], weights, kind))

    taken = set()
    for kind, i, j in spans:
        first, last = tokens(i, j)
        taken.update(range(first, last + 1))
        add(i, j, KINDS[kind])
    found = set()
    for i, j, _ in words:
        token = text[i:j]
        if ("@" in token and len(token) > 4) or len(_DIGIT.findall(token)) >= DIGITS:
            k = i + len(token) - len(token.lstrip(_EDGE))
            value = token.strip(_EDGE)
            if value:
                found.add((k, k + len(value)))
    found.update(runs(text))
    free = []
    for i, j in sorted(found):
        first, last = tokens(i, j)
        if taken.isdisjoint(range(first, last + 1)):
            free.append((i, j))
    begins, ends = Counter(i for i, _ in free), Counter(j for _, j in free)
    for i, j in free:
        add(i, j, None, begins[i], ends[j])
    return out


def chosen(found: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of readings (score, start, end) that overlap, the one of best score, then the longest, then the first."""
    out: list[tuple[int, int]] = []
    for _, i, j in sorted(found, key=lambda x: (-round(x[0], 9), x[1] - x[2], x[1])):
        at = bisect_left(out, (i, j))
        if (at == 0 or out[at - 1][1] <= i) and (at == len(out) or out[at][0] >= j):
            insort(out, (i, j))
    return out


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def find_pii(
    docs: DataFrame, *, rounds: int = 3, least: float = 0.8, support: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs`` with the personal data in its text.

    Base spans, always kept: emails, IPv4 addresses, cards and phone numbers.
    Their distinct values are the seeds.  Occurrences of seeds, of other tokens
    with an @ or DIGITS digits, and of neighbouring pieces of digits as cards
    and phone numbers have them (DIGITS to MOST digits) induce patterns
    (neighbouring word with outline and alone, exact shape).  Over the
    corpus-wide graph of patterns and instances, ``rounds`` times, a pattern
    scores the weighted mean of its instances (with one unknown more), an
    instance the noisy-or of its patterns, seeds 1.  A pattern of score
    ``least`` or more with ``support`` distinct seeds or more discovers what
    else it matches, as kind ``id``; of readings that overlap, the one of best
    score by such patterns, then the longest.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id,
    row_id.  Offsets are code points, ends exclusive.  A null or empty text has
    no spans; rows that repeat count each for itself (an instance once); an
    empty table gives no rows.
    """
    small_arrow_batches(docs.sparkSession)
    base = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), "row_id")
    seen = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64())), ("ws", pa.list_(pa.float64())), ("kind", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, said, near = [], [], [], []
            for text in b.column("t"):
                text = text.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(k == i for k, *_ in spans) for i in range(4)])
                said.append(_said([(KINDS[k], i, j) for k, i, j in spans]))
                digests.append(hashlib.sha256(said[-1].encode()).hexdigest())
                near.append([dict(zip(("s", "e", "inst", "pats", "ws", "kind"), c, strict=True)) for c in contexts(text, spans)])
            cols = [b.column("doc_id"), b.column("row_id"), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(digests), pa.array(said), pa.array(near, pa.list_(seen))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "near"])

    schema = "doc_id long, row_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base string, near array<struct<s:int,e:int,inst:long,pats:array<long>,ws:array<double>,kind:string>>"
    rows = written(base.mapInArrow(tidy(scan), schema))
    occ = rows.select("row_id", F.explode("near").alias("x")).select("row_id", "x.*")
    edges = written(occ.select("inst", "kind", F.explode(F.arrays_zip("pats", "ws")).alias("x")).groupBy(F.col("x.pats").alias("pat"), "inst").agg(F.max("kind").alias("kind"), F.max("x.ws").alias("w")))
    score = edges.select("inst", "kind").groupBy("inst").agg(F.max(F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).alias("score"))
    for _ in range(rounds):
        told = rejoin(edges.withColumnRenamed("kind", "own"), score, ["inst"])
        pats = written(told.groupBy("pat").agg((F.sum(F.col("score") * F.col("w")) / (F.sum("w") + 1)).alias("p"), F.sum(F.when(F.col("own").isNotNull(), 1).otherwise(0)).alias("seeds")))
        told = rejoin(edges, pats, ["pat"])
        score = told.groupBy("inst").agg(F.when(F.max("kind").isNotNull(), 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("score"))
        score = written(score)
    good = pats.where((F.col("p") >= least) & (F.col("seeds") >= support)).select("pat", "p")
    hits = rejoin(occ.where("kind is null").select("row_id", "s", "e", F.explode("pats").alias("pat")), good, ["pat"], "inner")
    hits = hits.groupBy("row_id", "s", "e").agg((-F.sum(F.log1p(-F.least("p", F.lit(0.999))))).alias("score"))
    hits = hits.groupBy("row_id").agg(F.collect_list(F.struct("score", "s", "e")).alias("found"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [[{"s": s, "e": e} for s, e in chosen([(x["score"], x["s"], x["e"]) for x in found.as_py()])] for found in b.column("found")]
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(kept, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["row_id", "new"])

    new = hits.select("row_id", "found").mapInArrow(tidy(choose), "row_id long, new array<struct<s:int,e:int>>")
    out = rejoin(rows.drop("near"), new, ["row_id"])
    more = F.transform(F.coalesce("new", F.array().cast("array<struct<s:int,e:int>>")), lambda x: F.concat_ws(":", F.lit(FOUND), x["s"], x["e"]))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size(more) > 0, F.array_join(more, ",")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.size(more).cast("long").alias("n_id"), "row_id")
