"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_arrow_batches, tidy

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>""", re.S)
#: A tag that the page's end cuts off.
_UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?][^<]*|\Z)\Z")
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and elements that never hold an article's text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
OUT = frozenset("nav footer aside button select option noscript template svg math object audio video canvas dialog menu head script style textarea title iframe".split())
#: Elements that seldom hold an article, and of a page's header (outside article and main): what is in them weighs this much.
BESIDE = frozenset("form header".split())
BESIDE_WEIGHT, MARK_WEIGHT = 0.05, 0.15
HOLDERS = frozenset("article aside body center div dl form html main ol section table tbody td tr ul".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul search title".split()
)
#: Words of classes, ids and roles that name something other than the article.
OTHER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsbygoogle|banner|breadcrumbs?|comments?|commentlist|replies|cookies?|consent|gdpr|disqus|footer|masthead|menu|menubar|nav|navbar|navigation|newsletter|notice|notification|"
    r"alert|pagination|pager|popup|modal|overlay|promo\w*|related|recommend\w*|search|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|tags?|toolbar|tooltip|widget|contentinfo|complementary|login|signup)(?:$|[\s_-])",
    re.I,
)
_PUNCT = re.compile(r"[.,;:!?、。，！？；…]")
_HEAD = re.compile(r"h[1-6]$")
#: Headings over what readers wrote.
_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:all|latest|reader|readers'|readers’|user|visitor) )?(?:comments?|replies|kommentare?|leserkommentare|commentaires?|comentarios?|commenti|reacties)(?: (?:from|by) (?:our )?(?:readers|users))?(?: ?\(\d+\)|: ?\d+| \d+)?:?", re.I)
#: Width of the smoothing over neighbouring blocks, and the share of the mean that a content block's fused ratio needs.
SIGMA, SHARE = 1.0, 0.5


_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}


class Block:
    __slots__ = ("elements", "path", "parts", "links", "out", "weight", "text")

    def __init__(self, elements, path, out, weight):
        self.elements, self.path, self.out, self.weight, self.parts, self.links, self.text = elements, path, out, weight, [], 0, ""

    @property
    def own(self) -> int:
        """Characters outside links."""
        return len(self.text) - min(self.links, len(self.text))

    @property
    def linked(self) -> bool:
        return self.links >= 0.8 * len(self.text)


def blocks(html: str) -> list[Block]:
    """Text blocks in page order, each with the elements around it, whether it is in one that holds no article text, and its weight by the names of those and by what their classes, ids and roles say."""
    found: list[Block] = []
    # elements that say something: name, number, whether out, weight so far, whether it is a block; of inline ones the block that goes on after them, while no block has begun or ended
    stack: list[tuple[str, int, bool, float, bool, tuple[Block, int, int] | None]] = []
    path: list[str] = []
    number, link, at, now, bounds = 0, 0, 0, None, 0

    def text(s: str) -> None:
        nonlocal now
        if now is None:
            if not s.strip():
                return
            now = Block(tuple((e[1], e[0]) for e in stack), "/".join(path), bool(stack) and stack[-1][2], stack[-1][3] if stack else 1.0)
            found.append(now)
        now.parts.append(s)
        if link:
            now.links += len(s)

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            rest = html[at:]
            cut = _UNFINISHED.search(rest)
            text(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                link = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    goes_on = stack[i][5]
                    del stack[i:], path[i:]
                    now = None
                    if goes_on is not None and goes_on[1] == bounds:
                        now, _, link = goes_on
                    break
            if name in BLOCK:
                now = None
                bounds += 1
            continue
        if name in ("br", "hr"):
            if now is not None:
                now.parts.append(" ")
            if name == "hr":
                now = None
                bounds += 1
            continue
        if name in VOID:
            continue
        if name == "a":
            link = 1
        marks, hidden = [], False
        if m[3] and m[3].strip():
            for attr, value in _NAMES.findall(m[3]):
                attr, value = attr.lower(), value.strip("\"'")
                hidden |= attr == "hidden" or attr == "aria-hidden" and value == "true"
                if attr in ("class", "id", "role"):
                    marks.append(value)
        named = name not in ("html", "body", "article", "main") and any(OTHER.search(x) for x in marks)
        block = name in BLOCK or name in OUT
        if block or hidden or named:
            # an inline element is told apart only if it is hidden or named as something else; the block round it goes on after it
            bounds += name in BLOCK
            goes_on = (now, bounds, link) if now is not None and name not in BLOCK else None
            now = None
            if block:
                link = 0
                closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
                if name in BLOCK:
                    at_p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][4]), None)
                    if at_p is not None and (stack[at_p][0] == "p" or _HEAD.match(stack[at_p][0]) and _HEAD.match(name)):
                        del stack[at_p:], path[at_p:]
                while stack and stack[-1][0] in closes:
                    del stack[-1], path[-1]
            number += 1
            out, weight = stack[-1][2:4] if stack else (False, 1.0)
            if name in BESIDE and not (name == "header" and any(e[0] in ("article", "main") for e in stack)):
                weight *= BESIDE_WEIGHT
            if named:
                weight *= MARK_WEIGHT
            stack.append((name, number, out or hidden or name in OUT, weight, block, goes_on))
            path.append(name + "." + ".".join(marks) if marks else name)
        if name in RAW:
            end = _raw_end(html, name, at)
            at = len(html) if end < 0 else end
    for b in found:
        b.text = " ".join(unescape("".join(b.parts)).split())
    found = [b for b in found if b.text]
    _leave_comments(found)
    return found


def _leave_comments(found: list[Block]) -> None:
    """Takes out what stands under a heading that says comments, in the element that has the heading, up to a heading of its rank or a higher one; a page's first heading and h1 are no such headings."""
    above, rank = None, 0
    seen = False
    for b in found:
        own = b.elements[-1] if b.elements else (0, "")
        head = int(own[1][1]) if _HEAD.match(own[1]) else 0
        if above is not None and (above not in ((0, ""), *b.elements) or 0 < head <= rank):
            above = None
        if seen and not b.out and head > 1 and _COMMENTS.fullmatch(b.text):
            above, rank = b.elements[-2] if len(b.elements) > 1 else (0, ""), head
        if above is not None:
            b.out = True
        seen = seen or not b.out


def _raw_end(html: str, name: str, at: int) -> int:
    m = _RAW_ENDS[name].search(html, at)
    return m.start() if m else -1


def fused(found: list[Block]) -> list[float]:
    """Of each block, its path's weighed text length and punctuation per block, each smoothed over the neighbours, multiplied."""
    length, points, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        length[b.path] += b.own
        points[b.path] += len(_PUNCT.findall(b.text))
        count[b.path] += 1
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-2, 3)]

    def smooth(v: list[float]) -> list[float]:
        out = []
        for i in range(len(v)):
            near = [(kernel[d + 2], v[i + d]) for d in range(-2, 3) if 0 <= i + d < len(v)]
            out.append(sum(k * x for k, x in near) / sum(k for k, _ in near))
        return out

    chars = smooth([b.weight * length[b.path] / count[b.path] for b in found])
    marks = smooth([points[b.path] / count[b.path] for b in found])
    return [c * math.sqrt(1 + p) for c, p in zip(chars, marks, strict=True)]


def _article(found: list[Block], best: list[Block]) -> tuple[int, str] | None:
    """The innermost article, or only main, with half of the content; else the innermost element that can hold blocks with four fifths of it, or outer ones that add little."""
    weight: dict[tuple[int, str], int] = defaultdict(int)
    for b in best:
        for e in b.elements:
            weight[e] += len(b.text)
    total = sum(len(b.text) for b in best)
    named = sorted(e for e, w in weight.items() if w >= 0.5 * total and e[1] in ("article", "main"))  # numbered from the outside in
    if named:
        return named[-1]
    held = sorted(e for e, w in weight.items() if w >= 0.8 * total and e[1] in HOLDERS)
    if not held:
        return None
    top = held.pop()
    while held and held[-1][1] not in ("html", "body"):
        if sum(len(b.text) for b in found if held[-1] in b.elements and top not in b.elements) > 0.2 * total:
            break
        top = held.pop()
    return top


def _lists(inside: list[Block], best: list[Block]) -> set[Block]:
    """Blocks of lists and other elements that hold links alone, several of them, and are not among the article's own elements.

    Its own elements are all in an article element, and the children of those
    that hold content directly; of html and body, only those between the first
    and the last content.
    """
    content = [b for b in best if not b.linked]
    direct = {b.elements[-2] if len(b.elements) > 1 else None for b in content}
    direct |= {b.elements[-1] for b in content if b.elements and b.elements[-1][1] in HOLDERS}
    places = {id(b): i for i, b in enumerate(inside)}
    at = [places[id(b)] for b in content if id(b) in places]
    mixed = {e for b in inside if not b.linked for e in b.elements}
    groups: dict[tuple[int, str], list[Block]] = defaultdict(list)
    for b in inside:
        pure = next((i for i, e in enumerate(b.elements) if e not in mixed), None)
        if pure is not None and b.linked:
            over = b.elements[pure - 1] if pure else None
            flat = over is None or over[1] in ("html", "body")
            among = bool(at) and at[0] < places[id(b)] < at[-1]
            if any(e[1] == "article" for e in b.elements[:pure]) or over in direct and (among or not flat):
                continue
            groups[b.elements[pure]].append(b)
    return {b for g in groups.values() if len(g) > 1 for b in g}


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if there are none."""
    found = [b for b in blocks(html or "") if not b.out]
    if not found:
        return ""
    ratio = fused(found)
    level = SHARE * sum(r * len(b.text) for b, r in zip(found, ratio, strict=True)) / sum(len(b.text) for b in found)
    held: dict[float, float] = defaultdict(float)  # weighed text over the level by weight: the article's names, and of what is round it, are those of most of it
    for b, r in zip(found, ratio, strict=True):
        held[b.weight] += b.weight * len(b.text) * (r >= level)
    usual = max(held, key=lambda w: (held[w], w))
    content = [r >= level and b.weight >= usual for b, r in zip(found, ratio, strict=True)]
    best = [b for b, c in zip(found, content, strict=True) if c] or found
    top = _article([b for b in found if b.weight >= usual], best)
    inside = [(b, c) for b, c in zip(found, content, strict=True) if top is None or top in b.elements]
    if top is None or top[1] in ("html", "body"):
        # nothing closer holds the article: it goes from the first to the last content, with headings before it
        places = [i for i, (_, c) in enumerate(inside) if c] or list(range(len(inside)))
        first, last = places[0], places[-1]
        while first and _HEAD.match(inside[first - 1][0].elements[-1][1] if inside[first - 1][0].elements else ""):
            first -= 1
        inside = inside[first : last + 1]
    lists = _lists([b for b, _ in inside], best)
    kept = [b for b, c in inside if c and (b not in lists or len(b.text) > 200) or b.weight >= usual and b not in lists]
    return "\n".join(b.text for b in (kept or [b for b, _ in inside]))


def extract_main(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages`` with its main text.

    Text is divided into blocks at block elements; menus, footers, asides,
    scripts, styles, controls and what is hidden are none.  Text length outside links and punctuation are added
    up for each root-to-leaf tag path of the page, divided by its blocks, smoothed
    over neighbouring blocks and multiplied; forms, page headers and words of
    classes, ids and roles that name something else weigh the lengths down, by the
    same factor wherever they are, so a wrapper's name does not matter if it is
    round all the text.  Blocks over SHARE of the mean are content, but for those
    that weigh less than most of it.  The innermost
    element with four fifths of the content holds the article: its content and
    its other blocks of the content's weight, but for lists of links that are
    beside the content, are the text; where only the body holds it, those from
    the first to the last content.  A null or empty page has an empty text; each
    page is taken by itself, whole, and rows that repeat get the same; an empty
    table gives no rows; other columns are not read, whatever their names.

    Returns page_id, url, text, n_chars.
    """
    small_arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url", f"`{html_col}` as html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
