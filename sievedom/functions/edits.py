"""Changes to a document, each from an HTML string to one: nodes are put in, copied, replaced, split, and their text, names and data set.

A parsed document may stand for the string: it is left as it is, and the change made to a copy.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .dom import COMMENT, ELEMENT, TEXT, Node, body_of, copy_of, fresh, outer_html, parse, parse_fragment, parsed, root_of
from .sanitizer import clean_part
from .selectors import closest as _closest
from .selectors import matches as _match
from .selectors import select

VOID_NAMES = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WHERE = ("beforebegin", "afterbegin", "beforeend", "afterend")


def _first(doc: Node, selector: str) -> Node | None:
    return next(iter(select(doc, selector)), None)


def _edited(html: str | Node, selector: str, edit: Callable[[Node], None], every: bool = False) -> str:
    doc = fresh(html)
    for e in select(doc, selector)[: None if every else 1]:
        edit(e)
    return outer_html(root_of(doc))


#: A fragment up to this length is kept, parsed and cleaned, while it is among the last _KEPT.
_SHORT, _KEPT = 1024, 256


def _cleaned(new: str, mode: str) -> Node:
    part = parse_fragment(new)
    if mode != "none":
        clean_part(part, mode)
    return part


_kept = lru_cache(_KEPT)(_cleaned)


def _nodes(new: str, mode: str) -> list[Node]:
    return list((copy_of(_kept(new, mode)) if len(new) <= _SHORT else _cleaned(new, mode)).children)


def _after(e: Node) -> Node | None:
    mates = e.parent.children
    at = next(i for i, c in enumerate(mates) if c is e)
    return mates[at + 1] if at + 1 < len(mates) else None


def insert_adjacent(html: str | Node, selector: str, where: str, new: str, mode: str = "strict") -> str:
    """The first match with a parsed and cleaned fragment beforebegin, afterbegin, beforeend or afterend; mode none puts it in as it is."""
    if where not in WHERE:
        raise ValueError(f"{' or '.join(WHERE)}, not {where}")

    def edit(e: Node) -> None:
        inside = where in ("afterbegin", "beforeend")
        holder = (e.content or e) if inside else e.parent
        before = {"beforebegin": lambda: e, "afterbegin": lambda: next(iter(holder.children), None), "beforeend": lambda: None, "afterend": lambda: _after(e)}[where]()
        for c in _nodes(new, mode):
            holder.put(c, before)

    return _edited(html, selector, edit)


def replace_children(html: str | Node, selector: str, new: str, mode: str = "strict") -> str:
    def edit(e: Node) -> None:
        (e.content or e).children = []
        for c in _nodes(new, mode):
            (e.content or e).put(c)

    return _edited(html, selector, edit)


def replace_child(html: str | Node, selector: str, new: str, mode: str = "strict") -> str:
    """A fragment in the place of the first match."""

    def edit(e: Node) -> None:
        for c in _nodes(new, mode):
            e.parent.put(c, e)
        e.parent.children = [c for c in e.parent.children if c is not e]

    return _edited(html, selector, edit)


def move_before(html: str, selector: str, other: str | None) -> str:
    """The first match before the first match of another selector, or (None) at the end of its parent; not into itself."""
    doc = parse(html)
    e, target = _first(doc, selector), _first(doc, other) if other is not None else None
    up = target
    while up is not None and up is not e:
        up = up.parent
    if e is not None and up is None and (other is None or target is not None):
        holder = target.parent if target is not None else e.parent
        holder.put(e, target)
    return outer_html(root_of(doc))


def copied(n: Node, deep: bool = True) -> Node:
    return copy_of(n) if deep else Node(n.type, n.name, n.ns, list(n.attrs), n.data)


def clone(html: str | Node, selector: str, deep: bool = True) -> str:
    """The first match with a copy of it after it, with all below it if ``deep``."""
    return _edited(html, selector, lambda e: e.parent.put(copied(e, deep), _after(e)))


def create_element(name: str, attributes: dict[str, str] | None = None, text: str = "") -> str:
    """An element's HTML."""
    e = Node(ELEMENT, name.lower(), attrs=list((attributes or {}).items()))
    if text:
        (e.content or e).put(Node(TEXT, "#text", data=text))
    return outer_html(e)


def create_comment(data: str) -> str:
    if "--" in data:
        raise ValueError("a comment holds no --")
    return outer_html(Node(COMMENT, "#comment", data=data))


def set_text(html: str | Node, selector: str, text: str) -> str:
    """The first match with one text node, escaped when it is written."""

    def edit(e: Node) -> None:
        (e.content or e).children = []
        (e.content or e).put(Node(TEXT, "#text", data=text))

    return _edited(html, selector, edit)


def replace_text(html: str | Node, selector: str, text: str) -> str:
    """The first match with its first text node's text replaced."""

    def edit(e: Node) -> None:
        t = next((c for c in e.children if c.type == TEXT), None)
        if t is not None:
            t.data = text

    return _edited(html, selector, edit)


def split_text(html: str | Node, selector: str, offset: int) -> list[str]:
    """The texts of the first match's children after its first text is split at an offset."""
    e = _first(fresh(html), selector)
    t = next((c for c in e.children if c.type == TEXT), None) if e is not None else None
    if t is None or not 0 <= offset <= len(t.data):
        raise ValueError("no text that long")
    rest = Node(TEXT, "#text", data=t.data[offset:])
    e.put(rest, _after(t))
    t.data = t.data[:offset]
    return [c.data if c.type == TEXT else c.text() for c in e.children]


def set_title(html: str | Node, title: str) -> str:
    doc = fresh(html)
    head = next(c for c in root_of(doc).children if c.name == "head")
    e = next((c for c in head.children if c.name == "title"), None)
    if e is None:
        e = Node(ELEMENT, "title")
        head.put(e)
    e.children = []
    e.put(Node(TEXT, "#text", data=title))
    return outer_html(root_of(doc))


def append_meta(html: str | Node, attributes: dict[str, str]) -> str:
    doc = fresh(html)
    next(c for c in root_of(doc).children if c.name == "head").put(Node(ELEMENT, "meta", attrs=list(attributes.items())))
    return outer_html(root_of(doc))


def landmarks(html: str | Node) -> dict[str, bool | str | None]:
    """Root element, whether head and body are there, and the title."""
    root = root_of(parsed(html))
    names = [c.name for c in root.children if c.type == ELEMENT]
    title = _first(root, "title")
    return {"root": root.name, "head": "head" in names, "body": "body" in names, "title": title.text() if title is not None else None}


def fragment_nodes(html: str, context: str = "template") -> list[str]:
    """The HTML of each node of a fragment, parsed as a template's content or as what stands in a context element."""
    if context in ("template", "body", "div", "section", "article"):
        return [outer_html(c) for c in parse_fragment(html).children]
    wrap = {"tr": ("<table><tbody><tr>", "tr"), "td": ("<table><tbody><tr><td>", "td"), "th": ("<table><tbody><tr><th>", "th"), "tbody": ("<table><tbody>", "tbody"), "thead": ("<table><thead>", "thead"), "tfoot": ("<table><tfoot>", "tfoot"),
            "table": ("<table>", "table"), "select": ("<select>", "select"), "ul": ("<ul>", "ul"), "ol": ("<ol>", "ol"), "dl": ("<dl>", "dl"), "svg": ("<svg>", "svg"), "math": ("<math>", "math"), "textarea": ("<textarea>", "textarea"), "title": ("<title>", "title"), "style": ("<style>", "style")}
    if context not in wrap:
        raise ValueError(f"no context: {context}")
    head, name = wrap[context]
    e = _first(parse(head + html), name)
    return [outer_html(c) for c in e.children] if e is not None else []


def template_first(html: str | Node, selector: str = "template") -> str | None:
    """The first element in the first matching template."""
    t = _first(parsed(html), selector)
    e = next((c for c in (t.content.children if t is not None and t.content is not None else ()) if c.type == ELEMENT), None)
    return outer_html(e) if e is not None else None


def is_empty(html: str | Node, selector: str) -> bool | None:
    """Whether the first match is void or holds no elements and no text but white space."""
    e = _first(parsed(html), selector)
    if e is None:
        return None
    return e.name in VOID_NAMES or not any(c.type == ELEMENT or c.type == TEXT and c.data.strip() for c in (e.content or e).children)


def matches(html: str | Node, selector: str, test: str) -> bool | None:
    e = _first(parsed(html), selector)
    return _match(e, test) if e is not None else None


def closest(html: str | Node, selector: str, above: str) -> str | None:
    """The nearest of the first match and its ancestors that another selector matches."""
    e = _closest(_first(parsed(html), selector), above)
    return outer_html(e) if e is not None else None


def filtered(html: str | Node, selector: str, test: str) -> list[str]:
    """Of the matches those that another selector matches, too."""
    return [outer_html(e) for e in select(parsed(html), selector) if _match(e, test)]


#: Bits of a position (fixed values).
DISCONNECTED, PRECEDING, FOLLOWING, CONTAINS, CONTAINED_BY, OWN = 1, 2, 4, 8, 16, 32


def position(html: str | Node, selector: str, other: str) -> int | None:
    """Where the first match of ``other`` lies from that of ``selector``."""
    doc = parsed(html)
    a, b = _first(doc, selector), _first(doc, other)
    if a is None or b is None:
        return None
    if a is b:
        return 0

    def path(e: Node) -> list[int]:
        out = []
        while e.parent is not None:
            out.append(next(i for i, c in enumerate(e.parent.children) if c is e))
            e = e.parent
        return out[::-1]

    x, y = path(a), path(b)
    if y[: len(x)] == x:
        return CONTAINED_BY | FOLLOWING
    if x[: len(y)] == y:
        return CONTAINS | PRECEDING
    return FOLLOWING if x < y else PRECEDING


def names(html: str | Node, selector: str) -> dict[str, str] | None:
    """Tag name (upper case for HTML), qualified name and namespace of the first match."""
    e = _first(parsed(html), selector)
    space = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "math": "http://www.w3.org/1998/Math/MathML"}
    return {"tag": e.name.upper() if e.ns == "html" else e.name, "qualified": e.name, "namespace": space[e.ns]} if e is not None else None


def kebab(name: str) -> str:
    return re.sub("[A-Z]", lambda m: "-" + m[0].lower(), name)


def camel(name: str) -> str:
    return re.sub("-+([^-]|$)", lambda m: m[1].upper() if m[1].isascii() else m[1], name)


def dataset(html: str | Node, selector: str) -> dict[str, str]:
    """The data- attributes of the first match by camelCase key."""
    e = _first(parsed(html), selector)
    return {camel(n[5:]): v for n, v in (e.attrs if e is not None else ()) if n.startswith("data-")}


def set_data(html: str | Node, selector: str, key: str, value: str | None) -> str:
    """A data- attribute of the first match set, or (None) removed."""
    name = "data-" + kebab(key)

    def edit(e: Node) -> None:
        if value is None:
            e.attrs = [a for a in e.attrs if a[0] != name]
        elif e.get(name) is None:
            e.attrs = [*e.attrs, (name, value)]
        else:
            e.attrs = [(n, value if n == name else v) for n, v in e.attrs]

    return _edited(html, selector, edit)


def body_html(html: str) -> str:
    body = body_of(parse(html))
    return "".join(outer_html(c) for c in body.children) if body is not None else ""


_KEEPS = re.compile(r"<(pre|textarea|script|style|code)(?=[ >])", re.S)
_PIECE = re.compile(r"<!--.*?-->|<[^>]*>?|[^<]+", re.S)


def minify_string(html: str, comments: bool = True, blank_texts: bool = False) -> str:
    """Without white space between tags, without parsing; what pre, textarea, script, style and code hold stays."""
    out, at = [], 0
    while at < len(html):
        held = _KEEPS.match(html, at)
        if held:
            open_ = html.find(">", at)
            close = f"</{held[1]}>"
            end = html.find(close, open_ + 1) if open_ >= 0 else -1
            end = len(html) if end < 0 else end + len(close)
            out.append(html[at:end])
            at = end
            continue
        m = _PIECE.match(html, at)
        piece = m[0]
        if piece.startswith("<!--") and piece.endswith("-->"):
            if comments:
                out.append(piece)
        elif piece[0] == "<" or blank_texts or piece.strip(" \t\n\r"):
            out.append(piece)
        at = m.end()
    return "".join(out)
