"""Document functions on HTML strings: serialising, minifying, editing, styles, URLs."""

from __future__ import annotations

import re

from . import css
from .dom import COMMENT, ELEMENT, TEXT, Node, body_of, fresh, inner_html, outer_html, parse, parse_fragment, parsed, root_of
from .selectors import compiled, select, specificity, _matches
from .sanitizer import clean_part

PRESERVE = frozenset("pre textarea script style code".split())


def _first(doc: Node, selector: str) -> Node | None:
    return next(iter(select(doc, selector)), None)


def outer(html: str | Node, selector: str) -> str | None:
    e = _first(parsed(html), selector)
    return outer_html(e) if e is not None else None


def inner(html: str | Node, selector: str) -> str | None:
    e = _first(parsed(html), selector)
    return inner_html(e) if e is not None else None


def text_content(html: str | Node, selector: str = "body") -> str | None:
    e = _first(parsed(html), selector)
    return e.text() if e is not None else None


def attribute(html: str | Node, selector: str, name: str) -> str | None:
    e = _first(parsed(html), selector)
    return e.get(name) if e is not None else None


def select_all(html: str | Node, selector: str) -> list[str]:
    return [outer_html(e) for e in select(parsed(html), selector)]


def normalize(node: Node) -> None:
    """Merges neighbouring texts and drops empty ones."""
    for n in [node, *node.walk()]:
        out: list[Node] = []
        for c in n.children:
            if c.type == TEXT and out and out[-1].type == TEXT:
                out[-1].data += c.data
            elif c.type != TEXT or c.data:
                out.append(c)
        n.children = out


def minify(html: str, comments: bool = False, display: bool = False) -> str:
    """Without texts of only line feeds and tabs (``display``: of any white space) outside preserved elements, and without comments unless kept."""
    doc = parse(html)
    blank = re.compile(r"[ \t\n\r]*\Z" if display else r"[\t\n\r]*\Z")
    stack = [(root_of(doc), False)]
    while stack:
        n, held = stack.pop()
        held = held or n.name in PRESERVE
        n.children = [c for c in n.children if not (c.type == TEXT and not held and blank.match(c.data)) and (comments or c.type != COMMENT)]
        stack += [(c, held) for c in n.children if c.type == ELEMENT]
        if n.content is not None:
            stack.append((n.content, False))
    return outer_html(root_of(doc))


def pretty(html: str, indent: int = 2) -> str:
    """One node to a line, indented by depth."""
    out: list[str] = []
    stack: list[tuple[Node | str, int]] = [(root_of(parse(html)), 0)]
    while stack:
        n, depth = stack.pop()
        if isinstance(n, str):
            out.append(" " * (indent * depth) + n)
        elif n.type == TEXT:
            if n.data.strip():
                out.append(" " * (indent * depth) + outer_html(n).strip())
        elif n.type == ELEMENT and any(c.type == ELEMENT for c in n.children):
            empty = Node(ELEMENT, n.name, n.ns, n.attrs)
            head, tail = outer_html(empty).rsplit("</", 1)
            out.append(" " * (indent * depth) + head)
            stack.append(("</" + tail, depth))
            stack += [(c, depth + 1) for c in reversed(n.children)]
        else:
            out.append(" " * (indent * depth) + outer_html(n).strip())
    return "\n".join(out)


def _edited(html: str, selector: str, edit) -> str:
    doc = parse(html)
    for e in select(doc, selector)[:1]:
        edit(e)
    return outer_html(root_of(doc))


def set_inner_html(html: str, selector: str, new: str, mode: str = "none") -> str:
    """The page with the first match's content replaced by a parsed fragment, cleaned in a mode."""

    def edit(e: Node) -> None:
        part = parse_fragment(new)
        clean_part(part, mode)
        target = e.content or e
        target.children = []
        for c in list(part.children):
            target.put(c)

    return _edited(html, selector, edit)


def append_html(html: str, selector: str, new: str, mode: str = "none") -> str:
    def edit(e: Node) -> None:
        part = parse_fragment(new)
        clean_part(part, mode)
        for c in list(part.children):
            for x in list(c.content.children) if c.content is not None else [c]:
                e.put(x)

    return _edited(html, selector, edit)


def set_outer_html(html: str, selector: str, new: str) -> str:
    def edit(e: Node) -> None:
        for c in list(parse_fragment(new).children):
            e.parent.put(c, e)
        e.parent.children.remove(e)

    return _edited(html, selector, edit)


def remove(html: str | Node, selector: str) -> str:
    doc = fresh(html)
    for e in select(doc, selector):
        e.parent.children.remove(e)
    return outer_html(root_of(doc))


def set_attribute(html: str, selector: str, name: str, value: str | None) -> str:
    def edit(e: Node) -> None:
        if value is None or e.get(name) is None:
            e.attrs = [a for a in e.attrs if a[0] != name] + ([(name, value)] if value is not None else [])
        else:
            e.attrs = [(n, value if n == name else v) for n, v in e.attrs]

    return _edited(html, selector, edit)


def set_style(html: str, selector: str, prop: str, value: str | None) -> str:
    """Puts, replaces or (None) removes an inline declaration."""

    def edit(e: Node) -> None:
        kept = [(n, v) for n, v in css.declarations(e.get("style") or "") if n != prop] + ([(prop, value)] if value is not None else [])
        e.attrs = [a for a in e.attrs if a[0] != "style"] + ([("style", "; ".join(f"{n}: {v}" for n, v in kept))] if kept else [])

    return _edited(html, selector, edit)


def computed_style(html: str, selector: str, prop: str) -> str | None:
    """The cascaded value of a property: inline and stylesheet declarations by importance, origin, specificity and order; no inheritance."""
    doc = parse(html)
    e = _first(doc, selector)
    if e is None:
        return None
    found, order = [], 0
    sheets = [(s.text(), False) for s in select(doc, "style")]
    for text, _ in sheets:
        for sel, body, at in css.rules(text):
            if at is not None or body is None:
                continue
            try:
                best = max((specificity(c) for c in compiled(sel) if _matches(e, c)), default=None)
            except (ValueError, KeyError):
                continue
            if best is not None:
                for n, v in css.declarations(body):
                    order += 1
                    if n == prop:
                        found.append((v.endswith("!important"), False, best, order, v))
    for n, v in css.declarations(e.get("style") or ""):
        order += 1
        if n == prop:
            found.append((v.endswith("!important"), True, (0, 0, 0), order, v))
    return re.sub(r"\s*!important$", "", max(found)[-1]) if found else None
