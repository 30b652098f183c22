"""CSS selectors over parsed trees."""

from __future__ import annotations

import re
from functools import lru_cache

from .css import split_top
from .dom import ELEMENT, TEXT, Node

_SIMPLE = re.compile(
    r"""\*|(?P<tag>[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:@-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<w>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]|:(?P<pseudo>[\w-]+)"""
)


def _nth(text: str) -> tuple[int, int]:
    text = text.replace(" ", "").lower()
    if text in ("odd", "even"):
        return 2, text == "odd"
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if m is None:
        raise ValueError(f"not an nth expression: {text}")
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


@lru_cache(256)
def compiled(selector: str) -> tuple:
    """Alternatives, each a tuple of (combinator, simple parts), leftmost first."""
    return tuple(_complex(s.strip()) for s in split_top(selector, ","))


def _complex(text: str) -> tuple:
    out, i, combinator = [], 0, " "
    if not text:
        raise ValueError("empty selector")
    while i < len(text):
        if m := re.compile(r"\s*([>+~])\s*|\s+").match(text, i):
            if combinator != " " and m[1]:
                raise ValueError(f"not a selector: {text}")
            combinator, i = m[1] or combinator, m.end()
            continue
        parts = []
        while i < len(text) and (m := _SIMPLE.match(text, i)):
            i = m.end()
            argument = None
            if m["pseudo"] and i < len(text) and text[i] == "(":
                depth, j = 1, i + 1
                while j < len(text) and depth:
                    depth += {"(": 1, ")": -1}.get(text[j], 0)
                    j += 1
                argument, i = text[i + 1 : j - 1].strip(), j
            parts.append((m.groupdict(), argument))
        if not parts:
            raise ValueError(f"not a selector: {text}")
        out.append((combinator, tuple(parts)))
        combinator = " "
    if combinator != " ":
        raise ValueError(f"not a selector: {text}")
    return tuple(out)


def _siblings(e: Node) -> list[Node]:
    return [c for c in (e.parent.children if e.parent is not None else [e]) if c.type == ELEMENT]


def _simple(e: Node, part: dict, argument: str | None) -> bool:
    if part["tag"]:
        return e.name.lower() == part["tag"].lower()
    if part["id"]:
        return e.get("id") == part["id"]
    if part["cls"]:
        return part["cls"] in (e.get("class") or "").split()
    if part["attr"]:
        have = e.get(part["attr"]) if e.get(part["attr"]) is not None else e.get(part["attr"].lower())
        if have is None or part["op"] is None:
            return have is not None
        want = part["q"] if part["q"] is not None else part["s"] if part["s"] is not None else part["w"]
        if part["flag"]:
            have, want = have.lower(), want.lower()
        return {
            "=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want),
            "*=": bool(want) and want in have,
        }[part["op"]]
    name = part["pseudo"]
    if name is None:
        return True
    if name in ("not", "is", "where", "matches"):
        return any(_matches(e, s) for s in compiled(argument)) != (name == "not")
    if name == "has":
        return any(_matches(d, s) for d in e.walk() if d.type == ELEMENT for s in compiled(argument))
    if name == "empty":
        return not any(c.type == ELEMENT or c.type == TEXT and c.data for c in e.children)
    if name == "root":
        return e.parent is not None and e.parent.type == 9
    if name in ("checked", "disabled", "required", "selected"):
        return e.get(name) is not None
    if name == "contains":
        return argument.strip("\"'") in e.text()
    row = _siblings(e)
    if name.endswith("of-type"):
        row = [c for c in row if c.name == e.name]
    if name.startswith(("last-", "nth-last-")):
        row = row[::-1]
    at = next(i for i, c in enumerate(row) if c is e) + 1
    if name.startswith("only-"):
        return len(row) == 1
    if name.startswith("nth-"):
        a, b = _nth(argument)
        return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0
    if name.startswith(("first-", "last-")):
        return at == 1
    raise ValueError(f"unknown pseudo-class :{name}")


def _matches(e: Node, chain: tuple) -> bool:
    combinator, parts = chain[-1]
    if not all(_simple(e, p, a) for p, a in parts):
        return False
    if len(chain) == 1:
        return True
    rest = chain[:-1]
    if combinator in "> ":
        up = e.parent
        while up is not None and up.type == ELEMENT:
            if _matches(up, rest):
                return True
            if combinator == ">":
                return False
            up = up.parent
        return False
    before = []
    for c in _siblings(e):
        if c is e:
            break
        before.append(c)
    return any(_matches(c, rest) for c in (before[-1:] if combinator == "+" else before))


def matches(e: Node, selector: str) -> bool:
    return any(_matches(e, s) for s in compiled(selector))


def select(root: Node, selector: str) -> list[Node]:
    """The elements below a node that match, in document order."""
    compiled(selector)
    return [e for e in root.walk() if e.type == ELEMENT and matches(e, selector)]


def closest(e: Node | None, selector: str) -> Node | None:
    while e is not None and e.type == ELEMENT and not matches(e, selector):
        e = e.parent
    return e if e is not None and e.type == ELEMENT else None


def specificity(chain: tuple) -> tuple[int, int, int]:
    a = b = c = 0
    for _, parts in chain:
        for p, _arg in parts:
            a += bool(p["id"])
            b += bool(p["cls"] or p["attr"] or p["pseudo"])
            c += bool(p["tag"])
    return a, b, c
