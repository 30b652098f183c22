"""CSS parsing and filtering."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import policy

MAX_CSS = 100 * 1024
_STRING = r"\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?"
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_ESCAPE = re.compile(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", re.S)


def split_top(text: str, sep: str) -> list[str]:
    """Parts of a text between separators that are outside strings, brackets and braces."""
    out, depth, start = [], 0, 0
    for m in re.finditer(rf"{_STRING}|\\.|[()\[\]{{}}]|{re.escape(sep)}", text, re.S):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
        elif t == sep and not depth:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def declarations(css: str) -> list[tuple[str, str]]:
    """Properties (lower case, custom ones as they are) and values with single spaces and double quotes."""
    out = []
    for part in split_top(_COMMENT.sub(" ", css), ";"):
        name, colon, value = part.partition(":")
        name, value = name.strip(), re.sub(r"\s+", " ", value.strip())
        if colon and value and re.fullmatch(r"-?-?[a-zA-Z_\\][\w\\-]*", name):
            out.append((name if name.startswith("--") else name.lower(), re.sub(r"'([^'\"\\]*)'", r'"\1"', value)))
    return out


def unescaped(value: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return m[2]

    return _ESCAPE.sub(one, value)


@dataclass(frozen=True)
class CssPolicy:
    allow_urls: bool = False
    allow_data: bool = False
    allow_calc: bool = True
    allow_vars: bool = False
    allow_env: bool = False
    harden: bool = True
    ruleset: str = "default"

    @classmethod
    def of(cls, ruleset: str, **options) -> CssPolicy:
        """A policy by the functions it lets pass: default the known ones, strict besides url() only those that are switched on, permissive all but the bad ones."""
        if ruleset not in ("default", "strict", "permissive"):
            raise ValueError(f"a ruleset is default, strict or permissive, not {ruleset}")
        given = {"strict": {"allow_calc": False}, "permissive": {"allow_vars": True, "allow_env": True}}.get(ruleset, {})
        return cls(ruleset=ruleset, **(given | options))

    def url_ok(self, content: str) -> bool:
        u = content.strip().strip("\"'").strip()
        low = u.lower()
        if low.startswith(("javascript:", "vbscript:", "data:text/html", "data:text/javascript")):
            return False
        if low.startswith("data:"):
            return self.allow_data and len(u.encode()) <= 1024 and low.startswith("data:image/") and "svg" not in low
        return self.allow_urls or not ("://" in low or low.startswith("//"))

    def value_ok(self, value: str) -> bool:
        """Each function outside strings must be a known one."""
        value = unescaped(value)
        plain = re.sub(_STRING, lambda m: '"' * len(m[0]), value)
        for m in re.finditer(r"([A-Za-z0-9_-]*)\(", plain):
            name = m[1].lower()
            if not name:
                continue
            known = {"default": policy.CSS_FUNCTIONS, "strict": policy.CSS_STRICT_FUNCTIONS}.get(self.ruleset, (name,))
            if len(name) > 128 or name in policy.CSS_BAD_FUNCTIONS or name not in known:
                return False
            if {"calc": not self.allow_calc, "var": not self.allow_vars, "env": not self.allow_env}.get(name):
                return False
            if name == "url":
                end = value.find(")", m.end())
                if not self.url_ok(value[m.end() : end if end >= 0 else len(value)]):
                    return False
        return not (self.harden and re.search(r"javascript:|expression\s*\(", plain, re.I))

    def property_ok(self, name: str) -> bool:
        return len(name) <= 64 and name in policy.CSS_PROPERTIES and name not in policy.CSS_BAD_PROPERTIES

    def inline(self, css: str) -> str:
        """Declarations that stay, joined by '; '; empty if the text is too long or has an at-rule."""
        if len(css.encode()) > MAX_CSS or any(r in css.lower() for r in policy.CSS_AT_RULES):
            return ""
        return "; ".join(f"{n}: {v}" for n, v in declarations(css) if self.property_ok(n) and self.value_ok(v))

    def stylesheet(self, css: str) -> str:
        """Rules with declarations that stay, one to a line."""
        if len(css.encode()) > MAX_CSS:
            return ""
        out = []
        for selector, body, at in rules(css):
            if at is None:
                kept = "; ".join(f"{n}: {v}" for n, v in declarations(body or "") if self.property_ok(n) and self.value_ok(v))
                if kept and selector and ":has(" not in selector and "<" not in selector:
                    out.append(f"{selector} {{ {kept} }}\n")
            elif body is not None and at in ("media", "supports", "keyframes", "-webkit-keyframes", "layer", "container"):
                inner = self.stylesheet(body)
                if inner and "<" not in selector:
                    out.append(f"{selector} {{ {inner.strip()} }}\n")
        return "".join(out)


def rules(css: str) -> list[tuple[str, str | None, str | None]]:
    """Top rules: prelude, block (None for a statement), at-rule name (None for a style rule)."""
    css, out, i = _COMMENT.sub(" ", css).replace("<!--", " ").replace("-->", " "), [], 0
    token = re.compile(rf"{_STRING}|\\.|[{{}};]", re.S)
    while i < len(css):
        m = token.search(css, i)
        while m and m[0] not in "{};":
            m = token.search(css, m.end())
        prelude = css[i : m.start() if m else len(css)].strip()
        name = re.match(r"@([\w-]+)", prelude)
        if m is None or m[0] == "}" or (m[0] == ";" and name is None):
            if m is None or m[0] == ";":
                if name:
                    out.append((prelude, None, name[1].lower()))
            i = m.end() if m else len(css)
            continue
        if m[0] == ";":
            out.append((prelude, None, name[1].lower()))
            i = m.end()
            continue
        depth, j = 1, m.end()
        while depth and (t := token.search(css, j)):
            depth += {"{": 1, "}": -1}.get(t[0], 0)
            j = t.end()
        body = css[m.end() : j - 1] if not depth else css[m.end() :]
        out.append((re.sub(r"\s+", " ", prelude), body, name[1].lower() if name else None))
        i = j if not depth else len(css)
    return out


def rule_rows(css: str) -> list[dict]:
    """Style rules in order, those in media and other groups with the group's prelude: rule_no, selector, inside, declarations (name, value, important)."""
    out: list[dict] = []

    def walk(text: str, inside: str | None) -> None:
        for selector, body, at in rules(text):
            if at is None:
                found = [{"name": n, "value": re.sub(r"\s*!important$", "", v), "important": v.endswith("!important")} for n, v in declarations(body or "")]
                out.append({"rule_no": len(out), "selector": selector, "inside": inside, "declarations": found})
            elif body is not None and at in ("media", "supports", "layer", "container"):
                walk(body, selector if inside is None else f"{inside} {selector}")

    walk(css, None)
    return out
