"""Markdown to HTML: block structure by lines, then inline marks; tables, task lists, strikethrough and bare links; raw HTML stays.

The result is to be sanitised like any other HTML.  Lists and quotes nest by
taking a container's lines and reading them as a text of their own.  Emphasis
pairs the nearest marks, which differs from the full rule of threes in rare
mixtures of ``*`` runs; link titles may not span lines.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

_ESCAPABLE = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])(?:([ \t]+)(.*)|)$")
_QUOTE = re.compile(r" {0,3}> ?")
_BLOCK_TAG = re.compile(
    r" {0,3}<(?:!--|[!?]|/?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|textarea|th|thead|title|tr|ul)(?:[\s/>]|$))",
    re.I,
)
_RAW_END = re.compile(r" {0,3}<(script|pre|style|textarea|!--)", re.I)
_REFERENCE = re.compile(r" {0,3}\[([^\[\]]+)\]:[ \t]*(<[^<>]*>|\S+)(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_DIVIDER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_RAW_TAG = re.compile(r"<!--.*?-->|<[?!][^>]*>|</[A-Za-z][A-Za-z0-9-]*\s*>|<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>", re.S)
_ANGLE_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_ANGLE_MAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+[^\s<]*", re.I)
_BARE_MAIL = re.compile(r"[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TARGET = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_RUN = re.compile(r"[^\W_]+| +|.", re.S)
#: Containers deeper than this are read as plain paragraphs.
DEPTH = 60


def _esc(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _plain(s: str) -> str:
    """Text of a link target, title or code language: escapes and character references resolved."""
    return html.unescape(re.sub(rf"\\([{_ESCAPABLE}])", r"\1", s))


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def _link(body: str, target: str, title: str | None) -> str:
    target = target[1:-1] if target.startswith("<") else target
    named = f' title="{_esc(_plain(title[1:-1]))}"' if title else ""
    return f'<a href="{_esc(_plain(target))}"{named}>{body}</a>'


def _image(body: str, target: str, title: str | None) -> str:
    target = target[1:-1] if target.startswith("<") else target
    named = f' title="{_esc(_plain(title[1:-1]))}"' if title else ""
    return f'<img src="{_esc(_plain(target))}" alt="{_esc(html.unescape(re.sub("<[^>]*>", "", body)))}"{named}>'


def _brackets(s: str) -> dict[int, int]:
    """Places of brackets and of those that close them."""
    waiting, found = [], {}
    for m in re.finditer(r"\\.|[\[\]]", s, re.S):
        if m.group() == "[":
            waiting.append(m.start())
        elif m.group() == "]" and waiting:
            found[waiting.pop()] = m.start()
    return found


def _bare_end(url: str) -> str:
    """A bare link without closing punctuation that belongs to the sentence."""
    while url:
        if url[-1] in "?!.,:*_~'\"" or url[-1] == ")" and url.count(")") > url.count("("):
            url = url[:-1]
        else:
            break
    return url


def inline(s: str, refs: dict[str, tuple[str, str | None]], links: bool = True, depth: int = 0) -> str:
    """Inline marks of a paragraph's text as HTML."""
    out: list[str] = []
    marks: list[tuple[str, int, int, bool]] = []  # mark, its length, its place in out, may close
    closes = {m.group(): [] for m in re.finditer("`+", s)}
    for m in re.finditer("`+", s):
        closes[m.group()].append(m.start())
    brackets = _brackets(s) if depth < DEPTH else {}
    i, n = 0, len(s)
    while i < n:
        c = s[i]
        if c == "\\" and i + 1 < n:
            if s[i + 1] == "\n":
                out.append("<br>\n")
            else:
                out.append(_esc(s[i + 1]) if re.match(f"[{_ESCAPABLE}]", s[i + 1]) else "\\" + _esc(s[i + 1]))
            i += 2
        elif c == "`":
            run = re.compile("`+").match(s, i).group()
            k = bisect_left(closes[run], i + len(run))
            end = closes[run][k] if k < len(closes[run]) else -1
            if end < 0:
                out.append(run)
                i += len(run)
            else:
                code = s[i + len(run) : end].replace("\n", " ")
                if code.strip() and code[0] == code[-1] == " ":
                    code = code[1:-1]
                out.append(f"<code>{_esc(code)}</code>")
                i = end + len(run)
        elif c == "<":
            if m := _ANGLE_URI.match(s, i):
                out.append(f'<a href="{_esc(m[1])}">{_esc(m[1])}</a>')
            elif m := _ANGLE_MAIL.match(s, i):
                out.append(f'<a href="mailto:{_esc(m[1])}">{_esc(m[1])}</a>')
            elif m := _RAW_TAG.match(s, i):
                out.append(m.group())
            else:
                out.append("&lt;")
            i = m.end() if m else i + 1
        elif c == "&":
            m = _ENTITY.match(s, i)
            out.append(m.group() if m else "&amp;")
            i = m.end() if m else i + 1
        elif c == "[" or c == "!" and s.startswith("![", i):
            image = c == "!"
            at = i + image
            end, made = brackets.get(at, -1), None
            if end >= 0 and (image or links):
                text, m = s[at + 1 : end], _TARGET.match(s, end + 1)
                ref = re.compile(r"\[([^\[\]]*)\]").match(s, end + 1)
                if m:
                    made = m[1], m[2], m.end()
                elif ref and _label(ref[1] or text) in refs:
                    made = *refs[_label(ref[1] or text)], ref.end()
                elif not ref and _label(text) in refs:
                    made = *refs[_label(text)], end + 1
            if made:
                body = inline(text, refs, image, depth + 1)
                out.append((_image if image else _link)(body, made[0], made[1]))
                i = made[2]
            else:
                out.append(s[i : at + 1])
                i = at + 1
        elif c in "*_~":
            run = re.compile(re.escape(c) + "+").match(s, i).group()
            before, after = s[i - 1] if i else " ", s[i + len(run)] if i + len(run) < n else " "
            solid = lambda x: not x.isspace()
            punct = lambda x: not x.isalnum() and not x.isspace()
            left = solid(after) and (not punct(after) or not solid(before) or punct(before))
            right = solid(before) and (not punct(before) or not solid(after) or punct(after))
            if c == "_":
                left, right = left and (not right or punct(before)), right and (not left or punct(after))
            size = len(run)
            if c == "~" and size > 2:
                left = right = False
            while right and size:
                k = next((k for k in range(len(marks) - 1, -1, -1) if marks[k][0] == c and (c != "~" or marks[k][1] == size)), -1)
                if k < 0:
                    break
                _, have, place, _ = marks[k]
                use = size if c == "~" else 2 if min(have, size) >= 2 else 1
                tag = "del" if c == "~" else "strong" if use == 2 else "em"
                del marks[k + 1 :]
                out[place] = c * (have - use) if have > use else ""
                out.insert(place + 1, f"<{tag}>")
                out.append(f"</{tag}>")
                marks[k:] = [(c, have - use, place, True)] if have > use else []
                size -= use
            if size:
                out.append(c * size)
                if left:
                    marks.append((c, size, len(out) - 1, right))
            i += len(run)
        elif c == "\n":
            hard = out and out[-1].endswith("  ")
            if out:
                out[-1] = out[-1].rstrip(" ")
            out.append("<br>\n" if hard else "\n")
            i += 1
        else:
            start_of_word = not i or not (s[i - 1].isalnum() or s[i - 1] in "/@.")
            m = (_BARE.match(s, i) or _BARE_MAIL.match(s, i)) if links and start_of_word and c.isalnum() else None
            url = _bare_end(m.group()) if m else ""
            if url:
                full = url if "://" in url else ("http://" if url.lower().startswith("www.") else "mailto:") + url
                out.append(f'<a href="{_esc(full)}">{_esc(url)}</a>')
                i += len(url)
            else:
                text = _RUN.match(s, i).group()
                out.append(_esc(text))
                i += len(text)
    return "".join(out)


def _cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip().removeprefix("|"))
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


def _table(lines: list[str], refs: dict) -> str:
    head, rule = _cells(lines[0]), _cells(lines[1])
    side = [" align=\"center\"" if r[0] == r[-1] == ":" else " align=\"left\"" if r[0] == ":" else " align=\"right\"" if r[-1] == ":" else "" for r in rule]

    def row(cells: list[str], tag: str) -> str:
        cells = (cells + [""] * len(side))[: len(side)]
        return "<tr>\n" + "".join(f"<{tag}{a}>{inline(c, refs)}</{tag}>\n" for a, c in zip(side, cells, strict=True)) + "</tr>\n"

    body = "".join(row(_cells(x), "td") for x in lines[2:])
    return f"<table>\n<thead>\n{row(head, 'th')}</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>\n"


def _opens(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if _RULE.match(line) or _HEADING.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _BLOCK_TAG.match(line):
        return True
    m = _ITEM.match(line)
    return bool(m and m[4] and (not m[2][0].isdigit() or m[2][:-1] == "1"))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _list(lines: list[str], i: int, refs: dict, depth: int) -> tuple[str, int]:
    """The list that begins at line i, and the line after it."""
    mark, items, loose = _ITEM.match(lines[i])[2], [], False
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m or m[2][-1] != mark[-1] or _RULE.match(lines[i]):
            break
        gap = len(m[3] or "")
        width = len(m[1]) + len(m[2]) + (gap if 1 <= gap <= 4 and m[4] else 1)
        item = [" " * (gap - 1) + m[4] if gap > 4 else m[4] or ""]
        i += 1
        while i < len(lines):
            if not lines[i].strip():
                j = next((j for j in range(i, len(lines)) if lines[j].strip()), len(lines))
                if j == len(lines) or _indent(lines[j]) < width:
                    break
                item += [""] * (j - i)
                i = j
            elif _indent(lines[i]) >= width:
                item.append(lines[i][width:])
                i += 1
            elif item[-1].strip() and not _opens(lines[i]) and not _ITEM.match(lines[i]):
                item.append(lines[i].lstrip())
                i += 1
            else:
                break
        j = next((j for j in range(i, len(lines)) if lines[j].strip()), len(lines))
        more = j < len(lines) and (n := _ITEM.match(lines[j])) and n[2][-1] == mark[-1] and not _RULE.match(lines[j])
        loose |= bool(j > i and more) or any(not x.strip() for x in item[1:-1])
        items.append(item)
        if not more:
            break
        i = j
    out = []
    for item in items:
        task = _TASK.match(item[0])
        if task:
            item[0] = item[0][task.end() :]
        box = f'<input type="checkbox" class="task-list-item-checkbox" disabled{" checked" if task[1] != " " else ""}> ' if task else ""
        body = _blocks(item, refs, depth + 1, tight=not loose)
        if loose and box and body.startswith("<p>"):
            body = "<p>" + box + body[3:]
            box = ""
        out.append(f'<li{" class=" + chr(34) + "task-list-item" + chr(34) if task else ""}>{chr(10) if loose else ""}{box}{body.rstrip() if not loose else body}</li>\n')
    ordered = mark[0].isdigit()
    start = f' start="{int(mark[:-1])}"' if ordered and int(mark[:-1]) != 1 else ""
    return f"<ol{start}>\n{''.join(out)}</ol>\n" if ordered else f"<ul>\n{''.join(out)}</ul>\n", i


def _blocks(lines: list[str], refs: dict, depth: int = 0, tight: bool = False) -> str:
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            code = []
            while i < n and (_indent(lines[i]) >= 4 or not lines[i].strip()):
                code.append(lines[i][4:])
                i += 1
            while not code[-1].strip():
                code.pop()
            out.append("<pre><code>" + _esc("\n".join(code)) + "\n</code></pre>\n")
        elif m := _FENCE.match(line):
            close, code = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$"), []
            i += 1
            while i < n and not close.match(lines[i]):
                code.append(lines[i][min(len(m[1]), _indent(lines[i])) :])
                i += 1
            i += 1
            lang = m[3].split()[0] if m[3].strip() else ""
            named = f' class="language-{_esc(_plain(lang))}"' if lang else ""
            out.append(f"<pre><code{named}>" + _esc("".join(x + "\n" for x in code)) + "</code></pre>\n")
        elif m := _HEADING.match(line):
            k = len(m[1])
            out.append(f"<h{k}>{inline((m[2] or '').strip(), refs)}</h{k}>\n")
            i += 1
        elif _RULE.match(line):
            out.append("<hr>\n")
            i += 1
        elif _QUOTE.match(line) and depth < DEPTH:
            inner = []
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or inner[-1].strip() and not _opens(lines[i])):
                inner.append(_QUOTE.sub("", lines[i], count=1))
                i += 1
            out.append("<blockquote>\n" + _blocks(inner, refs, depth + 1) + "</blockquote>\n")
        elif _ITEM.match(line) and depth < DEPTH:
            made, i = _list(lines, i, refs, depth)
            out.append(made)
        elif _BLOCK_TAG.match(line):
            raw, kind = [], _RAW_END.match(line)
            end = ("-->" if kind[1] == "!--" else f"</{kind[1].lower()}>") if kind else None
            while i < n and (end or lines[i].strip()):
                raw.append(lines[i])
                i += 1
                if end and end in raw[-1].lower():
                    break
            out.append("\n".join(raw) + "\n")
        elif "|" in line and i + 1 < n and _DIVIDER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            j = i + 2
            while j < n and lines[j].strip() and not _opens(lines[j]):
                j += 1
            out.append(_table(lines[i:j], refs))
            i = j
        else:
            text, level = [line.lstrip()], 0
            i += 1
            while i < n and lines[i].strip():
                if m := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[i]):
                    level = 1 if m[1][0] == "=" else 2
                    i += 1
                    break
                if _opens(lines[i]):
                    break
                text.append(lines[i].lstrip())
                i += 1
            body = inline("\n".join(text).rstrip(), refs)
            out.append(f"<h{level}>{body}</h{level}>\n" if level else body + "\n" if tight else f"<p>{body}</p>\n")
    return "".join(out)


def markdown_to_html(text: str) -> str:
    """The HTML of a Markdown text; an empty text gives an empty string."""
    lines = [re.sub(r"\t", "    ", x) for x in text.replace("\0", "�").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    refs: dict[str, tuple[str, str | None]] = {}
    kept, fence = [], None
    for x in lines:
        m = _FENCE.match(x)
        if fence is None and m:
            fence = m[2]
        elif fence is not None and m and m[2].startswith(fence) and not m[3].strip():
            fence = None
        r = _REFERENCE.match(x) if fence is None and not m and (not kept or not kept[-1].strip()) else None
        if r:
            refs.setdefault(_label(r[1]), (r[2], r[3]))
        else:
            kept.append(x)
    return _blocks(kept, refs)
