"""HTML parsing to a tree after the WHATWG rules, and serialising it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

HTML, SVG, MATHML = "html", "svg", "math"
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen basefont bgsound frame".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(["title", "textarea"])
AS_TEXT = RAW | RCDATA
HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 "
    "h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select "
    "source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing form table hr xmp plaintext "
    "h1 h2 h3 h4 h5 h6 li dd dt".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SVG_NAMES = {
    n.lower(): n
    for n in "altGlyph animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow "
    "feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef "
    "linearGradient radialGradient textPath".split()
}
SVG_ATTRIBUTES = {
    n.lower(): n
    for n in "attributeName attributeType baseFrequency calcMode clipPathUnits edgeMode filterUnits gradientTransform gradientUnits kernelMatrix keyPoints keySplines keyTimes lengthAdjust limitingConeAngle "
    "markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha "
    "preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles "
    "surfaceScale systemLanguage tableValues targetX targetY textLength viewBox xChannelSelector yChannelSelector zoomAndPan".split()
}
ELEMENT, TEXT, COMMENT, DOCUMENT, FRAGMENT = 1, 3, 8, 9, 11


class Node:
    __slots__ = ("type", "name", "ns", "attrs", "data", "children", "parent", "content")

    def __init__(self, kind: int, name: str = "", ns: str = HTML, attrs: list[tuple[str, str]] | None = None, data: str = ""):
        self.type, self.name, self.ns, self.attrs, self.data = kind, name, ns, attrs or [], data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.content = Node(FRAGMENT) if kind == ELEMENT and name == "template" and ns == HTML else None

    def get(self, name: str) -> str | None:
        return next((v for n, v in self.attrs if n == name), None)

    def put(self, child: Node, before: Node | None = None) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.insert(self.children.index(before) if before is not None else len(self.children), child)

    def walk(self) -> Iterator[Node]:
        """The node's descendants in order, without template contents."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def text(self) -> str:
        return "".join(n.data for n in self.walk() if n.type == TEXT)


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|["'])*+)>""")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_REF = re.compile(r"&(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)(?=([=A-Za-z0-9])?)")


def attribute_value(value: str) -> str:
    """A value with its character references decoded; a name without semicolon before = or a letter stays."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#" and not name.endswith(";"):
            return unescape(m[0]) if name in html5 and not m[2] else m[0]
        return unescape(m[0])

    return _REF.sub(one, value)


def tokens(html: str, raw_after: dict[str, str]) -> Iterator[tuple[str, str, list[tuple[str, str]], bool]]:
    """(kind, name or text, attributes, self-closing) for text, start, end, comment; raw_after is told what element's raw text comes next."""
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    i, n = 0, len(html)
    while i < n:
        raw = raw_after.pop("name", None)
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(html, i)
            end = m.start() if m else n
            if end > i:
                body = html[i:end].replace("\0", "�")
                yield "text", unescape(body) if raw in RCDATA else body, [], False
            i = end
            if i >= n:
                return
        lt = html.find("<", i)
        if lt < 0:
            yield "text", unescape(html[i:]), [], False
            return
        if lt > i:
            yield "text", unescape(html[i:lt]), [], False
        if html.startswith("<!--", lt):
            m = re.compile(r"<!--(?:-?>|(.*?)(?:--!?>|\Z))", re.S).match(html, lt)
            yield "comment", (m[1] or "").replace("\0", "�"), [], False
            i = m.end()
        elif m := _TAG.match(html, lt):
            name, attrs = m[2].lower().replace("\0", "�"), []
            i = m.end()
            if not m[3]:
                yield ("end" if m[1] else "start"), name, attrs, False
                continue
            seen = set()
            for a in _ATTR.finditer(m[3]):
                key = a[1].lower().replace("\0", "�")
                if key not in seen:
                    seen.add(key)
                    attrs.append((key, attribute_value(a[2] or a[3] or a[4] or "").replace("\0", "�")))
            yield ("end" if m[1] else "start"), name, attrs, m[3].rstrip().endswith("/") and not re.search(r"=\s*[^\s\"']+/$", m[3])
        elif html[lt + 1 : lt + 2] in ("!", "?", "/") and html[lt + 1 : lt + 3] != "</":
            if html.startswith("</>", lt):
                i = lt + 3
                continue
            end = html.find(">", lt)
            body = html[lt + 2 : end if end >= 0 else n]
            if html.startswith("<![CDATA[", lt):
                stop = html.find("]]>", lt)
                yield "cdata", html[lt + 9 : stop if stop >= 0 else n], [], False
                i = stop + 3 if stop >= 0 else n
                continue
            if html[lt + 1] == "!" and body[:7].lower() == "doctype":
                yield "doctype", body[7:].strip(), [], False
            elif html[lt + 1] == "/" and end < 0 and re.match(r"[a-zA-Z]", body):
                return
            else:
                yield "comment", ("?" if html[lt + 1] == "?" else "") + body, [], False
            i = end + 1 if end >= 0 else n
        elif re.match(r"<[a-zA-Z]", html[lt : lt + 2]):
            return  # the end of the text is inside a tag
        else:
            yield "text", "<", [], False
            i = lt + 1


_FOREIGN_STOPS = frozenset("foreignObject desc title annotation-xml mi mo mn ms mtext".split())


class Stack(list):
    """Open elements, with the places of each HTML name, and under "" of foreign elements that end a scope: nothing is looked for by going through the stack."""

    def __init__(self, some=()):
        super().__init__(some)
        self._count()

    @staticmethod
    def key(e: Node) -> str | None:
        return e.name if e.ns == HTML else "" if e.name in _FOREIGN_STOPS else None

    def _count(self) -> None:
        self.at: dict[str | None, list[int]] = {}
        self.ids = set(map(id, self))
        for i, e in enumerate(self):
            self.at.setdefault(self.key(e), []).append(i)

    def last(self, names) -> int:
        """Place of the last element of one of the names, or -1."""
        found, at = -1, self.at
        for n in names:
            places = at.get(n)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def __contains__(self, e) -> bool:
        return id(e) in self.ids

    def append(self, e: Node) -> None:
        self.at.setdefault(self.key(e), []).append(len(self))
        self.ids.add(id(e))
        super().append(e)

    def pop(self) -> Node:
        e = super().pop()
        self.at[self.key(e)].pop()
        self.ids.discard(id(e))
        return e

    def __delitem__(self, where) -> None:
        if isinstance(where, slice) and where.stop is None and where.step is None:
            for _ in range(len(self) - where.indices(len(self))[0]):
                self.pop()
        else:
            super().__delitem__(where)
            self._count()

    def __setitem__(self, where, e) -> None:
        super().__setitem__(where, e)
        self._count()

    def insert(self, i: int, e: Node) -> None:
        super().insert(i, e)
        self._count()

    def remove(self, e: Node) -> None:
        super().remove(e)
        self._count()


class Builder:
    """Tree construction.  Template contents are fragments of their own; frames are not built."""

    def __init__(self, fragment: bool = False):
        self.doc = Node(DOCUMENT, "#document")
        self.stack = Stack()
        self.active: list[Node | None] = []
        self.head: Node | None = None
        self.body: Node | None = None
        self.form: Node | None = None
        self.raw: dict[str, str] = {}
        self.after_head = self.ended = self.foster = self.skip_lf = False
        self.fragment = fragment
        if fragment:
            root = Node(ELEMENT, "template")
            self.doc.put(root)
            self.stack = Stack([root])

    # the stack
    @property
    def now(self) -> Node:
        return self.stack[-1]

    def in_scope(self, names, extra=frozenset(), stop=SCOPE) -> bool:
        found = self.stack.last(names)
        return found >= 0 and found >= max(self.stack.last(stop), self.stack.last(extra), self.stack.last(("",)))

    def in_table_scope(self, names) -> bool:
        return self.in_scope(names, stop=frozenset(["html", "table", "template"]))

    def pop_to(self, names) -> None:
        while self.stack:
            e = self.stack.pop()
            if e.name in names and e.ns == HTML:
                return

    def imply(self, but: str = "") -> None:
        while self.now.name in IMPLIED and self.now.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope(("p",), {"button"}):
            self.imply("p")
            self.pop_to(("p",))

    # putting in
    def place(self) -> tuple[Node, Node | None]:
        top = self.now
        if self.foster and top.ns == HTML and top.name in TABLE_PARTS:
            for i in range(len(self.stack) - 1, -1, -1):
                e = self.stack[i]
                if e.content is not None:
                    return e.content, None
                if e.name == "table" and e.ns == HTML:
                    return (e.parent, e) if e.parent is not None else (self.stack[i - 1], None)
            return self.stack[0], None
        return (top.content, None) if top.content is not None else (top, None)

    def add_text(self, text: str) -> None:
        if not text:
            return
        parent, before = self.place()
        at = parent.children.index(before) if before is not None else len(parent.children)
        if at and parent.children[at - 1].type == TEXT:
            parent.children[at - 1].data += text
        else:
            parent.put(Node(TEXT, "#text", data=text), before)

    def add(self, name: str, attrs, ns: str = HTML) -> Node:
        e = Node(ELEMENT, name, ns, list(attrs))
        parent, before = self.place()
        parent.put(e, before)
        self.stack.append(e)
        return e

    def comment(self, text: str) -> None:
        c = Node(COMMENT, "#comment", data=text)
        if not self.stack:
            self.doc.put(c)
        elif self.ended:
            self.stack[0].put(c)
        else:
            parent, before = self.place()
            parent.put(c, before)

    # document parts
    def need_html(self, attrs=()) -> None:
        if not self.stack:
            root = Node(ELEMENT, "html", attrs=list(attrs))
            self.doc.put(root)
            self.stack.append(root)

    def need_head(self, attrs=()) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.add("head", attrs)

    def need_body(self, attrs=()) -> None:
        if self.fragment or self.body is not None:
            return
        self.need_head()
        self.after_head = True
        while len(self.stack) > 1:
            self.stack.pop()
        self.body = self.add("body", attrs)

    def in_template(self) -> bool:
        return bool(self.stack.at.get("template"))

    # active formatting elements
    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for j in range(i, len(self.active)):
            self.active[j] = self.add(self.active[j].name, self.active[j].attrs)

    def push_active(self, e: Node) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            a = self.active[i]
            if a is None:
                break
            if a.name == e.name and sorted(a.attrs) == sorted(e.attrs):
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(e)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, name: str) -> None:
        """The adoption agency for an end tag of a formatting element."""
        if self.now.name == name and self.now not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for a in reversed(self.active):
                if a is None:
                    break
                if a.name == name:
                    fmt = a
                    break
            if fmt is None:
                self.any_end(name)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            if not self.in_scope((name,)):
                return
            at = self.stack.index(fmt)
            far = next((e for e in self.stack[at + 1 :] if e.name in SPECIAL or e.ns != HTML and e.name in ("foreignObject", "desc", "title")), None)
            if far is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            common, mark = self.stack[at - 1], self.active.index(fmt)
            last, i, inner = far, self.stack.index(far), 0
            while True:
                inner += 1
                i -= 1
                e = self.stack[i]
                if e is fmt:
                    break
                if inner > 3 and e in self.active:
                    if self.active.index(e) < mark:
                        mark -= 1
                    self.active.remove(e)
                if e not in self.active:
                    del self.stack[i]
                    continue
                new = Node(ELEMENT, e.name, attrs=list(e.attrs))
                self.active[self.active.index(e)] = self.stack[i] = new
                if last is far:
                    mark = self.active.index(new) + 1
                new.put(last)
                last = new
            if common.name in TABLE_PARTS and common.ns == HTML:
                keep, self.foster, held = self.foster, True, self.stack
                self.stack = held[: at]
                parent, before = self.place()
                self.stack, self.foster = held, keep
            else:
                parent, before = (common.content, None) if common.content is not None else (common, None)
            parent.put(last, before)
            new = Node(ELEMENT, fmt.name, attrs=list(fmt.attrs))
            for c in list(far.children):
                new.put(c)
            far.put(new)
            old = self.active.index(fmt)
            self.active.remove(fmt)
            self.active.insert(mark - (old < mark), new)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(far) + 1, new)

    def any_end(self, name: str) -> None:
        if not self.stack.at.get(name):
            return
        if self.now.name == name and self.now.ns == HTML:
            self.imply(name)
            self.stack.pop()
            return
        for i in range(len(self.stack) - 1, -1, -1):
            e = self.stack[i]
            if e.name == name and e.ns == HTML:
                self.imply(name)
                del self.stack[i:]
                return
            if e.name in SPECIAL and e.ns == HTML:
                return

    # tokens
    def feed(self, html: str) -> Node:
        if self.fragment is False and not html:
            self.need_body()
        for kind, name, attrs, closed in tokens(html, self.raw):
            if kind == "text":
                self.text(name)
            elif kind == "start":
                self.skip_lf = False
                self.start(name, attrs, closed)
            elif kind == "end":
                self.end(name)
            elif kind == "comment":
                self.comment(name)
            elif kind == "cdata":
                if self.stack and self.now.ns != HTML:
                    self.add_text(name)
                else:
                    self.comment("[CDATA[" + name + "]]")
        self.need_body()
        return self.doc

    def text(self, text: str) -> None:
        if self.skip_lf:
            self.skip_lf = False
            text = text.removeprefix("\n")
        if self.stack and self.now.ns == HTML and self.now.name in AS_TEXT:
            self.add_text(text)
            return
        if self.stack and self.now.ns != HTML:
            self.add_text(text.replace("\0", "�"))
            return
        text = text.replace("\0", "")
        if not self.fragment and self.body is None and not self.in_template():
            rest = text.lstrip(" \t\n\f")
            space = text[: len(text) - len(rest)]
            if self.stack and space and (self.head is not None):
                self.add_text(space)
            if not rest:
                return
            self.need_body()
            text = rest
        if self.now.ns == HTML and self.now.name in TABLE_PARTS and text.strip(" \t\n\f"):
            self.foster = True
            self.reconstruct()
            self.add_text(text)
            self.foster = False
            return
        if self.now.name in ("colgroup",) and text.strip():
            self.stack.pop()
            self.text(text)
            return
        if self.now.name not in TABLE_PARTS:
            self.reconstruct()
        self.add_text(text)

    def raw_text(self, name: str, attrs) -> None:
        self.add(name, attrs)
        self.raw["name"] = name
        self.skip_lf = name == "textarea"

    def start(self, name: str, attrs, closed: bool) -> None:
        if self.stack and self.now.ns != HTML and not self.integration(name):
            self.foreign_start(name, attrs, closed)
            return
        if name == "html":
            self.need_html(attrs)
            if not self.fragment and not self.in_template():
                have = {n for n, _ in self.stack[0].attrs}
                self.stack[0].attrs += [a for a in attrs if a[0] not in have]
            return
        if not self.fragment and self.body is None and not self.in_template():
            if name == "head":
                if self.head is None:
                    self.need_head(attrs)
                return
            if name in HEAD or name == "noscript" and self.head is not None and self.now is self.head:
                self.need_head()
                if self.after_head:
                    self.stack.append(self.head)
                self.head_start(name, attrs)
                if self.after_head and self.head in self.stack and name not in ("template",) and "name" not in self.raw:
                    self.stack.remove(self.head)
                return
            if name == "body":
                self.need_body(attrs)
                return
            if name == "frameset":
                return
            self.need_body()
        self.body_start(name, attrs, closed)

    def head_start(self, name: str, attrs) -> None:
        if name in RAW or name == "title":
            self.raw_text(name, attrs)
        elif name in ("template", "noscript"):
            self.add(name, attrs)
            if name == "template":
                self.active.append(None)
        else:
            self.add(name, attrs)
            self.stack.pop()

    def integration(self, name: str) -> bool:
        e = self.now
        if e.ns == SVG and e.name in ("foreignObject", "desc", "title"):
            return True
        if e.ns == MATHML and e.name in ("mi", "mo", "mn", "ms", "mtext"):
            return name not in ("mglyph", "malignmark")
        if e.ns == MATHML and e.name == "annotation-xml":
            return (e.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml") or name == "svg"
        return False

    def foreign_start(self, name: str, attrs, closed: bool) -> None:
        if name in BREAKOUT or name == "font" and any(a in ("color", "face", "size") for a, _ in attrs):
            while self.now.ns != HTML and not self.integration(name):
                self.stack.pop()
            self.start(name, attrs, closed)
            return
        ns = self.now.ns
        self.add_foreign(name, attrs, ns)
        if closed:
            self.stack.pop()

    def add_foreign(self, name: str, attrs, ns: str) -> None:
        if ns == SVG:
            name, attrs = SVG_NAMES.get(name, name), [(SVG_ATTRIBUTES.get(n, n), v) for n, v in attrs]
        else:
            attrs = [("definitionURL" if n == "definitionurl" else n, v) for n, v in attrs]
        self.add(name, attrs, ns)

    def table_start(self, name: str, attrs, closed: bool) -> bool:
        """A start tag inside a table but outside its cells; False if it is for the body rules."""
        if name in ("caption", "colgroup", "tbody", "thead", "tfoot"):
            while self.now.name not in ("table", "template", "html"):
                self.stack.pop()
            self.add(name, attrs)
            if name == "caption":
                self.active.append(None)
        elif name == "col":
            if self.now.name != "template":
                while self.now.name not in ("table", "template", "html"):
                    self.stack.pop()
                self.add("colgroup", ())
            self.add(name, attrs)
            self.stack.pop()
        elif name == "tr":
            while self.now.name not in ("table", "tbody", "thead", "tfoot", "template", "html"):
                self.stack.pop()
            if self.now.name == "table":
                self.add("tbody", ())
            self.add(name, attrs)
        elif name in ("td", "th"):
            if self.now.name == "table":
                self.add("tbody", ())
            if self.now.name in ("tbody", "thead", "tfoot"):
                self.add("tr", ())
            while self.now.name not in ("tr", "template", "html"):
                self.stack.pop()
            self.add(name, attrs)
            self.active.append(None)
        elif name == "table":
            if self.in_table_scope(("table",)):
                self.pop_to(("table",))
                self.start(name, attrs, closed)
        elif name in ("style", "script", "template"):
            self.head_start(name, attrs)
        elif name == "input" and any(n == "type" and v.lower() == "hidden" for n, v in attrs):
            self.add(name, attrs)
            self.stack.pop()
        else:
            return False
        return True

    def body_start(self, name: str, attrs, closed: bool) -> None:
        top = self.now
        if top.name in ("select",) or self.in_scope(("select",), stop=frozenset(["html", "template", "table"])):
            if name in ("option", "optgroup", "hr"):
                if self.now.name == "option":
                    self.stack.pop()
                if name != "option" and self.now.name == "optgroup":
                    self.stack.pop()
                self.add(name, attrs)
                if name == "hr":
                    self.stack.pop()
            elif name == "select":
                self.pop_to(("select",))
            elif name in ("input", "keygen", "textarea") or name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
                self.pop_to(("select",))
                self.start(name, attrs, closed)
            elif name in ("script", "template"):
                self.head_start(name, attrs)
            return
        cells = ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if top.ns == HTML and (top.name in TABLE_PARTS or top.name == "colgroup" or top.content is not None and name in cells):
            if top.name == "colgroup" and name not in ("col", "template"):
                self.stack.pop()
                self.start(name, attrs, closed)
                return
            if top.content is not None and name in cells:
                self.add(name, attrs)
                if name in ("td", "th", "caption"):
                    self.active.append(None)
                elif name == "col":
                    self.stack.pop()
                return
            if top.name == "colgroup" and name == "col":
                self.add(name, attrs)
                self.stack.pop()
                return
            if self.table_start(name, attrs, closed):
                return
            self.foster = True
            self.flow_start(name, attrs, closed)
            self.foster = False
            return
        if name in cells:
            if self.in_table_scope(("td", "th", "caption")):
                self.imply()
                self.pop_to(("td", "th", "caption"))
                self.clear_active()
                self.start(name, attrs, closed)
            elif self.in_table_scope(("table", "tr", "tbody", "thead", "tfoot")):
                while self.now.name not in TABLE_PARTS:
                    self.stack.pop()
                self.start(name, attrs, closed)
            return
        self.flow_start(name, attrs, closed)

    def flow_start(self, name: str, attrs, closed: bool) -> None:
        if name in HEAD:
            self.head_start(name, attrs)
            return
        if name == "body":
            if self.body is not None and not self.in_template():
                have = {n for n, _ in self.body.attrs}
                self.body.attrs += [a for a in attrs if a[0] not in have]
            return
        if name in ("head", "frameset", "frame"):
            return
        if name == "form" and self.form is not None and not self.in_template():
            return
        if name in ("li", "dd", "dt"):
            like = ("li",) if name == "li" else ("dd", "dt")
            for e in reversed(self.stack):
                if e.name in like:
                    self.imply(e.name)
                    self.pop_to((e.name,))
                    break
                if e.name in SPECIAL and e.name not in ("address", "div", "p"):
                    break
        if name in CLOSES_P:
            self.close_p()
        if name in HEADINGS and self.now.name in HEADINGS:
            self.stack.pop()
        if name == "button" and self.in_scope(("button",)):
            self.imply()
            self.pop_to(("button",))
        if name in ("optgroup", "option") and self.now.name == "option":
            self.stack.pop()
        if name in ("rb", "rtc", "rp", "rt") and self.in_scope(("ruby",)):
            self.imply("rtc" if name in ("rp", "rt") else "")
        if name == "image":
            name = "img"
        if name in ("math", "svg"):
            self.reconstruct()
            self.add_foreign(name, attrs, MATHML if name == "math" else SVG)
            if closed:
                self.stack.pop()
            return
        if name in FORMATTING:
            if name == "a":
                for e in reversed(self.active):
                    if e is None:
                        break
                    if e.name == "a":
                        self.adopt("a")
                        if e in self.active:
                            self.active.remove(e)
                        if e in self.stack:
                            self.stack.remove(e)
                        break
            self.reconstruct()
            if name == "nobr" and self.in_scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.push_active(self.add(name, attrs))
            return
        if name in RAW or name == "textarea":
            if name == "xmp":
                self.reconstruct()
            self.raw_text(name, attrs)
            return
        if name not in CLOSES_P or name in ("hr",):
            self.reconstruct()
        e = self.add(name, attrs)
        if name in VOID:
            self.stack.pop()
        elif name == "form" and not self.in_template():
            self.form = e
        elif name in ("pre", "listing"):
            self.skip_lf = True
        elif name in ("applet", "marquee", "object"):
            self.active.append(None)

    def end(self, name: str) -> None:
        if not self.stack:
            if name in ("head", "body", "html", "br"):
                self.need_body()
            return
        if self.now.ns != HTML:
            for i in range(len(self.stack) - 1, 0, -1):
                e = self.stack[i]
                if e.ns == HTML:
                    break
                if e.name.lower() == name:
                    del self.stack[i:]
                    return
        top = self.now
        if top.name == name and name in AS_TEXT:
            self.stack.pop()
            if self.after_head and self.body is None and self.head in self.stack:
                self.stack.remove(self.head)
            return
        if name == "template":
            if len(self.stack.at.get("template", ())) > self.fragment:
                self.imply()
                self.pop_to(("template",))
                self.clear_active()
            return
        if name == "head" and self.body is None and self.head is not None and not self.in_template():
            while len(self.stack) > 1:
                self.stack.pop()
            self.after_head = True
            return
        if name in ("body", "html"):
            self.need_body()
            self.ended = self.ended or name == "html"
            return
        if self.body is None and not self.fragment and not self.in_template() and name != "noscript":
            if name == "br":
                self.need_body()
            else:
                return
        if name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            if self.in_table_scope((name,)):
                if name in ("td", "th", "caption"):
                    self.imply()
                self.pop_to((name,))
                if name in ("td", "th", "caption"):
                    self.clear_active()
            return
        if name in FORMATTING:
            if self.now.name in TABLE_PARTS:
                self.foster = True
            self.adopt(name)
            self.foster = False
        elif name == "p":
            if not self.in_scope(("p",), {"button"}):
                self.flow_start("p", [], False)
            self.close_p()
        elif name == "br":
            self.flow_start("br", [], False)
        elif name in ("li", "dd", "dt"):
            if self.in_scope((name,), {"ol", "ul"} if name == "li" else frozenset()):
                self.imply(name)
                self.pop_to((name,))
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif name == "form":
            node, self.form = self.form, None if not self.in_template() else self.form
            if node is not None and node in self.stack:
                self.imply()
                self.stack.remove(node)
        elif name in ("select", "optgroup", "option"):
            if name == "option" and self.now.name == "option" or name == "optgroup" and self.now.name == "optgroup":
                self.stack.pop()
            elif name != "option" and self.in_scope((name,)):
                self.pop_to((name,))
        elif name in SPECIAL or name == "dialog":
            if self.in_scope((name,)):
                self.imply()
                self.pop_to((name,))
                if name in ("applet", "marquee", "object"):
                    self.clear_active()
        else:
            self.any_end(name)


def parse(html: str) -> Node:
    """The document of a page."""
    return Builder().feed(html)


def parsed(html: str | Node) -> Node:
    """The document of a page, or the document that is given, to be left as it is."""
    return html if isinstance(html, Node) else parse(html)


def copy_of(node: Node) -> Node:
    """A node of its own with copies of all below it and of template contents."""
    top = Node(node.type, node.name, node.ns, list(node.attrs), node.data)
    stack = [(node, top)]
    while stack:
        n, new = stack.pop()
        for c in n.children:
            child = Node(c.type, c.name, c.ns, list(c.attrs), c.data)
            child.parent = new
            new.children.append(child)
            if c.children or c.content is not None:
                stack.append((c, child))
        if n.content is not None:
            stack.append((n.content, new.content))
    return top


def fresh(html: str | Node) -> Node:
    """The document of a page, or a copy of the document that is given, to be changed."""
    return copy_of(html) if isinstance(html, Node) else parse(html)


def parse_fragment(html: str) -> Node:
    """A fragment, parsed as a template's content."""
    b = Builder(fragment=True)
    b.feed(html)
    return b.doc.children[0].content


def root_of(doc: Node) -> Node:
    return next(c for c in doc.children if c.type == ELEMENT)


def body_of(doc: Node) -> Node | None:
    return next((c for c in root_of(doc).children if c.name == "body"), None)


_RAW_OUT = frozenset("script style xmp iframe noembed noframes plaintext".split())


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace(" ", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def outer_html(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.type == TEXT:
            out.append(n.data if n.parent is not None and n.parent.name in _RAW_OUT and n.parent.ns == HTML else _escaped(n.data))
        elif n.type == COMMENT:
            out.append(f"<!--{n.data}-->")
        elif n.type == ELEMENT:
            out.append("<" + n.name + "".join(f' {a}="' + _escaped(v).replace('"', "&quot;") + '"' for a, v in n.attrs) + ">")
            if not (n.ns == HTML and n.name in VOID):
                stack.append(f"</{n.name}>")
                stack.extend(reversed((n.content or n).children))
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


def inner_html(node: Node) -> str:
    return "".join(outer_html(c) for c in (node.content or node).children)
