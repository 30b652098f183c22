"""The sanitiser: configuration, and the walk over a document."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from . import policy, uri
from .css import CssPolicy
from .dom import COMMENT, ELEMENT, HTML, Node, body_of, fresh, inner_html, outer_html, parse, root_of


@dataclass(frozen=True)
class Config:
    """What is kept.  ``harden`` (default) enforces the documented policy where a looser reading exists; it only removes more."""

    elements: tuple[dict, ...] | None = None
    removeElements: tuple[str, ...] | None = None  # noqa: N815
    replaceWithChildrenElements: tuple[str, ...] | None = None  # noqa: N815
    attributes: tuple[str, ...] | None = None
    removeAttributes: tuple[str, ...] | None = None  # noqa: N815
    comments: bool = False
    dataAttributes: bool = True  # noqa: N815
    allowCustomElements: bool = True  # noqa: N815
    frameworkAttributes: bool = True  # noqa: N815
    sanitizeDomClobbering: bool = True  # noqa: N815
    sanitizeInlineStyles: bool = True  # noqa: N815
    strictUriValidation: bool = False  # noqa: N815
    bypassSafety: bool = False  # noqa: N815
    customAttrPrefixes: tuple[str, ...] = ()  # noqa: N815
    removeEmbeds: bool = False  # noqa: N815
    harden: bool = True
    reasons: bool = field(default=False, compare=False)

    @classmethod
    def preset(cls, name: str | None) -> Config:
        """strict, default, permissive, trusted, none; without a name a bare configuration; another name warns and is default."""
        presets = {
            None: cls(),
            "none": cls(comments=True, sanitizeDomClobbering=False),
            "default": cls(removeElements=("script", "iframe", "object", "embed")),
            "strict": cls(removeElements=("script", "style", "iframe", "object", "embed"), dataAttributes=False, allowCustomElements=False, frameworkAttributes=False, strictUriValidation=True),
            "permissive": cls(removeElements=("script",), comments=True),
            "trusted": cls(comments=True, bypassSafety=True, sanitizeDomClobbering=False, sanitizeInlineStyles=False),
        }
        if name not in presets:
            warnings.warn(f"unknown preset {name!r}, using default", stacklevel=2)
            name = "default"
        return presets[name]

    @classmethod
    def resolve(cls, preset: str | None = None, patch: str | dict | None = None) -> Config:
        """A preset with the fields of a JSON object that are not null put over it; unknown fields are ignored."""
        base = cls.preset(preset)
        patch = json.loads(patch) if isinstance(patch, str) else patch or {}
        known = {f.name for f in fields(cls)}
        tidy = {k: tuple(v) if isinstance(v, list) else v for k, v in patch.items() if k in known and v is not None}
        replace(cls(), **tidy).validate()
        return replace(base, **tidy)

    def validate(self) -> None:
        """Raises if an allowlist and its blocklist are both there."""
        if self.elements is not None and self.removeElements is not None or self.attributes is not None and self.removeAttributes is not None:
            raise ValueError("an allowlist and a blocklist exclude each other")

    def element_allowed(self, name: str) -> bool:
        """Whether the configuration, without the specification, lets an element stay."""
        if self.elements is not None:
            return self.element(name) is not None
        return self.removeElements is None or name not in self.removeElements

    def attribute_allowed(self, name: str) -> bool:
        """Whether the configuration, without the specification, lets an attribute stay."""
        if not self.bypassSafety and name.startswith(policy.UNSAFE_FRAMEWORK_PREFIXES):
            return False
        if name.startswith("data-") and not self.dataAttributes:
            return False
        if framework_attribute(name) and not self.frameworkAttributes:
            return False
        if self.attributes is not None:
            return name in self.attributes
        return self.removeAttributes is None or name not in self.removeAttributes

    def element(self, name: str) -> dict | None:
        return next((e for e in self.elements or () if e["name"] == name), None)


_URI_ATTRS = {"href", "src", "action", "poster", "data", "cite", "xlink:href", "ping"}
_BAD_NAME = re.compile(r"on[A-Za-z]")
_VALIDATORS: dict[tuple[str, str], Callable[[str], bool]] = {
    ("a", "href"): uri.validate_uri, ("img", "src"): uri.validate_uri, ("iframe", "src"): uri.validate_uri, ("iframe", "sandbox"): uri.validate_sandbox, ("form", "action"): uri.validate_uri,
    ("video", "src"): uri.validate_video_uri, ("video", "poster"): uri.validate_uri, ("audio", "src"): uri.validate_audio_uri, ("source", "src"): uri.validate_uri, ("base", "href"): uri.validate_uri,
    ("track", "src"): uri.validate_uri, ("link", "href"): uri.validate_uri, ("embed", "src"): uri.validate_uri, ("object", "data"): uri.validate_uri, ("script", "src"): uri.validate_uri,
    ("custom", "src"): uri.validate_uri, ("custom", "href"): uri.validate_uri,
} | {(t, a): uri.validate_svg_uri for t in ("svg", "circle", "rect", "path", "line", "text") for a in ("href", "xlink:href")}
_HARD = {("area", "href"): uri.validate_uri, ("a", "ping"): uri.validate_uri, ("img", "srcset"): uri.validate_srcset, ("source", "srcset"): uri.validate_srcset}


def dangerous_attribute(name: str) -> bool:
    return name in policy.DANGEROUS_ATTRIBUTES or bool(_BAD_NAME.match(name))


def mxss(value: str) -> bool:
    head = value.encode()[:512].decode("utf-8", "ignore").lower()
    return any(p in head or p in value for p in policy.MXSS_PATTERNS)


def framework_attribute(name: str) -> bool:
    return name.startswith(policy.FRAMEWORK_PREFIXES)


def framework_event(name: str) -> bool:
    return bool(re.match(r"x-on[:.]|v-on[:.]|hx-on[:-]|phx-(?:click|submit|change|blur|focus|keyup|keydown|window-)|@|\(|on:", name))


def safe_mime(mime: str, harden: bool = True) -> bool:
    mime = mime.strip().lower() if harden else mime
    return mime.lower() not in policy.MIME_BAD and mime.startswith(policy.MIME_GOOD) and not (harden and mime.split(";")[0].strip() in policy.MIME_HARD)


def refresh_ok(content: str) -> bool:
    """Whether a refresh waits 3 seconds to an hour and leads to a safe place."""
    delay, _, where = content.partition(";")
    if not (delay.strip().isascii() and delay.strip().isdigit() and 3 <= int(delay) <= 3600):
        return False
    where = where.split(";")[0].strip()
    return not where.startswith("url=") or uri.validate_uri(where[4:]) and "javascript:" not in where and "data:" not in where


class Walker:
    """Rebuilds a tree from what the configuration keeps; ``audit`` gets (action, node's name, what, why)."""

    def __init__(self, config: Config, css: bool | None = None, remove_styles: bool = False, scripts: bool = False):
        self.c, self.audit, self.remove_styles, self.scripts = config, [], remove_styles, scripts and not config.harden
        self.css = CssPolicy(harden=config.harden, allow_data=not config.strictUriValidation) if (config.sanitizeInlineStyles if css is None else css) else None

    def drop(self, node: Node, why: str) -> list[Node]:
        self.audit.append(("remove", node.name, None, why))
        return []

    def clean(self, root: Node) -> None:
        """Cleans below ``root``; with harden also the root's attributes."""
        if self.c.harden and root.type == ELEMENT:
            root.attrs = self.attributes(root)
        self.children(root, None)

    def children(self, node: Node, context: str | None) -> None:
        """One level at a time on an own stack, so depth is not bounded by Python's."""
        stack = [(node, context)]
        while stack:
            n, ctx = stack.pop()
            if n.content is not None:
                stack.append((n.content, None))
            out: list[Node] = []
            queue = n.children[::-1]
            while queue:
                c = queue.pop()
                if c.type == COMMENT:
                    if self.c.comments:
                        out.append(c)
                    else:
                        self.audit.append(("remove", "#comment", None, "comment"))
                elif c.type != ELEMENT:
                    out.append(c)
                else:
                    kind, inner = self.element(c, ctx)
                    if kind == "keep":
                        out.append(c)
                        stack.append((c, inner))
                    elif kind == "unwrap":
                        self.audit.append(("unwrap", c.name, None, "not allowed"))
                        queue.extend(reversed(c.children))
            for c in out:
                c.parent = n
            n.children = out

    def element(self, e: Node, context: str | None) -> tuple[str, str | None]:
        c, name = self.c, e.name
        inner = name if name in ("svg", "math") else context
        if context == "svg" and e.ns == "svg" and name in ("foreignObject", "desc", "title"):
            inner = context
        if name == "template" and e.ns == HTML:
            e.attrs = self.attributes(e)
            return "keep", None
        known = name in policy.TAGS
        if name == "style":
            if self.remove_styles or c.harden and e.ns != HTML:
                self.drop(e, "style")
                return "drop", None
            text = (self.css or CssPolicy(harden=c.harden)).stylesheet(e.text())
            if not text.strip():
                self.drop(e, "style")
                return "drop", None
            e.children = [Node(3, "#text", data=text)]
            e.attrs = self.attributes(e)
            return "keep", None
        if name == "script" and not self.scripts or c.removeEmbeds and name in ("object", "embed"):
            self.drop(e, "blocked element")
            return "drop", None
        foreign = context in ("svg", "math") and e.ns != HTML
        if not (foreign and not known) and name not in ("html", "head", "body"):
            if c.removeElements is not None and name in c.removeElements:
                self.drop(e, "removeElements")
                return "drop", None
            if c.elements is not None and c.element(name) is None:
                if known:
                    return "unwrap", inner
                self.drop(e, "not in elements")
                return "drop", None
            if c.replaceWithChildrenElements and name in c.replaceWithChildrenElements:
                return "unwrap", inner
        if known and not foreign:
            if not self.gate(e):
                self.drop(e, "unsafe element")
                return "drop", None
        if e.ns == "svg" and (foreign or name == "svg"):
            if name in policy.SVG_DANGEROUS or name not in policy.SVG_ALLOWED:
                self.drop(e, "svg element")
                return "drop", None
            e.attrs = self.svg_attributes(e)
            return "keep", inner
        if e.ns == "math" and (foreign or name == "math"):
            if name in policy.MATHML_DANGEROUS or name not in policy.MATHML_SAFE:
                self.drop(e, "mathml element")
                return "drop", None
            e.attrs = [(n, v) for n, v in e.attrs if not dangerous_attribute(n) and n in policy.MATHML_ATTRIBUTES and (n not in ("mathcolor", "mathbackground") or uri.validate_uri(v)) and not (c.harden and mxss(v))]
            return "keep", inner
        if not known:
            if "-" not in name or not c.allowCustomElements:
                self.drop(e, "unknown element")
                return "drop", None
        e.attrs = self.attributes(e)
        return "keep", inner

    def gate(self, e: Node) -> bool:
        c, name = self.c, e.name
        low = lambda n: (e.get(n) or "").strip().lower()
        if name == "meta":
            return low("http-equiv") not in policy.META_BLOCKED and (e.get("charset") is None or low("charset") == "utf-8")
        if name == "base":
            href = e.get("href")
            if href is None:  # only a target
                return True
            bad = self.c.strictUriValidation or not uri.validate_uri(href) or any(x in href.lower() for x in ("javascript:", "data:", "vbscript:", "file:", "../", "..\\")) or href.startswith("//")
            return not bad and (href.lower().startswith(("http://", "https://")) or href.startswith("/"))
        if name == "iframe":
            box = e.get("sandbox")
            return box is not None and "allow-scripts" not in box and e.get("srcdoc") is None and uri.validate_uri(e.get("src") or "")
        if name in ("object", "embed"):
            url, kind = e.get("data" if name == "object" else "src"), e.get("type")
            if url is None or not url and c.harden:
                return not c.harden and (kind is None or safe_mime(kind, False))
            if not uri.validate_uri(url) or any(x in url.lower() for x in ("javascript:", "data:", "vbscript:", "file:")):
                return False
            if kind is not None and not safe_mime(kind, c.harden):
                return False
            return kind is not None or url.lower().endswith(policy.SAFE_EXTENSIONS)
        return True

    def out(self, e: Node, name: str, why: str) -> bool:
        self.audit.append(("attribute", e.name, name, why))
        return False

    def listed(self, e: Node, name: str) -> bool:
        own = self.c.element(e.name)
        if own and own.get("attributes") is not None:
            return name in own["attributes"]
        if own and own.get("removeAttributes") is not None:
            return name not in own["removeAttributes"]
        if self.c.attributes is not None:
            return name in self.c.attributes
        return self.c.removeAttributes is None or name not in self.c.removeAttributes

    def attributes(self, e: Node) -> list[tuple[str, str]]:
        c, kept = self.c, []
        tag = "custom" if "-" in e.name else e.name
        for name, value in e.attrs:
            if dangerous_attribute(name):
                self.out(e, name, "dangerous name")
                continue
            if mxss(value):
                self.out(e, name, "markup in value")
                continue
            if name == "style":
                if self.remove_styles:
                    self.out(e, name, "style")
                    continue
                if self.css is not None:
                    value = self.css.inline(value)
                    ok = bool(value)
                else:
                    ok = uri.validate_style(value.lower() if c.harden else value)
                if not ok or c.harden and not self.listed(e, name):
                    self.out(e, name, "style")
                elif policy.attribute_spec(tag, name)[0] or self.css is not None:
                    kept.append((name, value))
                continue
            if c.sanitizeDomClobbering and name in ("id", "name") and value in policy.CLOBBERING_NAMES:
                self.out(e, name, "clobbering")
                continue
            custom = any(name.startswith(p) for p in c.customAttrPrefixes)
            if framework_attribute(name) or custom:
                allowed = custom or not c.bypassSafety and (c.frameworkAttributes or not c.harden)
                text = (uri.normalize_uri(value) or "x:") if c.harden else value
                if c.harden and framework_event(name) and not custom and c.frameworkAttributes is False:
                    allowed = False
                if not allowed or text.lower().startswith(("javascript:", "vbscript:", "data:", "file:")) or c.harden and not self.listed(e, name):
                    self.out(e, name, "framework")
                else:
                    kept.append((name, value))
                continue
            there, values = policy.attribute_spec(tag, name)
            if not there:
                self.out(e, name, "not in the specification")
                continue
            if values is not None and value not in values:
                self.out(e, name, "value")
                continue
            check = _VALIDATORS.get((tag, name)) or (_HARD.get((tag, name)) if c.harden else None)
            if check and not check(value) or c.harden and c.strictUriValidation and name in _URI_ATTRS and not uri.validate_strict_uri(value):
                self.out(e, name, "uri")
                continue
            if name == "target" and value == "_blank" and not {"noopener", "noreferrer"} & set((e.get("rel") or "").lower().split()):
                self.out(e, name, "target without rel")
                continue
            if c.harden and not c.dataAttributes and name.startswith("data-"):
                self.out(e, name, "data attribute")
                continue
            if not self.listed(e, name):
                self.out(e, name, "configuration")
                continue
            kept.append((name, value))
        return kept

    def svg_attributes(self, e: Node) -> list[tuple[str, str]]:
        kept = []
        for name, value in e.attrs:
            hard = dangerous_attribute(name) or self.c.harden and (mxss(value) or self.c.sanitizeDomClobbering and name in ("id", "name") and value in policy.CLOBBERING_NAMES)
            if hard:
                self.out(e, name, "dangerous name")
                continue
            if name in ("href", "xlink:href"):
                ok = uri.validate_uri(value) if e.name in ("image", "a") else uri.validate_svg_uri(value)
                if not ok:
                    self.out(e, name, "uri")
                    continue
            if self.c.harden and name == "style":
                value = (self.css or CssPolicy()).inline(value)
                if not value:
                    self.out(e, name, "style")
                    continue
            if self.c.harden and "url(" in value.lower() and not CssPolicy().value_ok(value):
                self.out(e, name, "uri")
                continue
            kept.append((name, value))
        return kept


#: Legacy modes: configuration, whether style elements and attributes go, whether script elements stay.
_MODES = {
    "minimum": (Config(comments=True, sanitizeDomClobbering=False, removeEmbeds=True, harden=False), False, True),
    "strict": (Config(allowCustomElements=False, removeEmbeds=True, strictUriValidation=True, frameworkAttributes=False, harden=False), True, False),
    "permissive": (Config(removeEmbeds=True, harden=False), True, False),
}
MODES = ("none", *_MODES)


def _custom(options: dict) -> tuple[Config, bool, bool]:
    """The ``custom`` mode's options, with what they are without being given."""
    o = {"skip_comments": True, "remove_scripts": True, "remove_styles": True, "strict_uri_validation": True, "allow_custom_elements": False, "allow_framework_attrs": False, "allow_embeds": False, "sanitize_dom_clobbering": True} | options
    config = Config(
        comments=not o["skip_comments"], strictUriValidation=o["strict_uri_validation"], allowCustomElements=o["allow_custom_elements"], frameworkAttributes=o["allow_framework_attrs"],
        removeEmbeds=not o["allow_embeds"], sanitizeDomClobbering=o["sanitize_dom_clobbering"], harden=False,
    )
    return config, o["remove_styles"], not o["remove_scripts"]


def mode_walker(mode: str | dict, harden: bool = True, css: bool = False) -> Walker:
    """The walker of a legacy mode, or of the custom one with some options; ``css`` filters inline styles that stay."""
    if isinstance(mode, str) and mode not in _MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}, not {mode}")
    config, no_styles, scripts = _MODES[mode] if isinstance(mode, str) else _custom(mode)
    if harden:
        config = replace(config, harden=True, sanitizeDomClobbering=True)
    return Walker(config, css or harden, no_styles, scripts)


def clean_part(part: Node, mode: str | dict, harden: bool = True) -> None:
    """Cleans below a node in a legacy mode."""
    if mode != "none":
        mode_walker(mode, harden).clean(part)


def sanitize(html: str | Node, config: Config = Config(), fragment: bool = False) -> str:
    """The clean page from <html> on, or with ``fragment`` the body's inner HTML; a parsed document that is given stays as it is."""
    doc = fresh(html)
    Walker(config).clean(root_of(doc))
    if not fragment:
        return outer_html(root_of(doc))
    body = body_of(doc)
    return inner_html(body) if body is not None else ""


def sanitize_mode(html: str, mode: str | dict, harden: bool = False, css: bool = False) -> str:
    """Body of a page cleaned in a legacy mode: none, minimum, strict or permissive, or a dictionary of custom options.

    ``harden`` only removes more: scripts, clobbering names and what the CSS
    filter refuses in the mode minimum, too.
    """
    doc = parse(html)
    body = body_of(doc)
    if mode != "none":
        mode_walker(mode, harden, css).clean(body)
    return inner_html(body)


def audit(html: str, config: Config = Config()) -> list[tuple[str, str, str | None, str]]:
    """What sanitising a page removes: action, element, attribute, reason."""
    walker = Walker(config)
    walker.clean(root_of(parse(html)))
    return walker.audit
