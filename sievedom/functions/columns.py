"""Column functions: built-in expressions where they can say it, else Arrow-batched Python."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import css, edits, encoding, policy, transform, uri, urls
from .dom import parse
from .markdown import markdown_to_html as _markdown
from .mime import BY_EXTENSION
from .sanitizer import Config, audit, mode_walker, sanitize, sanitize_mode
from .selectors import compiled


def _apply(f: Callable, kind, *cols: Column, needed: int | None = None) -> Column:
    """Calls ``f`` on each row; a null argument (of the first ``needed``), or a document that can't be read, gives null.

    Equal rows of one Arrow batch are one call, so ``f`` has to say the same of
    the same.  What is the same for all rows (modes, selectors, parts) is checked
    by the functions below when the column is made, so a wrong one fails at once.
    """

    def one(row):
        if any(x is None for x in row[:needed]):
            return None
        try:
            return f(*row)
        except (ValueError, RecursionError, KeyError):
            return None

    def each(series) -> list:
        done = {}
        out = []
        for row in zip(*series, strict=True):
            try:
                made = done.get(row, done)
            except TypeError:  # structs and arrays can't be looked up
                out.append(one(row))
                continue
            if made is done:
                made = done[row] = one(row)
            out.append(made)
        return out

    if isinstance(kind, T.StructType):  # wrapped in an array, so that a row can be null
        @F.pandas_udf(T.ArrayType(kind))
        def wrapped(*series: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else [x] for x in each(series)], dtype=object)

        return F.element_at(wrapped(*cols), 1)

    @F.pandas_udf(kind)
    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series(each(series), dtype=object)

    return batch(*cols)


def _text(f: Callable, *cols: Column) -> Column:
    return _apply(f, T.StringType(), *cols)


def readings(html: Column, **asked: tuple[str, Callable, *tuple[Column, ...]]) -> Column:
    """A struct of what some functions say of a document, which is parsed once for all.

    Each is given as its type, a function of the document and the columns that
    the function takes besides, as those of ``transform`` and ``edits`` that take
    a parsed one: they leave it as it is.  What one can't read, or has a null
    column, is null, as is all of a document that can't be parsed or is null.
    """
    names, kind = list(asked), T.StructType([T.StructField(n, T.DataType.fromDDL(a[0])) for n, a in asked.items()])
    own, cols = {}, []
    for n, (_, f, *more) in asked.items():
        own[n] = f, slice(len(cols), len(cols) + len(more))
        cols += more

    def one(doc, row, f: Callable, at: slice):
        if any(x is None for x in row[at]):
            return None
        try:
            return f(doc, *row[at])
        except (ValueError, RecursionError, KeyError):
            return None

    def every(h: str, *row) -> dict:
        doc = parse(h)
        return {n: one(doc, row, *own[n]) for n in names}

    return _apply(every, kind, html, *cols, needed=1)


def sanitize_html(html: Column, config: Config = Config(), fragment: bool = False) -> Column:
    """The clean document, or with ``fragment`` its body's inner HTML."""
    return _text(lambda h: sanitize(h, config, fragment), html)


def markdown_to_html(text: Column) -> Column:
    """The HTML of Markdown, to be given to ``sanitize_html``."""
    return _text(_markdown, text)


def sanitize_html_mode(html: Column, mode: str | dict, harden: bool = False, css: bool = False) -> Column:
    """In a legacy mode (none, minimum, strict, permissive), or with a dictionary of custom options."""
    if mode != "none":
        mode_walker(mode, harden, css)
    return _text(lambda h: sanitize_mode(h, mode, harden, css), html)


def sanitize_audit(html: Column, config: Config = Config()) -> Column:
    """Array of (action, element, attribute, reason)."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("action", "element", "attribute", "reason")]))
    return _apply(lambda h: [dict(zip(("action", "element", "attribute", "reason"), a, strict=True)) for a in audit(h, config)], kind, html)


def sanitize_style(style: Column, ruleset: str = "default", **options) -> Column:
    """Declarations that stay by a ruleset for functions: default, strict or permissive."""
    rules = css.CssPolicy.of(ruleset, **options)
    return _text(rules.inline, style)


def sanitize_css(sheet: Column, ruleset: str = "default", **options) -> Column:
    rules = css.CssPolicy.of(ruleset, **options)
    return _text(rules.stylesheet, sheet)


_DECLARATION = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("important", T.BooleanType())])
_RULE = T.StructType([T.StructField("rule_no", T.IntegerType()), T.StructField("selector", T.StringType()), T.StructField("inside", T.StringType()), T.StructField("declarations", T.ArrayType(_DECLARATION))])


def css_rules(sheet: Column) -> Column:
    """Array of a stylesheet's rules with their declarations."""
    return _apply(css.rule_rows, T.ArrayType(_RULE), sheet)


def minify_html(html: Column, comments: bool = False, display: bool = False) -> Column:
    return _text(lambda h: transform.minify(h, comments, display), html)


def pretty_html(html: Column) -> Column:
    return _text(transform.pretty, html)


def outer_html(html: Column, selector: str) -> Column:
    compiled(selector)
    return _text(lambda h: transform.outer(h, selector), html)


def inner_html(html: Column, selector: str) -> Column:
    compiled(selector)
    return _text(lambda h: transform.inner(h, selector), html)


def text_content(html: Column, selector: str = "body") -> Column:
    compiled(selector)
    return _text(lambda h: transform.text_content(h, selector), html)


def attribute(html: Column, selector: str, name: str) -> Column:
    compiled(selector)
    return _text(lambda h: transform.attribute(h, selector, name), html)


def select_all(html: Column, selector: str) -> Column:
    compiled(selector)
    return _apply(lambda h: transform.select_all(h, selector), T.ArrayType(T.StringType()), html)


def computed_style(html: Column, selector: str, prop: str) -> Column:
    compiled(selector)
    return _text(lambda h: transform.computed_style(h, selector, prop), html)


def edit_html(html: Column, edit: Callable[[str], str]) -> Column:
    """Any of the editing functions of ``transform``, for example lambda h: transform.remove(h, 'aside')."""
    return _text(edit, html)


_URL = T.StructType([T.StructField(n, T.IntegerType() if n == "port" else T.StringType()) for n in ("scheme", "username", "password", "host", "port", "path", "query", "fragment")])


def parse_url(url: Column, base: Column | None = None) -> Column:
    return _apply(urls.parse_url, _URL, *([url] if base is None else [url, base]))


def url_string(parts: Column) -> Column:
    """The URL of a struct of ``parse_url``."""
    return _text(lambda u: urls.url_string(json.loads(u)), F.to_json(parts, {"ignoreNullFields": "false"}))


def set_url_part(url: Column, part: str, value: Column) -> Column:
    """The URL with its scheme, username, password, host, hostname, port, path, query or fragment set."""
    urls.with_part("http://h/", part, "")
    return _text(lambda u, v: urls.with_part(u, part, v), url, value)


def edit_params(query: Column, action: str, name: Column | None = None, value: Column | None = None) -> Column:
    """A query string after append, set, delete or sort of its parameters."""
    urls.edited_params("", action)
    return _text(lambda q, n, v: urls.edited_params(q, action, n, v), query, F.lit("") if name is None else name, F.lit("") if value is None else value)


def insert_adjacent_html(html: Column, selector: str, where: str, new: Column, mode: str = "strict") -> Column:
    """A fragment, cleaned in a mode, beforebegin, afterbegin, beforeend or afterend of the first match."""
    compiled(selector)
    edits.insert_adjacent("", selector, where, "", mode)
    return _text(lambda h, n: edits.insert_adjacent(h, selector, where, n, mode), html, new)


def set_text(html: Column, selector: str, text: Column) -> Column:
    compiled(selector)
    return _text(lambda h, t: edits.set_text(h, selector, t), html, text)


def replace_text(html: Column, selector: str, text: Column) -> Column:
    compiled(selector)
    return _text(lambda h, t: edits.replace_text(h, selector, t), html, text)


def split_text(html: Column, selector: str, offset: Column) -> Column:
    """Texts of the first match's children after its first text is split; null if it is shorter."""
    compiled(selector)
    return _apply(lambda h, n: edits.split_text(h, selector, int(n)), T.ArrayType(T.StringType()), html, offset)


def replace_child(html: Column, selector: str, new: Column, mode: str = "strict") -> Column:
    compiled(selector)
    return _text(lambda h, n: edits.replace_child(h, selector, n, mode), html, new)


def replace_children(html: Column, selector: str, new: Column, mode: str = "strict") -> Column:
    compiled(selector)
    return _text(lambda h, n: edits.replace_children(h, selector, n, mode), html, new)


def move_before(html: Column, selector: str, other: str | None) -> Column:
    compiled(selector)
    return _text(lambda h: edits.move_before(h, selector, other), html)


def clone_element(html: Column, selector: str, deep: bool = True) -> Column:
    compiled(selector)
    return _text(lambda h: edits.clone(h, selector, deep), html)


def create_element(name: str, text: Column, **attributes: Column) -> Column:
    """An element's HTML, with a text and attributes from columns."""
    keys = list(attributes)
    return _text(lambda t, *v: edits.create_element(name, dict(zip(keys, v, strict=True)), t), text, *attributes.values())


def create_comment(data: Column) -> Column:
    return _text(edits.create_comment, data)


def body_html(html: Column) -> Column:
    return _text(edits.body_html, html)


def set_title(html: Column, title: Column) -> Column:
    return _text(edits.set_title, html, title)


def append_meta(html: Column, name: str, content: Column) -> Column:
    return _text(lambda h, c: edits.append_meta(h, {"name": name, "content": c}), html, content)


def fragment_nodes(html: Column, context: str = "template") -> Column:
    """The HTML of each node of a fragment, parsed in a context element."""
    edits.fragment_nodes("", context)
    return _apply(lambda h: edits.fragment_nodes(h, context), T.ArrayType(T.StringType()), html)


def template_first(html: Column, selector: str = "template") -> Column:
    compiled(selector)
    return _text(lambda h: edits.template_first(h, selector), html)


def is_empty(html: Column, selector: str) -> Column:
    compiled(selector)
    return _apply(lambda h: edits.is_empty(h, selector), T.BooleanType(), html)


def matches(html: Column, selector: str, test: str) -> Column:
    compiled(selector), compiled(test)
    return _apply(lambda h: edits.matches(h, selector, test), T.BooleanType(), html)


def closest(html: Column, selector: str, above: str) -> Column:
    compiled(selector), compiled(above)
    return _text(lambda h: edits.closest(h, selector, above), html)


def filter_matches(html: Column, selector: str, test: str) -> Column:
    compiled(selector), compiled(test)
    return _apply(lambda h: edits.filtered(h, selector, test), T.ArrayType(T.StringType()), html)


def document_position(html: Column, selector: str, other: str) -> Column:
    """Bits of where the first match of ``other`` lies from that of ``selector``."""
    compiled(selector), compiled(other)
    return _apply(lambda h: edits.position(h, selector, other), T.IntegerType(), html)


def names(html: Column, selector: str) -> Column:
    """Tag, qualified name and namespace of the first match."""
    compiled(selector)
    return _apply(lambda h: edits.names(h, selector), T.StructType([T.StructField(n, T.StringType()) for n in ("tag", "qualified", "namespace")]), html)


def landmarks(html: Column) -> Column:
    kind = T.StructType([T.StructField("root", T.StringType()), T.StructField("head", T.BooleanType()), T.StructField("body", T.BooleanType()), T.StructField("title", T.StringType())])
    return _apply(edits.landmarks, kind, html)


def dataset(html: Column, selector: str) -> Column:
    """Map of the first match's data- attributes by camelCase key."""
    compiled(selector)
    return _apply(lambda h: edits.dataset(h, selector), T.MapType(T.StringType(), T.StringType()), html)


def set_data(html: Column, selector: str, key: str, value: Column) -> Column:
    compiled(selector)
    return _text(lambda h, v: edits.set_data(h, selector, key, v), html, value)


def remove_data(html: Column, selector: str, key: str) -> Column:
    compiled(selector)
    return _text(lambda h: edits.set_data(h, selector, key, None), html)


def minify_html_string(html: Column, comments: bool = True, blank_texts: bool = False) -> Column:
    """Without white space between tags, without parsing."""
    return _text(lambda h: edits.minify_string(h, comments, blank_texts), html)


def decode_bytes(data: Column, label: str | None = None) -> Column:
    """Text of bytes by byte order mark, label, meta element, else UTF-8."""
    if label is not None and encoding.lookup(label) is None:
        raise ValueError(f"no encoding: {label}")
    return _text(lambda b: encoding.decode(bytes(b), label), data)


def detect_encoding(data: Column) -> Column:
    return _text(lambda b: encoding.detect(bytes(b)), data)


def validate_uri(value: Column) -> Column:
    return _apply(uri.validate_uri, T.BooleanType(), value)


def css_color(value: Column) -> Column:
    kind = T.StructType([T.StructField(n, T.ShortType()) for n in "rgba"])
    return _apply(lambda s: dict(zip("rgba", uri.css_color(s), strict=True)), kind, value)


# Built-in expressions only.


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalize_text(html: Column) -> Column:
    """White space runs become one space, none between tags, none at the ends."""
    space = r"[ \t\n\r\x0B\f]+"
    return F.trim(F.regexp_replace(F.regexp_replace(html, f">{space}<", "><"), space, " "))


def is_whitespace_only(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\A[ \t\n\r]*\z"))


def is_dangerous_attribute(name: Column) -> Column:
    return name.isin(*sorted(policy.DANGEROUS_ATTRIBUTES)) | F.regexp_like(name, F.lit(r"\Aon[A-Za-z]"))


def is_framework_attribute(name: Column) -> Column:
    out = F.lit(False)
    for p in policy.FRAMEWORK_PREFIXES:
        out = out | F.startswith(name, F.lit(p))
    return out


def is_framework_event(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"\A(?:x-on[:.]|v-on[:.]|hx-on[:-]|phx-(?:click|submit|change|blur|focus|keyup|keydown|window-)|@|\(|on:)"))


def is_clobbering_name(value: Column) -> Column:
    return value.isin(*sorted(policy.CLOBBERING_NAMES))


def has_mxss_pattern(value: Column) -> Column:
    head, out = F.lower(F.substring(value.cast("binary"), 1, 512).cast("string")), F.lit(False)  # bytes, as the walker has it
    for p in policy.MXSS_PATTERNS:
        out = out | F.contains(head, F.lit(p)) | F.contains(value, F.lit(p))
    return out


def is_safe_mime(mime: Column) -> Column:
    low = F.lower(F.trim(mime))
    good = F.lit(False)
    for p in policy.MIME_GOOD:
        good = good | F.startswith(low, F.lit(p))
    return ~low.isin(*sorted(policy.MIME_BAD | policy.MIME_HARD)) & good


def mime_of_extension(name: Column) -> Column:
    """MIME type by a file name's extension; null if it has none that is known."""
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.when(F.contains(name, F.lit(".")), F.try_element_at(table, F.lower(F.substring_index(name, ".", -1))))


def kebab_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "-$1"))


def camel_case(name: Column) -> Column:
    """Letters after hyphens in upper case, without the hyphens."""
    parts = F.filter(F.split(F.regexp_replace(name, r"\A-+", "-"), "-+"), lambda p: p != "")
    head = F.startswith(name, F.lit("-"))
    return F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) & ~head, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647)))), "")


def has_class(value: Column, name: str | Column) -> Column:
    return F.array_contains(class_tokens(value), name)


def replace_class(value: Column, old: str, new: str) -> Column:
    """The class list with a class in another's place; as it is without that one."""
    tokens = class_tokens(value)
    made = F.array_distinct(F.transform(tokens, lambda c: F.when(c == old, F.lit(new)).otherwise(c)))
    return F.array_join(F.when(F.array_contains(tokens, old), made).otherwise(tokens), " ")

def class_tokens(value: Column) -> Column:
    """Distinct classes in order."""
    return F.array_distinct(F.filter(F.split(value, r"[ \t\n\r\f]+"), lambda c: c != ""))


def add_class(value: Column, name: str | Column) -> Column:
    return F.array_join(F.array_union(class_tokens(value), F.array(F.lit(name))), " ")


def remove_class(value: Column, name: str | Column) -> Column:
    return F.array_join(F.array_remove(class_tokens(value), name), " ")


def toggle_class(value: Column, name: str | Column) -> Column:
    return F.when(F.array_contains(class_tokens(value), name), remove_class(value, name)).otherwise(add_class(value, name))


def dataset_attribute(name: Column) -> Column:
    """camelCase name of a dataset entry as its data- attribute."""
    return F.concat(F.lit("data-"), F.lower(F.regexp_replace(name, "([A-Z])", "-$1")))


def query_params(query: Column) -> Column:
    """Ordered name-value pairs of a URL's query; plus signs and escapes decoded."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda c: F.try_url_decode(c)
    return F.transform(
        parts,
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("value"),
        ),
    )


def is_danger_value(value: Column) -> Column:
    """Whether a value holds a script scheme or code that a highlighter marks."""
    low = F.lower(value)
    out = F.lit(False)
    for p in ("javascript:", "vbscript:", "data:text/html", "<script"):
        out = out | F.contains(low, F.lit(p))
    return out


def is_known_attribute(tag: Column, name: Column) -> Column:
    """Whether the specification has the attribute for the element."""
    exact = F.create_map(*[x for t, spec in sorted(policy.SPECS.items()) for x in (F.lit(t), F.array(*[F.lit(n) for n in sorted(spec)]))])
    prefixed = F.lit(False)
    for p, then in policy.PREFIXED.items():
        starts = F.startswith(name, F.lit(p + then))
        prefixed = prefixed | (starts if p in ("aria", "data") else starts & F.array_contains(F.try_element_at(exact, tag), p))
    return F.coalesce(F.array_contains(F.try_element_at(exact, tag), name) | (prefixed & F.try_element_at(exact, tag).isNotNull()), F.lit(False))
