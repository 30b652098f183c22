"""The sanitising policy over ``dom_nodes``: each row's own verdict, then what a removed element takes with it.

Verdicts are column expressions on the row, its nearest enclosing SVG or MathML
element and the specification's row for its tag, joined by broadcast.  A removed
element takes what lies in its interval, which is a running maximum in the order
of the document; an unwrapped one only its own row.  What is left can be written
out or searched like any node table.  Only style texts go through Python, by
Arrow batches of their own values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as C
from ..functions import policy
from ..functions.css import CssPolicy
from ..functions.dom import COMMENT, ELEMENT, HTML, TEXT
from ..functions.sanitizer import _HARD, _URI_ATTRS, _VALIDATORS, Config
from ..functions.uri import MAX_URI, _SPACES, validate_audio_uri, validate_sandbox, validate_srcset, validate_svg_uri, validate_uri, validate_video_uri
from . import serialising
from .nodes import TREE
from .selecting import attribute

_REFERENCE = r"&(?:nbsp;|#[xX][0-9a-fA-F]+;|#[0-9]+;)"
_BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def nearest(nodes: DataFrame, kind: Column, payload: Column, name: str) -> DataFrame:
    """Adds ``payload`` of the nearest enclosing row of its tree that ``kind`` holds for, null where there is none.

    How many such rows are open at a place is a running sum over where they
    begin and end; the last that began with one fewer open is the nearest.
    """
    kinds = nodes.withColumn("_kind", F.coalesce(kind, F.lit(False))).withColumn("_load", payload)
    edge = lambda at, end, step: F.struct(at.alias("_at"), F.lit(end).alias("_end"), step.alias("_step"))
    begins = edge(F.col("node_id"), 0, F.col("_kind").cast("int"))
    both = kinds.select("*", F.inline(F.when(F.col("_kind"), F.array(begins, edge(F.col("last_desc"), 1, F.lit(-1)))).otherwise(F.array(begins))))
    running = W.partitionBy(*TREE).orderBy("_at", "_end").rowsBetween(W.unboundedPreceding, -1)
    rows = both.withColumn("_level", F.coalesce(F.sum("_step").over(running), F.lit(0))).where("_end = 0")
    same = W.partitionBy(*TREE, "_on").orderBy("node_id", "_opens").rowsBetween(W.unboundedPreceding, -1)
    role = lambda opens, level: F.struct(F.lit(opens).alias("_opens"), level.alias("_on"))
    own = role(False, F.col("_level"))
    roles = rows.select("*", F.inline(F.when(F.col("_kind"), F.array(own, role(True, F.col("_level") + 1))).otherwise(F.array(own))))
    found = roles.withColumn(name, F.last(F.when(F.col("_opens"), F.col("_load")), ignorenulls=True).over(same))
    found = found.where(~F.col("_opens")).withColumn(name, F.when(F.col("_level") > 0, F.col(name)))
    return found.drop("_kind", "_load", "_at", "_end", "_step", "_level", "_opens", "_on")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` has it: expressions in array functions are not shared otherwise."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normal_uri(value: Column) -> Column:
    """Character references decoded, control characters dropped, white space trimmed; null over MAX_URI bytes."""
    number = lambda r, d: F.when(F.length(d) > 7, F.lit(-1)).otherwise(F.when(F.lower(F.substring(r, 3, 1)) == "x", F.conv(F.concat(F.lit("0"), d), 16, 10)).otherwise(F.concat(F.lit("0"), d)).cast("long"))
    code = lambda r: F.when(r == "&nbsp;", F.lit(160)).otherwise(let(F.regexp_replace(r, r"\A&#[xX]?0*|;\z", ""), lambda d: number(r, d)))
    char = lambda n: F.when((n >= 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(""))
    chars = F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0)), lambda r: let(code(r), char))
    pieces = F.zip_with(F.split(value, _REFERENCE), F.concat(chars, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    decoded = F.when(F.contains(value, F.lit("&")), F.array_join(pieces, "")).otherwise(value)
    space = "".join(f"\\x{{{ord(c):x}}}" for c in _SPACES)
    return F.when(F.octet_length(value) <= MAX_URI, F.regexp_replace(F.regexp_replace(decoded, r"[\x00-\x1f\x7f]", ""), rf"\A[{space}]+|[{space}]+\z", ""))


def _checked_data(text: Column) -> Column:
    """Whether a data URI holds a base64 image whose first bytes agree with its type; (mime;base64),(body) in one pattern."""
    part = lambda i: F.regexp_extract(text, r"(?s)\A.{5}([^;,]*);([^,]*),(.{0,128})", i)
    # fixed values: first bytes of image files
    magic = lambda mime, first: (
        F.when(mime == "image/png", F.startswith(first, F.lit("89504E470D0A1A0A"))).when(mime.isin("image/jpeg", "image/jpg"), F.startswith(first, F.lit("FFD8")))
        .when(mime == "image/gif", F.startswith(first, F.lit("474946383761")) | F.startswith(first, F.lit("474946383961")))
        .when(mime == "image/webp", F.startswith(first, F.lit("52494646")) & (F.substring(first, 17, 8) == "57454250")).otherwise(F.lit(True))
    )
    first = lambda body: F.when(F.regexp_like(body, F.lit(_BASE64)), F.hex(F.unbase64(body)))
    whole = let(part(3), lambda b: first(F.substring(b, F.lit(1), (F.floor(F.length(b) / 4) * 4).cast("int"))))
    good = let(F.lower(part(1)), lambda mime: let(whole, lambda x: F.startswith(mime, F.lit("image/")) & x.isNotNull() & magic(mime, x)))
    return F.coalesce((F.lower(part(2)) == "base64") & good, F.lit(False))


def _begins(text: Column, *some: str) -> Column:
    return reduce(or_, [F.startswith(text, F.lit(s)) for s in some], F.lit(False))


def _normal_ok(text: Column) -> Column:
    """Whether a normal URI is none of a script or file, and no data that is not an image as it says."""
    low = F.lower(F.substring(text, 1, 20))
    data = _begins(low, "data:image/") & ~_begins(low, "data:image/svg")
    return F.coalesce(F.when(F.regexp_like(low, F.lit(r"\A(?:javascript:|vbscript:|file:)")), F.lit(False)).when(_begins(low, "data:"), data & _checked_data(text)).otherwise(text.isNotNull()), F.lit(False))


def _normal_media_ok(text: Column, media: str) -> Column:
    return _normal_ok(text) | F.coalesce(_begins(F.lower(F.substring(text, 1, 20)), f"data:{media}/"), F.lit(False))


def _normal_strict_ok(text: Column) -> Column:
    outside = F.startswith(text, F.lit("//")) | F.contains(text, F.lit("../")) | F.contains(text, F.lit("..\\"))
    scheme = F.lower(F.regexp_extract(text, r"\A([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.coalesce(~outside & scheme.isin("", "http", "https", "mailto", "data"), F.lit(False))


def uri_ok(value: Column, media: str | None = None) -> Column:
    """``validate_uri`` and its audio and video forms, as a column."""
    return let(normal_uri(value), lambda text: _normal_media_ok(text, media) if media else _normal_ok(text))


def strict_uri_ok(value: Column) -> Column:
    return let(normal_uri(value), lambda text: _normal_ok(text) & _normal_strict_ok(text))


def fragment_ok(value: Column) -> Column:
    return F.coalesce(F.startswith(normal_uri(value), F.lit("#")), F.lit(False))


def srcset_ok(value: Column) -> Column:
    first = lambda c: F.regexp_extract(c, r"(?U)\A[\s\x1c-\x1f]*([^\s\x1c-\x1f]*)", 1)
    return F.forall(F.split(value, ","), lambda c: let(first(c), lambda u: (u == "") | uri_ok(u)))


#: What is said of each attribute's value before it is judged: as a URI, and whether it can't stay whatever its name.
_SAID = "array<struct<uri:string,ok:boolean,bad:boolean>>"


def _said() -> Column:
    pattern = "|".join(re.escape(p) for p in policy.MXSS_PATTERNS)
    mxss = lambda v: F.regexp_like(v, F.lit(pattern)) | F.regexp_like(F.lower(F.substring(v.cast("binary"), 1, 512).cast("string")), F.lit(pattern))
    return F.transform("attrs", lambda a: let(normal_uri(a["value"]), lambda u: F.struct(u.alias("uri"), _normal_ok(u).alias("ok"), mxss(a["value"]).alias("bad")))).cast(_SAID)


_CHECKS: dict[Callable, Callable[[Column, Column], Column]] = {
    validate_uri: lambda v, u: u["ok"], validate_audio_uri: lambda v, u: _normal_media_ok(u["uri"], "audio"), validate_video_uri: lambda v, u: _normal_media_ok(u["uri"], "video"),
    validate_svg_uri: lambda v, u: F.coalesce(_begins(u["uri"], "#"), F.lit(False)), validate_srcset: lambda v, u: srcset_ok(v), validate_sandbox: lambda v, u: ~F.contains(v, F.lit("allow-scripts")),
}


def specifications(nodes: DataFrame) -> DataFrame:
    """The policy's tables as a small relation: tag, and its attributes with their allowed values (an empty list: any)."""
    rows = [(tag, {n: sorted(v) if v is not None else None for n, v in spec.items()}) for tag, spec in sorted(policy.SPECS.items())]
    return nodes.sparkSession.createDataFrame(rows, "_spec_tag string, _spec map<string,array<string>>")


def _any_prefix(name: Column, prefixes) -> Column:
    return reduce(or_, [F.startswith(name, F.lit(p)) for p in prefixes], F.lit(False))


def _listed(c: Config, tag: Column, name: Column) -> Column:
    if c.attributes is not None:
        out = name.isin(*c.attributes)
    else:
        out = ~name.isin(*c.removeAttributes) if c.removeAttributes is not None else F.lit(True)
    for e in c.elements or ():
        if e.get("attributes") is not None:
            out = F.when(tag == e["name"], name.isin(*e["attributes"])).otherwise(out)
        elif e.get("removeAttributes") is not None:
            out = F.when(tag == e["name"], ~name.isin(*e["removeAttributes"])).otherwise(out)
    return out


def _specified(name: Column, value: Column) -> Column:
    spec = F.col("_spec")
    values = F.try_element_at(spec, name)
    prefixed = F.lit(False)
    for p, then in policy.PREFIXED.items():
        begins = F.startswith(name, F.lit(p + then))
        prefixed = prefixed | (begins if p in ("aria", "data") else begins & F.map_contains_key(spec, p))
    return F.coalesce(F.when(F.map_contains_key(spec, name), values.isNull() | F.array_contains(values, value)).otherwise(spec.isNotNull() & prefixed), F.lit(False))


def _attribute_ok(c: Config, a: Column, u: Column, inline: Column) -> Column:
    """Whether an HTML element's attribute stays."""
    tag, name, value = F.col("tag"), a["name"], a["value"]
    kind = F.when(F.contains(tag, F.lit("-")), F.lit("custom")).otherwise(tag)
    listed = _listed(c, tag, name)
    custom = _any_prefix(name, c.customAttrPrefixes)
    if c.sanitizeInlineStyles:
        style = F.coalesce(inline != "", F.lit(False)) & listed
    else:
        low = F.lower(value)
        style = ~reduce(or_, [F.contains(low, F.lit(x)) for x in ("expression", "behavior", "url(", "javascript:")]) & listed & _specified(name, value)
    script = F.coalesce(F.regexp_like(F.lower(F.substring(u["uri"], 1, 20)), F.lit(r"\A(?:javascript:|vbscript:|data:|file:)")), F.lit(False))
    framework = (custom | F.lit(not c.bypassSafety and c.frameworkAttributes)) & ~script & listed
    pair = F.concat(kind, F.lit(" "), name)
    checked = F.lit(True)
    validators = _VALIDATORS | {k: v for k, v in _HARD.items() if k not in _VALIDATORS}
    for f in dict.fromkeys(validators.values()):
        pairs = [f"{t} {n}" for (t, n), g in validators.items() if g is f]
        checked = F.when(pair.isin(*pairs), _CHECKS[f](value, u)).otherwise(checked)
    if c.strictUriValidation:
        checked = checked & (~name.isin(*sorted(_URI_ATTRS)) | u["ok"] & _normal_strict_ok(u["uri"]))
    rel = F.split(F.lower(F.coalesce(attribute("rel"), F.lit(""))), r"(?U)[\s\x1c-\x1f]+")
    alone = (name == "target") & (value == "_blank") & ~F.arrays_overlap(rel, F.array(F.lit("noopener"), F.lit("noreferrer")))
    usual = _specified(name, value) & checked & ~alone & listed
    if not c.dataAttributes:
        usual = usual & ~F.startswith(name, F.lit("data-"))
    ok = F.when(C.is_framework_attribute(name) | custom, framework).otherwise(usual)
    if c.sanitizeDomClobbering:
        ok = ~(name.isin("id", "name") & C.is_clobbering_name(value)) & ok
    return ~C.is_dangerous_attribute(name) & ~u["bad"] & F.when(name == "style", style).otherwise(ok)


def _svg_attribute_ok(c: Config, a: Column, u: Column, inline: Column, safe_urls: Column) -> Column:
    name, value = a["name"], a["value"]
    bad = C.is_dangerous_attribute(name) | u["bad"]
    if c.sanitizeDomClobbering:
        bad = bad | name.isin("id", "name") & C.is_clobbering_name(value)
    link = F.when(F.col("tag").isin("image", "a"), u["ok"]).otherwise(F.coalesce(_begins(u["uri"], "#"), F.lit(False)))
    style = F.coalesce(inline != "", F.lit(False))
    url = ~F.contains(F.lower(F.when(name == "style", inline).otherwise(value)), F.lit("url(")) | safe_urls
    return ~bad & F.when(name.isin("href", "xlink:href"), link).otherwise(F.lit(True)) & F.when(name == "style", style).otherwise(F.lit(True)) & url


def _math_attribute_ok(a: Column, u: Column) -> Column:
    name = a["name"]
    colour = F.when(name.isin("mathcolor", "mathbackground"), u["ok"]).otherwise(F.lit(True))
    return ~C.is_dangerous_attribute(name) & name.isin(*sorted(policy.MATHML_ATTRIBUTES)) & colour & ~u["bad"]


def _trimmed(name: str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(attribute(name), F.lit("")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))


def _gate(c: Config) -> Column:
    """Whether an element with a dangerous use is in a harmless one."""
    tag = F.col("tag")
    meta = ~_trimmed("http-equiv").isin(*sorted(policy.META_BLOCKED)) & (attribute("charset").isNull() | (_trimmed("charset") == "utf-8"))
    href = attribute("href")
    low = F.lower(href)
    odd = reduce(or_, [F.contains(low, F.lit(x)) for x in ("javascript:", "data:", "vbscript:", "file:", "../", "..\\")]) | F.startswith(href, F.lit("//"))
    base = href.isNull() | F.lit(not c.strictUriValidation) & F.col("_link_ok") & ~odd & (_any_prefix(low, ("http://", "https://")) | F.startswith(href, F.lit("/")))
    box = attribute("sandbox")
    frame = box.isNotNull() & ~F.contains(box, F.lit("allow-scripts")) & attribute("srcdoc").isNull() & F.coalesce("_link_ok", F.lit(True))
    url, kind = F.when(tag == "object", attribute("data")).otherwise(attribute("src")), attribute("type")
    low = F.lower(url)
    embed = F.coalesce(url != "", F.lit(False)) & F.col("_link_ok") & ~reduce(or_, [F.contains(low, F.lit(x)) for x in ("javascript:", "data:", "vbscript:", "file:")])
    mime = _trimmed("type")
    good = ~mime.isin(*sorted(policy.MIME_BAD)) & _any_prefix(mime, policy.MIME_GOOD) & ~F.rtrim(F.substring_index(mime, ";", 1)).isin(*sorted(policy.MIME_HARD))
    embed = embed & F.when(kind.isNotNull(), good).otherwise(reduce(or_, [F.endswith(low, F.lit(x)) for x in policy.SAFE_EXTENSIONS]))
    out = F.when(tag == "meta", meta).when(tag == "base", base).when(tag == "iframe", frame).when(tag.isin("object", "embed"), embed).otherwise(F.lit(True))
    return F.coalesce(out, F.lit(False))


_SAYS = ["verdict", "reason", "kept_attrs", "kept_text"]


def verdicts(nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds to each row its own verdict: keep, unwrap or remove, its reason, the attributes that stay and, of a style's text, what stays."""
    return _verdicts(nodes, [config]).withColumnsRenamed({f"{x}0": x for x in _SAYS})


def _verdicts(nodes: DataFrame, configs: list[Config]) -> DataFrame:
    """``verdicts`` of several configurations side by side, their columns numbered; rows are dealt, sorted and passed through Python once for all."""
    if not all(c.harden for c in configs):
        raise ValueError("rows are judged by hardened configurations only")
    tag, ns = F.col("tag"), F.col("ns")
    element = F.col("node_type") == ELEMENT
    before = W.partitionBy(*TREE).orderBy("node_id")

    def inner(c: Config) -> Column:
        unwrapped = lambda t: c.elements is not None and c.element(t) is None or bool(c.replaceWithChildrenElements) and t in c.replaceWithChildrenElements
        roots = [t for t in ("svg", "math") if not unwrapped(t)]
        reach = F.max(F.when(element & tag.isin(*roots), F.col("last_desc"))).over(before.rowsBetween(W.unboundedPreceding, -1)) if roots else F.lit(None).cast("int")
        return reach >= F.col("node_id")

    in_sheet = (F.col("node_type") == TEXT) & (F.lag("node_id").over(before) == F.col("parent_id")) & (F.lag("tag").over(before) == "style")
    of_own = element & (tag == "style") & (F.lead("parent_id").over(before) == F.col("node_id")) & (F.lead("node_type").over(before) == TEXT)
    # a sheet's text stands at the text and at its element, one after the other, so that neither needs the other's row later
    sheet = F.when(in_sheet, F.col("text")).when(of_own, F.lead("text").over(before))
    rows = nodes.repartition("doc_id").select("*", *[inner(c).alias(f"_inner{i}") for i, c in enumerate(configs)], sheet.alias("_css"))
    urls = F.when(element & (ns == "svg") & F.exists("attrs", lambda a: F.contains(F.lower(a["value"]), F.lit("url("))), F.transform("attrs", lambda a: F.struct((a["name"] == "style").alias("style"), a["value"].alias("value"))))

    def through_python(c: Config, i: int) -> list[Column]:
        css = CssPolicy(harden=True, allow_data=not c.strictUriValidation)
        of_style, of_sheet = (lambda s: css.inline(s)), (lambda s: (css if c.sanitizeInlineStyles else CssPolicy(harden=True)).stylesheet(s))
        of_svg = of_style if c.sanitizeInlineStyles else CssPolicy().inline
        style = F.when(element if c.sanitizeInlineStyles else element & (ns == "svg"), attribute("style"))
        return [_texts(of_sheet)("_css").alias(f"_clean{i}"), _texts(of_svg)(style).alias(f"_inline{i}"), _safe_values(of_svg)(urls).alias(f"_urls{i}")]

    rows = rows.select("*", *[x for i, c in enumerate(configs) for x in through_python(c, i)])
    link = F.when(tag == "base", attribute("href")).when(tag.isin("iframe", "embed"), attribute("src")).when(tag == "object", attribute("data"))
    rows = rows.withColumn("_said", F.when(element, _said())).withColumn("_link", F.when(element, link)).withColumn("_link_ok", F.when(F.col("_link").isNotNull(), uri_ok(F.col("_link"))))
    small = specifications(nodes)
    rows = rows.join(F.broadcast(small), small["_spec_tag"] == F.when(F.contains(tag, F.lit("-")), F.lit("custom")).otherwise(tag), "left")
    return rows.select(*nodes.columns, *[x for i, c in enumerate(configs) for x in _says(c, i)])


def _says(c: Config, i: int) -> list[Column]:
    """What one of several configurations says of a row: the columns of _SAYS with its number."""
    tag, ns = F.col("tag"), F.col("ns")
    element = F.col("node_type") == ELEMENT
    inline, urls = F.col(f"_inline{i}"), F.col(f"_urls{i}")
    known, inner = tag.isin(*sorted(policy.TAGS)), F.coalesce(f"_inner{i}", F.lit(False))
    foreign = inner & (ns != HTML)
    svg, math = (ns == "svg") & (foreign | (tag == "svg")), (ns == "math") & (foreign | (tag == "math"))
    by_list = ~(foreign & ~known) & ~tag.isin("html", "head", "body")
    verdict = F.when((F.col("tree_id") == 0) & (F.col("depth") == 1), F.when(element, F.lit("keep")).otherwise(F.lit("remove:outside")))
    verdict = verdict.when(F.col("node_type") == COMMENT, F.lit("keep" if c.comments else "remove:comment")).when(~element, F.lit("keep"))
    verdict = verdict.when((tag == "template") & (ns == HTML), F.lit("keep"))
    verdict = verdict.when(tag == "style", F.when((ns == HTML) & F.regexp_like(F.coalesce(F.col(f"_clean{i}"), F.lit("")), F.lit(r"\S")), F.lit("keep")).otherwise(F.lit("remove:style")))
    verdict = verdict.when(tag.isin("script", *(("object", "embed") if c.removeEmbeds else ())), F.lit("remove:blocked element"))
    if c.removeElements is not None:
        verdict = verdict.when(by_list & tag.isin(*c.removeElements), F.lit("remove:removeElements"))
    if c.elements is not None:
        verdict = verdict.when(by_list & ~tag.isin(*[e["name"] for e in c.elements]), F.when(known, F.lit("unwrap:not allowed")).otherwise(F.lit("remove:not in elements")))
    if c.replaceWithChildrenElements:
        verdict = verdict.when(by_list & tag.isin(*c.replaceWithChildrenElements), F.lit("unwrap:not allowed"))
    verdict = verdict.when(known & ~foreign & ~_gate(c), F.lit("remove:unsafe element"))
    verdict = verdict.when(svg, F.when(tag.isin(*sorted(policy.SVG_DANGEROUS)) | ~tag.isin(*sorted(policy.SVG_ALLOWED)), F.lit("remove:svg element")).otherwise(F.lit("keep")))
    verdict = verdict.when(math, F.when(tag.isin(*sorted(policy.MATHML_DANGEROUS)) | ~tag.isin(*sorted(policy.MATHML_SAFE)), F.lit("remove:mathml element")).otherwise(F.lit("keep")))
    verdict = verdict.when(~known & ~(F.contains(tag, F.lit("-")) & F.lit(c.allowCustomElements)), F.lit("remove:unknown element")).otherwise(F.lit("keep"))

    as_svg = svg & (tag != "style")
    said = lambda n: F.get(F.col("_said"), n)
    safe = lambda n: F.coalesce(F.get(urls, n), F.lit(True))
    kept = F.when(as_svg, F.filter("attrs", lambda a, n: _svg_attribute_ok(c, a, said(n), inline, safe(n)))).when(math & (tag != "style"), F.filter("attrs", lambda a, n: _math_attribute_ok(a, said(n)))).otherwise(F.filter("attrs", lambda a, n: _attribute_ok(c, a, said(n), inline)))
    restyled = F.transform(kept, lambda a: F.struct(a["name"].alias("name"), F.when((a["name"] == "style") & inline.isNotNull(), inline).otherwise(a["value"]).alias("value")))
    return [
        F.substring_index(verdict, ":", 1).alias(f"verdict{i}"), F.when(F.contains(verdict, F.lit(":")), F.substring_index(verdict, ":", -1)).alias(f"reason{i}"),
        F.when(element, restyled).alias(f"kept_attrs{i}"), F.coalesce(F.when(~element, F.col(f"_clean{i}")), "text").alias(f"kept_text{i}"),
    ]


def _texts(f: Callable[[str], str]) -> Callable:
    def each(column: pd.Series) -> pd.Series:
        done = {None: None}
        return pd.Series([done[t] if t in done else done.setdefault(t, f(t)) for t in column], dtype=object)

    return F.pandas_udf(each, "string")


def _safe_values(inline: Callable[[str], str]) -> Callable:
    def each(column: pd.Series) -> pd.Series:
        css = CssPolicy()
        value = lambda x: inline(x["value"]) if x["style"] else x["value"]
        return pd.Series([None if v is None else [css.value_ok(value(x) or "") for x in v] for v in column], dtype=object)

    return F.pandas_udf(each, "array<boolean>")


def judged(nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """``verdicts`` with gone: whether the row goes, by itself or with an element around it, a template around its content among them."""
    rows = verdicts(nodes, config)
    before = W.partitionBy("doc_id").orderBy("doc_order").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("verdict") == "remove", F.col("doc_last"))).over(before)
    return rows.withColumn("gone", (F.col("verdict") != "keep") | F.coalesce(reach >= F.col("doc_order"), F.lit(False)))


def clean_rows(nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of ``nodes`` that a configuration keeps, with the attributes and style texts that it keeps.

    They are what the walker keeps of each page; ``serialising.documents`` writes
    them as HTML.  Numbers and intervals are those of the source, so joins with
    it still hold.
    """
    rows = judged(nodes, config).where(~F.col("gone"))
    return rows.select(*[F.col({"attrs": "kept_attrs", "text": "kept_text"}.get(x, x)).alias(x) for x in nodes.columns])


def clean_documents(nodes: DataFrame, configs: dict[str, Config], by: str = "preset", name: str = "html") -> DataFrame:
    """Each document of ``nodes`` as HTML, as each of some named configurations leaves it: doc_id, the configuration's name, html.

    Rows are judged by all of them side by side, so pages are parsed, dealt and
    sorted once.  What a removed element takes with it is seen when its page is
    written, where the rows stand in order anyway.
    """
    rows = _verdicts(nodes, list(configs.values()))
    kept = lambda i: {"attrs": F.col(f"kept_attrs{i}"), "text": F.col(f"kept_text{i}"), "verdict": F.col(f"verdict{i}")}
    return serialising.versions(rows, {n: kept(i) for i, n in enumerate(configs)}, by, name)


def removed(nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """The difference of a tree and what is kept of it: doc_id, tree_id, node_id, tag, attribute (null for a whole node), reason (null where an element around it went)."""
    rows = judged(nodes, config)
    whole = rows.where("gone").select("doc_id", "tree_id", "node_id", "tag", "verdict", F.lit(None).cast("string").alias("attribute"), "reason")
    names = F.array_except(F.transform("attrs", lambda a: a["name"]), F.transform("kept_attrs", lambda a: a["name"]))
    part = rows.where(~F.col("gone") & (F.col("node_type") == ELEMENT)).select("doc_id", "tree_id", "node_id", "tag", F.lit("attribute").alias("verdict"), F.explode(names).alias("attribute"), F.lit("attribute").alias("reason"))
    return whole.unionByName(part)
