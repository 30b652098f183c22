"""Registered queries for changes to documents, URLs, styles, encodings and the policy, over built tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import edits, transform
from ..functions.mime import BY_EXTENSION
from ..functions.sanitizer import Config, sanitize
from ..sources.html import spread
from .attacks import SUITES, attack_rows
from .catalogue import _pages, _table, query

_PAGE = "<html><head></head><body>{}</body></html>"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as small lists: p_partkey, p_name, p_brand, p_type, p_size, html."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    html = F.concat(F.lit('<ul class="list"><li id="a" class="'), "p_type", F.lit('" data-part-size="'), F.col("p_size").cast("string"), F.lit('">'), "p_name", F.lit("</li></ul>"))
    return spread(p.withColumn("html", html))


_LI = """'<li id="a" class="' || p_type || '" data-part-size="' || p_size || '">' || p_name || '</li>'"""
_OPEN, _END = "'<html><head></head><body><ul class=\"list\">'", "'</ul></body></html>'"


@query(
    f"""SELECT p_partkey, {_OPEN} || '<li>' || p_brand || '</li>' || {_LI} || {_END} AS before_it, {_OPEN} || {_LI} || '<li>' || p_brand || '</li>' || {_END} AS after_it,
{_OPEN} || replace({_LI}, '">' || p_name, '"><b>' || p_brand || '</b>' || p_name) || {_END} AS first_in_it, {_OPEN} || replace({_LI}, '</li>', '<b>' || p_brand || '</b></li>') || {_END} AS last_in_it FROM part"""
)
def insert_adjacent(spark, sf_dir):
    """Fragments with handlers and scripts, put in four places and cleaned."""
    li = F.concat(F.lit('<li onclick="x()">'), "p_brand", F.lit("</li><script>1</script>"))
    b = F.concat(F.lit("<b onmouseover=x>"), "p_brand", F.lit("</b>"))
    where = {"before_it": ("beforebegin", li), "after_it": ("afterend", li), "first_in_it": ("afterbegin", b), "last_in_it": ("beforeend", b)}
    put = lambda w: lambda d, new: edits.insert_adjacent(d, "#a", w, new)
    made = C.readings(F.col("html"), **{n: ("string", put(w), new) for n, (w, new) in where.items()})
    return _parts(spark, sf_dir).select("p_partkey", made.alias("r")).select("p_partkey", "r.*")


@query(
    f"""SELECT p_partkey, {_OPEN} || {_LI} || {_LI} || {_END} AS deep, {_OPEN} || {_LI} || replace({_LI}, p_name || '</li>', '</li>') || {_END} AS shallow, {_OPEN} || '<li>' || p_brand || '</li>' || {_END} AS replaced,
{_OPEN} || replace({_LI}, p_name || '</li>', '<i>' || p_brand || '</i></li>') || {_END} AS filled, {_OPEN} || {_END} AS removed,
'<p title="' || p_type || '">' || p_name || ' &lt; &amp;</p>' AS made, '<!--' || p_name || '-->' AS comment FROM part"""
)
def clone_and_replace(spark, sf_dir):
    changed = C.readings(
        F.col("html"),
        deep=("string", lambda d: edits.clone(d, "#a")), shallow=("string", lambda d: edits.clone(d, "#a", False)),
        replaced=("string", lambda d, new: edits.replace_child(d, "#a", new), F.concat(F.lit("<li>"), "p_brand", F.lit("</li>"))),
        filled=("string", lambda d, new: edits.replace_children(d, "#a", new), F.concat(F.lit("<i>"), "p_brand", F.lit("</i>"))), removed=("string", lambda d: transform.remove(d, "#a")),
    )
    p = _parts(spark, sf_dir).select("p_partkey", "p_name", "p_type", changed.alias("r"))
    return p.select("p_partkey", "r.*", C.create_element("p", F.concat("p_name", F.lit(" < &")), title=F.col("p_type")).alias("made"), C.create_comment(F.col("p_name")).alias("comment"))


@query(
    f"""SELECT p_partkey, {_OPEN} || replace({_LI}, '">' || p_name, '">' || p_brand || ' &lt;b&gt; &amp;amp;') || {_END} AS set_text, {_OPEN} || replace({_LI}, '">' || p_name, '">' || p_brand) || {_END} AS replaced,
[left(p_name, 3), substr(p_name, 4)] AS parts, p_name AS content, p_name = '' AS empty FROM part"""
)
def texts(spark, sf_dir):
    seen = C.readings(
        F.col("html"),
        set_text=("string", lambda d, new: edits.set_text(d, "#a", new), F.concat("p_brand", F.lit(" <b> &amp;"))), replaced=("string", lambda d, new: edits.replace_text(d, "#a", new), F.col("p_brand")),
        parts=("array<string>", lambda d: edits.split_text(d, "#a", 3)), content=("string", lambda d: transform.text_content(d, "li")), empty=("boolean", lambda d: edits.is_empty(d, "#a")),
    )
    return _parts(spark, sf_dir).select("p_partkey", seen.alias("r")).select("p_partkey", "r.*")


@query(
    """SELECT p_partkey, '<td>' || p_name || '</td>' AS cell, 2 AS n_cells, '<b>' || p_brand || '</b>' AS in_template, ['<i>' || p_name || '</i>', p_brand] AS nodes, 'html' AS root, p_name AS title,
'<html><head><title>' || p_brand || '</title><meta name="size" content="' || p_size || '"></head><body></body></html>' AS head FROM part"""
)
def fragments(spark, sf_dir):
    p = _parts(spark, sf_dir)
    row = C.fragment_nodes(F.concat(F.lit("<td>"), "p_name", F.lit("<td>"), "p_brand"), "tr")
    page = F.concat(F.lit("<title>"), "p_name", F.lit("</title>"))
    marks = C.readings(page, marks=("struct<root:string,title:string>", edits.landmarks), titled=("string", edits.set_title, F.col("p_brand")))
    return p.withColumn("r", marks).select(
        "p_partkey", row.getItem(0).alias("cell"), F.size(row).alias("n_cells"), C.template_first(F.concat(F.lit("<template> text <b>"), "p_brand", F.lit("</b><i></i></template>"))).alias("in_template"),
        C.fragment_nodes(F.concat(F.lit("<i>"), "p_name", F.lit("</i>"), "p_brand")).alias("nodes"), F.col("r.marks.root").alias("root"), F.col("r.marks.title").alias("title"),
        C.append_meta(F.col("r.titled"), "size", F.col("p_size").cast("string")).alias("head"),
    )


@query(
    f"""SELECT p_partkey, true AS matches, {_OPEN[:-1].replace("<html><head></head><body>", "")}' || {_LI} || '</ul>' AS closest, [{_LI}] AS filtered, 20 AS down, 10 AS up, 0 AS same, 'LI' AS tag,
'http://www.w3.org/1999/xhtml' AS namespace, 'a' AS id, 1::INTEGER AS by_class, 1::INTEGER AS by_attribute, {_LI} AS outer_li, p_name AS inner_li FROM part"""
)
def finding(spark, sf_dir):
    """Matches, ancestors, positions, names and searches by id, class and attribute."""
    seen = C.readings(
        F.col("html"),
        matches=("boolean", lambda d: edits.matches(d, "#a", "ul > li")), closest=("string", lambda d: edits.closest(d, "#a", "ul")), filtered=("array<string>", lambda d: edits.filtered(d, "li", "[id]")),
        down=("int", lambda d: edits.position(d, "ul", "li")), up=("int", lambda d: edits.position(d, "li", "ul")), same=("int", lambda d: edits.position(d, "li", "#a")), names=("struct<tag:string,qualified:string,namespace:string>", lambda d: edits.names(d, "#a")),
        id=("string", lambda d: transform.attribute(d, "li", "id")), by_class=("array<string>", lambda d: transform.select_all(d, ".list")), by_attribute=("array<string>", lambda d: transform.select_all(d, "[data-part-size]")),
        outer_li=("string", lambda d: transform.outer(d, "#a")), inner_li=("string", lambda d: transform.inner(d, "#a")),
    )
    r = _parts(spark, sf_dir).select("p_partkey", seen.alias("r")).select("p_partkey", "r.*")
    return r.select(
        "p_partkey", "matches", "closest", "filtered", "down", "up", "same", F.col("names.tag").alias("tag"), F.col("names.namespace").alias("namespace"), "id",
        F.size("by_class").alias("by_class"), F.size("by_attribute").alias("by_attribute"), "outer_li", "inner_li",
    )


@query(
    f"""SELECT p_partkey, p_size::VARCHAR AS got, {_OPEN} || replace({_LI}, '">' || p_name, '" data-brand-name="' || p_brand || '">' || p_name) || {_END} AS set_new, {_OPEN} || replace({_LI}, ' data-part-size="' || p_size || '"', '') || {_END} AS gone,
'data-part-size' AS attribute, 'part-size' AS kebab, 'partSize' AS camel FROM part"""
)
def dataset(spark, sf_dir):
    changed = C.readings(
        F.col("html"),
        data=("map<string,string>", lambda d: edits.dataset(d, "#a")), set_new=("string", lambda d, v: edits.set_data(d, "#a", "brandName", v), F.col("p_brand")), gone=("string", lambda d: edits.set_data(d, "#a", "partSize", None)),
    )
    return _parts(spark, sf_dir).select("p_partkey", changed.alias("r")).select(
        "p_partkey", F.col("r.data")["partSize"].alias("got"), "r.set_new", "r.gone",
        C.dataset_attribute(F.lit("partSize")).alias("attribute"), C.kebab_case(F.lit("partSize")).alias("kebab"), C.camel_case(F.lit("part-size")).alias("camel"),
    )


@query(
    """SELECT p_partkey, p_type || ' ' || split_part(p_name, ' ', 1) || CASE WHEN split_part(p_name, ' ', 1) = 'new' THEN '' ELSE ' new' END AS added, split_part(p_name, ' ', 1) AS removed,
split_part(p_name, ' ', 1) AS toggled, p_type = 'ECONOMY' AS has, CASE WHEN p_type = 'ECONOMY' THEN 'CHEAP' ELSE p_type END || ' ' || split_part(p_name, ' ', 1) AS replaced FROM part
WHERE p_type <> '' AND split_part(p_name, ' ', 1) NOT IN ('', 'ECONOMY', 'CHEAP', p_type)"""
)
def class_lists(spark, sf_dir):
    """Class attributes with doubles and odd white space."""
    first = F.substring_index("p_name", " ", 1)
    p = _parts(spark, sf_dir).where((F.col("p_type") != "") & ~first.isin("", "ECONOMY", "CHEAP") & (first != F.col("p_type")))
    c = F.concat("p_type", F.lit("\t "), first, F.lit("\n"), F.col("p_type"))
    return p.select("p_partkey", C.add_class(c, "new").alias("added"), C.remove_class(c, F.col("p_type")).alias("removed"), C.toggle_class(c, F.col("p_type")).alias("toggled"), C.has_class(c, "ECONOMY").alias("has"), C.replace_class(c, "ECONOMY", "CHEAP").alias("replaced"))


@query(
    """SELECT s_suppkey, 'https://user:p%40ss@example.com:8443/a/c?q=' || s_suppkey || '#top' AS whole, 'example.com' AS host, 8443::INTEGER AS port, '/a/c' AS path, 'user' AS username, 'p%40ss' AS password,
'http://[2001:db8::1]/x' AS v6, NULL::VARCHAR AS bad_port, NULL::VARCHAR AS bad_host, 'https://h' || s_suppkey || '.example/b?x=1' AS relative, 'https://example.com/n/' || s_suppkey || '?a%20b#f' AS changed,
'http://127.0.0.1/' AS v4, 'http://xn--mnchen-3ya.example/' AS idn FROM supplier"""
)
def url_rules(spark, sf_dir):
    """Credentials, ports, dot segments, IPv6, IPv4, IDNA, refusals, relatives and changes of parts."""
    key = F.col("s_suppkey").cast("string")
    whole = F.concat(F.lit(" HTTPS://user:p@ss@EXAMPLE.com:8443/a/./b/../c?q="), key, F.lit("#top\n"))
    u = C.parse_url(whole)
    changed = C.set_url_part(C.set_url_part(C.set_url_part(C.set_url_part(F.lit("https://example.com:99/x?y"), "port", F.lit("")), "path", F.concat(F.lit("/n/"), key)), "query", F.lit("a b")), "fragment", F.lit("f"))
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", C.url_string(u).alias("whole"), u["host"].alias("host"), u["port"].alias("port"), u["path"].alias("path"), u["username"].alias("username"), u["password"].alias("password"),
        C.url_string(C.parse_url(F.lit("http://[2001:DB8:0:0::1]:80/x"))).alias("v6"), C.url_string(C.parse_url(F.lit("http://h:70000/"))).alias("bad_port"), C.url_string(C.parse_url(F.lit("http://a b/"))).alias("bad_host"),
        C.url_string(C.parse_url(F.lit("../b?x=1"), F.concat(F.lit("https://h"), key, F.lit(".example/a/c#z")))).alias("relative"), changed.alias("changed"),
        C.url_string(C.parse_url(F.lit("http://0x7f.1/"))).alias("v4"), C.url_string(C.parse_url(F.lit("http://münchen.example"))).alias("idn"),
    )


@query(
    """SELECT s_suppkey, 'file:///C:/y' || s_suppkey AS drive, 'file:///D:/n/' || s_suppkey AS rooted, 'file:///' || chr((97 + s_suppkey % 26)::INTEGER) || ':/' || s_suppkey AS other, CASE WHEN s_suppkey % 2 = 0 THEN 'file://host/' || s_suppkey END AS hosted,
CASE s_suppkey % 4 WHEN 0 THEN 'xn--fa-hia' WHEN 1 THEN NULL WHEN 2 THEN 'xn--bcher-kva' ELSE 's' || s_suppkey END AS name FROM supplier"""
)
def url_names(spark, sf_dir):
    """Drives of file URLs, absolute, relative and as hosts; ports that those may not have; names with a sharp s, encoded names that no name gives."""
    n = F.col("s_suppkey")
    key = n.cast("string")
    whole = lambda u, base=None: C.url_string(C.parse_url(u, base))
    name = F.when(n % 4 == 0, F.lit("Faß")).when(n % 4 == 1, F.concat(F.lit("xn--s"), key, F.lit("-"))).when(n % 4 == 2, F.lit("BÜCHER")).otherwise(F.concat(F.lit("S"), key))
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", whole(F.concat(F.lit("file:///C|/x"), key, F.lit("/../y"), key)).alias("drive"), whole(F.concat(F.lit("/n/"), key), F.concat(F.lit("file:///D|/a/"), key)).alias("rooted"),
        whole(F.concat(F.lit("file://"), F.chr((97 + n % 26).cast("int")), F.lit("|/"), key)).alias("other"), whole(F.concat(F.lit("file://host"), F.when(n % 2 == 0, F.lit("/")).otherwise(F.lit(":8/")), key)).alias("hosted"),
        C.parse_url(F.concat(F.lit("http://"), name, F.lit("/")))["host"].alias("name"),
    )


@query(
    """SELECT s_suppkey, 'b=2&a=' || s_suppkey || '&c=x+y%26z' AS appended, 'b=9&a=' || s_suppkey AS changed, 'a=' || s_suppkey AS deleted, 'a=' || s_suppkey || '&b=2' AS sorted FROM supplier"""
)
def url_search(spark, sf_dir):
    q = F.concat(F.lit("?b=2&a="), F.col("s_suppkey").cast("string"))
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", C.edit_params(q, "append", F.lit("c"), F.lit("x y&z")).alias("appended"), C.edit_params(q, "set", F.lit("b"), F.lit("9")).alias("changed"),
        C.edit_params(q, "delete", F.lit("b")).alias("deleted"), C.edit_params(q, "sort").alias("sorted"),
    )


@query(
    """SELECT p_partkey, unnest([0, 1, 1]) AS rule_no, unnest(['p.x', 'li', 'li']) AS selector, unnest([NULL, '@media print', '@media print']) AS inside, unnest(['margin', 'color', 'width']) AS name,
unnest([p_size || 'px', 'red', 'calc(' || p_size || 'px + 1px)']) AS value, unnest([false, true, false]) AS important FROM part"""
)
def css_tables(spark, sf_dir):
    """A row for each declaration of built stylesheets."""
    size = F.col("p_size").cast("string")
    sheet = F.concat(F.lit("@charset 'x'; p.x { margin: "), size, F.lit("px } /* a } b */ @media print { li { color : red !important; width: calc("), size, F.lit("px + 1px) } }"))
    r = _parts(spark, sf_dir).select("p_partkey", F.inline(C.css_rules(sheet)))
    return r.select("p_partkey", "rule_no", "selector", "inside", F.inline("declarations"))


@query(
    """SELECT p_partkey, 'margin: ' || p_size || 'px; width: calc(1px + 2px)' AS usual, 'margin: ' || p_size || 'px' AS strict, 'margin: ' || p_size || 'px; width: calc(1px + 2px); color: var(--c); height: frob(1)' AS permissive,
'p { margin: ' || p_size || 'px }' || chr(10) AS sheet, '<html><head></head><body><p style="margin: ' || p_size || 'px">x</p></body></html>' AS inline, 255::SMALLINT AS red FROM part"""
)
def css_rulesets(spark, sf_dir):
    size = F.col("p_size").cast("string")
    style = F.concat(F.lit("margin: "), size, F.lit("px; width: calc(1px + 2px); color: var(--c); height: frob(1); background: url(javascript:x); behavior: url(x); top: expression(1)"))
    page = F.concat(F.lit('<p style="position: evil(1); margin: '), size, F.lit('px; background: url(https://e/x)">x</p>'))
    return _parts(spark, sf_dir).select(
        "p_partkey", C.sanitize_style(style).alias("usual"), C.sanitize_style(style, "strict").alias("strict"), C.sanitize_style(style, "permissive").alias("permissive"),
        C.sanitize_css(F.concat(F.lit("@import url(x); p { margin: "), size, F.lit("px; behavior: url(x) } a { -moz-binding: url(x) }"))).alias("sheet"),
        C.sanitize_html(page).alias("inline"), C.css_color(F.lit("rgb(255, 0, 0)"))["r"].alias("red"),
    )


@query("SELECT doc_id, md5(text) AS utf8, md5(text) AS utf16, md5(text) AS marked, length(text) AS n_latin FROM documents WHERE text IS NOT NULL AND text <> ''")
def encodings(spark, sf_dir):
    """Texts as bytes in some encodings, read back."""
    t = F.col("text")
    d = _table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    latin = F.encode(F.regexp_replace(t, r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    return d.select(
        "doc_id", F.md5(C.decode_bytes(F.encode(t, "UTF-8"))).alias("utf8"), F.md5(C.decode_bytes(F.encode(t, "UTF-16LE"), "utf-16le")).alias("utf16"),
        F.md5(C.decode_bytes(F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")))).alias("marked"), F.length(C.decode_bytes(latin, "latin1")).cast("long").alias("n_latin"),
    )


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN NULL ELSE 'application/json' END AS mime, p_partkey % 4 = 1 OR p_partkey % 4 = 3 AS safe FROM part"
)
def mime_types(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".HTML", ".png", "", ".tar.json")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    mime = C.mime_of_extension(F.concat(F.lit("file"), ext))
    assert len(BY_EXTENSION) > 70
    return _table(spark, sf_dir, "part").select("p_partkey", mime.alias("mime"), F.coalesce(C.is_safe_mime(mime), F.lit(False)).alias("safe"))


@query("SELECT suite, unnest(['strict', 'minimum, hardened', 'unified', 'unified, not hardened', 'default', 'permissive']) AS mode, n_vectors, 0::BIGINT AS n_breaches, 0::BIGINT AS n_lost FROM (VALUES " + ", ".join(f"('{s}', {n}::BIGINT)" for s, n in SUITES.items()) + ") AS t(suite, n_vectors)")
def attack_vectors(spark, sf_dir):
    """Attacks built by rule, cleaned in some ways; what must not stay and what must."""
    modes = {
        "strict": C.sanitize_html_mode(F.col("html"), "strict"), "minimum, hardened": C.sanitize_html_mode(F.col("html"), "minimum", harden=True),
        "unified": C.sanitize_html(F.col("html"), Config(), True), "unified, not hardened": C.sanitize_html(F.col("html"), Config(harden=False), True),
        "default": C.sanitize_html(F.col("html"), Config.preset("default"), True), "permissive": C.sanitize_html_mode(F.col("html"), "permissive"),
    }
    rows = attack_rows(spark).select("suite", "forbidden", "kept", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), c.alias("clean")) for m, c in modes.items()])))
    low = F.lower("clean")
    breach = F.col("clean").isNull() | F.exists("forbidden", lambda f: F.contains(low, f))
    lost = F.exists("kept", lambda f: ~F.contains(low, f))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("suite", "mode").agg(F.count("*").alias("n_vectors"), count(breach).alias("n_breaches"), count(lost).alias("n_lost"))


_COUNT = "(length(html) - length(replace(html, '{0}', ''))) // length('{0}')"


@query(
    f"""SELECT page_id, preset, 0::BIGINT AS n_scripts, CASE WHEN preset IN ('permissive') THEN {_COUNT.format('<!--')} ELSE 0 END AS n_comments, {_COUNT.format('<p>')} AS n_paragraphs, {_COUNT.format('<a href=')} AS n_links,
{_COUNT.format('<div class="ad">')} AS n_adverts, {_COUNT.format('<li>')} AS n_items FROM pages, (VALUES ('default'), ('strict'), ('permissive')) AS t(preset)"""
)
def sanitize_structure(spark, sf_dir):
    """What is in the pages after cleaning by presets: nothing that is a script, all that is text."""
    presets = ("default", "strict", "permissive")
    under = lambda p: lambda d: sanitize(d, Config.preset(p))
    cleaned = _pages(spark, sf_dir).select("page_id", C.readings(F.col("html"), **{p: ("string", under(p)) for p in presets}).alias("r"))
    rows = cleaned.select("page_id", F.inline(F.array(*[F.struct(F.lit(p).alias("preset"), F.col(f"r.{p}").alias("clean")) for p in presets])))
    n = lambda s: F.floor((F.length("clean") - F.length(F.replace("clean", F.lit(s), F.lit("")))) / len(s))
    return rows.select("page_id", "preset", n("<script").alias("n_scripts"), n("<!--").alias("n_comments"), n("<p>").alias("n_paragraphs"), n("<a href=").alias("n_links"), n('<div class="ad">').alias("n_adverts"), n("<li>").alias("n_items"))


@query(
    """SELECT p_partkey, '<p>' || p_name || '</p><pre> <i> </pre><b>x </b>' AS small, '<html><head></head><body><p>' || p_name || '</p><pre> <i> </i></pre></body></html>' AS parsed, '<p> ' || p_name || ' </p>' AS kept,
'<html>' || chr(10) || '  <head></head>' || chr(10) || '  <body>' || chr(10) || '    <p>' || p_name || '</p>' || chr(10) || '  </body>' || chr(10) || '</html>' AS pretty FROM part"""
)
def minifying(spark, sf_dir):
    s = F.concat(F.lit("<p>"), "p_name", F.lit("</p>\n <!-- c --><pre> <i> </pre>\n <b>x </b>"))
    page = F.concat(F.lit("<p>"), "p_name", F.lit("</p>\n\n<!-- c --><pre> <i> </i></pre>"))
    one = F.concat(F.lit("<p>"), "p_name", F.lit("</p>"))
    return _parts(spark, sf_dir).select(
        "p_partkey", C.minify_html_string(s, comments=False).alias("small"), C.minify_html(page).alias("parsed"), C.minify_html_string(F.concat(F.lit("<p> "), "p_name", F.lit(" </p>"))).alias("kept"), C.pretty_html(one).alias("pretty"),
    )


@query(
    r"""SELECT p_partkey, '<h2>' || p_name || '</h2>' || chr(10) || '<p><em>' || p_brand || '</em> <code>' || p_type || '</code></p>' || chr(10) AS html FROM part"""
)
def markdown_parts(spark, sf_dir):
    md = F.concat(F.lit("## "), "p_name", F.lit("\n\n*"), "p_brand", F.lit("* `"), "p_type", F.lit("`\n"))
    return _parts(spark, sf_dir).select("p_partkey", C.markdown_to_html(md).alias("html"))


@query(
    """SELECT p_partkey, p_size % 2 = 0 AS safe_uri, p_size % 3 = 0 AS known, p_size % 2 = 1 AS danger, p_size % 3 <> 1 AS mxss_free, p_size % 5 = 0 AS clobbers FROM part"""
)
def value_rules(spark, sf_dir):
    """Checks of values: URIs, attributes that the specification has, dangerous values, mutation patterns, clobbering names."""
    size = F.col("p_size")
    link = F.when(size % 2 == 0, F.concat(F.lit("https://e/"), "p_name")).otherwise(F.concat(F.lit(" java\tscript:"), "p_name"))
    attr = F.when(size % 3 == 0, "href").otherwise("formtarget")
    value = F.when(size % 3 == 1, F.concat(F.lit("</STYLE>"), "p_name")).otherwise(F.col("p_name"))
    bad = F.when(size % 2 == 1, F.concat("p_name", F.lit("JavaScript:x"))).otherwise(F.col("p_name"))
    name = F.when(size % 5 == 0, "location").otherwise(F.col("p_name"))
    return _parts(spark, sf_dir).select(
        "p_partkey", C.validate_uri(link).alias("safe_uri"), C.is_known_attribute(F.lit("a"), attr).alias("known"), C.is_danger_value(bad).alias("danger"), (~C.has_mxss_pattern(value)).alias("mxss_free"), C.is_clobbering_name(name).alias("clobbers"),
    )
