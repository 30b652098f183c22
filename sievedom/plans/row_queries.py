"""Registered queries of the operators over node rows: selectors, cascade, serialising, policy; with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sanitizer import Config
from ..operators import cascade, policing, selecting, serialising, tidying
from ..operators import nodes as N
from ..operators.editing import Editing
from ..sources.html import spread
from ..sources.node_source import read_nodes, register_sources
from .catalogue import _nodes, _table, query

_N = "(length(html) - length(replace(html, '{0}', ''))) // length('{0}')"
_SELECTORS = {
    "n_paragraphs": "article > p", "n_links": "nav li > a[href]", "n_first": "li:first-child", "n_others": "li:not(:first-child)", "n_after": "ul > li ~ li", "n_beside": "nav li + li > a", "n_lead": "article > h1 + p",
    "n_later": "article p ~ p", "n_advert": ".ad ~ article > h1", "n_styles": "head > style:not([type])", "n_lists": "nav:has(a) ul", "n_last": "li:nth-last-child(1), title:only-of-type",
}


@query(
    f"""SELECT page_id, {_N.format("<p>")} AS n_paragraphs, {_N.format("<a href=")} AS n_links, ({_N.format("<li>")} > 0)::BIGINT AS n_first, greatest({_N.format("<li>")} - 1, 0) AS n_others, greatest({_N.format("<li>")} - 1, 0) AS n_after,
greatest({_N.format("<li>")} - 1, 0) AS n_beside, {_N.format("</h1><p>")} AS n_lead, greatest({_N.format("<p>")} - 1, 0) AS n_later, (html LIKE '%<div class="ad">%<h1>%')::BIGINT AS n_advert, {_N.format("<style>")} AS n_styles,
(html LIKE '%<a href=%')::BIGINT AS n_lists, (html LIKE '%<li>%')::BIGINT + (html LIKE '%<title>%')::BIGINT AS n_last FROM pages WHERE html IS NOT NULL"""
)
def row_selectors(spark, sf_dir):
    """Twelve selectors on all pages in one pass over their nodes."""
    found = selecting.matching(_nodes(spark, sf_dir), _SELECTORS)
    return found.groupBy(F.col("doc_id").alias("page_id")).agg(*[F.count_if(n).alias(n) for n in _SELECTORS])


@query("""WITH k AS (SELECT 'tag' AS kind, unnest(['nav', 'article', 'footer', 'title']) AS key) SELECT kind, key, count(*) AS n FROM k JOIN pages ON contains(html, '<' || key || '>') GROUP BY ALL
UNION ALL SELECT 'class', 'ad', count(*) FROM pages WHERE contains(html, '<div class="ad">') HAVING count(*) > 0
UNION ALL SELECT 'attribute', 'lang', count(*) FROM pages WHERE contains(html, '<html lang=') HAVING count(*) > 0""")
def element_postings(spark, sf_dir):
    """Sizes of some postings of the index by tag, class and attribute."""
    wanted = F.col("key").isin("nav", "article", "footer", "title", "ad", "lang")
    return selecting.element_index(_nodes(spark, sf_dir)).where(wanted).groupBy("kind", "key").agg(F.count("*").alias("n"))


def _part_pages(spark, sf_dir):
    """Parts as pages with a stylesheet by size: rules by tag, class, id, child and sibling, in a group, and importance."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.col("p_size").cast("string").alias("s"))
    sheet = [
        "li{color:red;width:1px}.k{color:green}#a{width:", "s", "px}ul > li + li{top:", "s", "px}.ECONOMY{color:blue !important}@media print{li{left:0}}@media screen{li.k{bottom:", "s", "px}}li:hover{right:0}body .list li:first-child{height:2px}",
    ]
    css = F.concat(*[F.col(x) if x == "s" else F.lit(x) for x in sheet])
    body = F.concat(F.lit('</style><ul class="list"><li id="a" style="margin: '), "s", F.lit('px; COLOR: pink" class="'), "p_type", F.lit('">'), "p_name", F.lit('</li><li class="k">'), "s", F.lit("</li></ul>"))
    return spread(p.select("p_partkey", F.concat(F.lit("<style>"), css, body).alias("html")))


@query(
    """WITH w AS (
  SELECT p_partkey, 'a' AS element, unnest(['color', 'width', 'margin', 'height']) AS name, unnest([CASE WHEN p_type = 'ECONOMY' THEN 'blue' ELSE 'pink' END, p_size || 'px', p_size || 'px', '2px']) AS value,
    unnest([p_type = 'ECONOMY', false, false, false]) AS important FROM part
  UNION ALL SELECT p_partkey, 'k', unnest(['color', 'width', 'top', 'bottom']), unnest(['green', '1px', p_size || 'px', p_size || 'px']), false FROM part
) SELECT * FROM w"""
)
def part_cascade(spark, sf_dir):
    """The winning declaration of each element and property of built pages."""
    nodes = N.parse_nodes(_part_pages(spark, sf_dir), "p_partkey")
    won = cascade.cascaded(nodes)
    first = F.when(F.row_number().over(W.partitionBy("doc_id").orderBy("node_id")) == 1, "a").otherwise("k")
    named = selecting.select(nodes, "li").select("doc_id", "tree_id", "node_id", first.alias("element"))
    return won.join(named.hint("merge"), ["doc_id", "tree_id", "node_id"]).select(F.col("doc_id").alias("p_partkey"), "element", "name", "value", "important")


@query(
    r"""WITH p AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>'), regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), regexp_extract_all(html, '<h1>[^<]*</h1>'))) AS html FROM pages)
SELECT page_id, substr(html, 2, CASE WHEN html LIKE '<a %' THEN 1 ELSE 2 END) AS tag, md5(regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?|&', '&amp;', 'g')) AS html FROM p"""
)
def row_subtrees(spark, sf_dir):
    """The HTML of all list items, links and headings, written from node rows."""
    part = serialising.outer_html(_nodes(spark, sf_dir), F.col("tag").isin("li", "a", "h1"))
    return part.select(F.col("doc_id").alias("page_id"), "tag", F.md5("html").alias("html"))


@query(
    """SELECT p_partkey, '<html><head></head><body><ul class="list"><li class="' || p_type || '">' || p_name || ' &amp; <b>' || p_brand || '</b><!--c--><br></li></ul><template><i>' || p_size || '</i></template></body></html>' AS html,
'<i>' || p_size || '</i>' AS inside FROM part"""
)
def rows_to_pages(spark, sf_dir):
    """Built pages, templates in them, as rows and as pages again."""
    p = _table(spark, sf_dir, "part")
    html = F.concat(F.lit('<ul class="list"><li class="'), "p_type", F.lit('">'), "p_name", F.lit(" & <b>"), "p_brand", F.lit("</b><!--c--><br></ul><template><i>"), F.col("p_size").cast("string"), F.lit("</i></template>"))
    nodes = N.parse_nodes(spread(p.select("p_partkey", html.alias("html"))), "p_partkey")
    return serialising.inner_html(nodes, F.col("tag") == "template", "inside", page="html").select(F.col("doc_id").alias("p_partkey"), "html", "inside")


def _bad_pages(spark, sf_dir):
    """Parts as pages with what a policy has to decide, by size: links, images, frames, names, handlers, foreign elements, styles, templates."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    n, s = F.col("p_size"), F.col("p_size").cast("string")
    link = F.when(n % 2 == 0, F.concat(F.lit("/n/"), s)).otherwise(F.lit(" java&#115;cript:x"))
    image = F.when(n % 4 == 0, F.lit("data:image/png;base64,iVBORw0KGgo=")).when(n % 4 == 1, F.lit("data:image/png;base64,AAAA")).otherwise(F.lit("/i.png"))
    name = F.when(n % 5 == 0, F.lit("location")).otherwise(F.concat(F.lit("i"), s))
    html = F.concat(
        F.lit('<p title="'), "p_name", F.lit('" onclick="x()" formaction=x style="color: red; behavior: url(x)"><a href="'), link, F.lit('" target=_blank rel='), F.when(n % 3 == 0, F.lit("noopener")).otherwise(F.lit("x")), F.lit('>n</a><img src="'), image,
        F.lit('" alt=i></p><iframe src=/f sandbox'), F.when(n % 2 == 0, F.lit("")).otherwise(F.lit("=allow-scripts")), F.lit("></iframe><div id="), name, F.lit(" data-k=v x-show=a @click=b contenteditable=maybe>t</div>"),
        F.lit('<svg><circle r=1 onclick=x fill="url(#a)" /><animate></animate></svg><math><mi mathcolor=red href=x>m</mi><maction>y</maction></math><x-y title=t>c</x-y><frob>d</frob><meta name=k content=v><meta http-equiv=Refresh content=1>'),
        F.lit("<object data=/a.pdf></object><embed src=/v.swf><style>p { color: red; behavior: url(x) }</style><!-- c --><template><script>1</script><b onclick=x>t</b></template>"),
    )
    return spread(p.select("p_partkey", html.alias("html")))


@query(
    """SELECT p_partkey, preset, '<html><head></head><body><p title="' || p_name || '" style="color: red"><a' || CASE WHEN p_size % 2 = 0 THEN ' href="/n/' || p_size || '"' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' target="_blank" rel="noopener"' ELSE ' rel="x"' END
|| '>n</a><img' || CASE p_size % 4 WHEN 0 THEN ' src="data:image/png;base64,iVBORw0KGgo="' WHEN 1 THEN '' ELSE ' src="/i.png"' END || ' alt="i"></p>' || CASE WHEN p_size % 2 = 0 AND preset = 'permissive' THEN '<iframe src="/f" sandbox=""></iframe>' ELSE '' END
|| '<div' || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' id="i' || p_size || '"' END || CASE WHEN preset = 'permissive' THEN ' data-k="v" x-show="a" @click="b"' ELSE '' END || '>t</div><svg><circle r="1" fill="url(#a)"></circle></svg><math><mi mathcolor="red">m</mi></math>'
|| CASE WHEN preset = 'permissive' THEN '<x-y title="t">c</x-y><meta name="k" content="v"><object data="/a.pdf"></object><style>p { color: red }' || chr(10) || '</style><!-- c -->' ELSE '<meta name="k" content="v"><style>p { color: red }' || chr(10) || '</style>' END
|| '<template><b>t</b></template></body></html>' AS html FROM part, (VALUES ('permissive'), ('strict')) AS t(preset)"""
)
def part_policy(spark, sf_dir):
    """Built pages judged row by row and written again, by two presets."""
    nodes = N.parse_nodes(_bad_pages(spark, sf_dir), "p_partkey")
    cleaned = policing.clean_documents(nodes, {p: Config.preset(p) for p in ("permissive", "strict")})
    return cleaned.select(F.col("doc_id").alias("p_partkey"), "preset", "html")


@query(
    f"""SELECT page_id, {_N.format('<p>')} AS n_paragraphs, {_N.format('<a href=')} AS n_links, {_N.format('<li>')} AS n_items, 0::BIGINT AS n_gone, {_N.format('<style>')} AS n_styles, {_N.format('<meta charset="utf-8">')} AS n_meta FROM pages WHERE html IS NOT NULL"""
)
def row_policy(spark, sf_dir):
    """What a strict policy leaves of the pages' rows."""
    left = policing.clean_rows(_nodes(spark, sf_dir), Config.preset("strict"))
    n = lambda *tags: F.count_if(F.col("tag").isin(*tags))
    return left.groupBy(F.col("doc_id").alias("page_id")).agg(
        n("p").alias("n_paragraphs"), n("a").alias("n_links"), n("li").alias("n_items"), F.count_if(F.coalesce(F.col("tag") == "script", F.lit(False)) | (F.col("node_type") == 8)).alias("n_gone"), n("style").alias("n_styles"), n("meta").alias("n_meta")
    )


@query(
    """WITH r AS (
  SELECT unnest(['removeElements', 'unknown element', 'unsafe element', 'removeElements', 'svg element', 'mathml element', 'comment', 'blocked element', 'removeElements']) AS reason,
    unnest(['iframe', 'frob', 'meta', 'object', 'animate', 'maction', NULL, 'script', 'embed']) AS tag FROM part
) SELECT reason, tag, count(*) AS n FROM r GROUP BY ALL"""
)
def row_audit(spark, sf_dir):
    """What the default policy removes of built pages, by reason: elements and comments that go by themselves."""
    gone = policing.removed(N.parse_nodes(_bad_pages(spark, sf_dir), "p_partkey"), Config.preset("default"))
    return gone.where("attribute is null and verdict = 'remove'").groupBy("reason", "tag").agg(F.count("*").alias("n"))


@query(
    """SELECT attribute, count(*) AS n FROM (
  SELECT unnest(list_filter(['onclick', 'onclick', 'onclick', 'formaction', 'contenteditable', CASE WHEN p_size % 2 = 1 THEN 'href' END, 'href', CASE WHEN p_size % 3 <> 0 THEN 'target' END, CASE WHEN p_size % 4 = 1 THEN 'src' END, CASE WHEN p_size % 5 = 0 THEN 'id' END], lambda x: x IS NOT NULL)) AS attribute FROM part
) GROUP BY attribute"""
)
def row_audit_attributes(spark, sf_dir):
    """Attributes that the default policy takes from elements of built pages that stay."""
    gone = policing.removed(N.parse_nodes(_bad_pages(spark, sf_dir), "p_partkey"), Config.preset("default"))
    return gone.where("attribute is not null").groupBy("attribute").agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey, p_name || ' ' || p_brand AS merged, '<html><head></head><body><p>' || p_name || ' ' || p_brand || '</p><pre> </pre><ul><li>' || p_size || '</li></ul></body></html>' AS small FROM part"""
)
def row_tidying(spark, sf_dir):
    """Texts that lie together once a comment is gone, and pages without blank texts and comments."""
    p = _table(spark, sf_dir, "part")
    html = F.concat(F.lit("<p>"), "p_name", F.lit("<!-- a --> <!-- b -->"), "p_brand", F.lit("</p>\n\t<pre> </pre>\n<ul>\n\n<li>"), F.col("p_size").cast("string"), F.lit("</li>\t</ul>"))
    nodes = N.parse_nodes(spread(p.select("p_partkey", html.alias("html"))), "p_partkey")
    merged = tidying.merged_texts(policing.clean_rows(nodes, Config.preset("default")))
    first = merged.where("node_type = 3").groupBy("doc_id").agg(F.min_by("text", "node_id").alias("merged"))
    small = serialising.documents(tidying.minified(nodes), "small", together=True)
    return first.join(small.hint("merge"), "doc_id").select(F.col("doc_id").alias("p_partkey"), "merged", "small")


@query(
    """SELECT p_partkey, '<html><head></head><body><hr title="' || p_name || '"><article><h1>' || p_name || '</h1><p>' || p_brand || '</p></article><section class="box"><ul><li>' || p_size || '</li><li class="k"><em>' || p_type || ' ' || p_size || '</em></li></ul></section><h1>' || p_name || '</h1><nav class="end"><a href="/x">x</a></nav></body></html>' AS html FROM part"""
)
def part_edits(spark, sf_dir):
    """Built pages edited as rows: put in, moved, wrapped, copied, hollowed, unwrapped and removed, then written again."""
    p = _table(spark, sf_dir, "part")
    html = F.concat(
        F.lit('<nav><a href="/x">x</a></nav><article><h1>'), "p_name", F.lit("</h1><p><b>"), "p_brand", F.lit("</b></p></article><div class=ad><p>buy</p></div><ul><li>"), F.col("p_size").cast("string"), F.lit("</li><li class=k><i>a</i>b</li></ul>"),
    )
    pages = spread(p.select("p_partkey", html.alias("html")))
    size = F.col("_size")
    rows = N.parse_nodes(pages, "p_partkey").join(p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("_name"), F.col("p_type").alias("_type"), F.col("p_size").alias("_size")).hint("merge"), "doc_id")
    tag, classes = F.col("tag"), N.attribute_of("class")
    edited = (
        Editing.of(rows).insert(tag == "article", "beforebegin", '<hr title="{name}">', {"name": F.col("_name")}).move(tag == "nav", tag == "body", "beforeend").set_attribute(tag == "nav", "class", F.lit("end"))
        .wrap(tag == "ul", "section", {"class": "box"}).clone(tag == "h1", tag == "nav", "beforebegin").replace_children(classes == "k", "<em>{type} {size}</em>", {"type": F.col("_type"), "size": size}).unwrap(tag == "b").remove(classes == "ad")
    )
    return serialising.documents(edited.nodes()).select(F.col("doc_id").alias("p_partkey"), "html")


_ONE = "contains(html, '<{0}>')"


@query(
    f"""SELECT page_id, list_aggregate(list_filter([CASE WHEN {_ONE.format('article')} THEN 'aside' END, CASE WHEN {_ONE.format('article')} THEN 'article' END, CASE WHEN {_ONE.format('footer')} THEN 'footer' END, CASE WHEN {_ONE.format('nav')} THEN 'nav' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS body_order,
{_N.format('<h1>')} + ({_ONE.format('article')} AND {_ONE.format('h1')} AND {_ONE.format('footer')})::BIGINT AS n_headings, {_N.format('<a href=')} AS n_links, 'note ' || page_id AS note FROM pages WHERE html IS NOT NULL"""
)
def page_edits(spark, sf_dir):
    """All pages with a note before the article, the navigation behind the footer, the heading again in the footer and no advert: what their bodies hold then."""
    tag = F.col("tag")
    edited = (
        Editing.of(_nodes(spark, sf_dir)).insert(tag == "article", "beforebegin", "<aside>note {page}</aside>", {"page": F.col("doc_id")}).move(tag == "nav", tag == "footer", "afterend").clone(tag == "h1", tag == "footer", "beforeend")
        .remove(N.attribute_of("class") == "ad").nodes()
    )
    in_body = F.when((F.col("depth") == 3) & (F.col("node_type") == 1) & tag.isin("aside", "article", "footer", "nav"), F.struct("node_id", "tag"))
    note = F.lag("tag").over(W.partitionBy("doc_id", "tree_id").orderBy("node_id")) == "aside"
    return edited.withColumn("_note", F.when(note, F.col("text"))).groupBy(F.col("doc_id").alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(in_body)), lambda r: r["tag"]), ",").alias("body_order"), F.count_if(tag == "h1").alias("n_headings"), F.count_if(tag == "a").alias("n_links"), F.max("_note").alias("note")
    )


_COUNTED = ("a", "article", "div", "h1", "li", "nav", "p", "title", "ul")


@query(
    f"""WITH k AS (SELECT unnest({list(_COUNTED)}) AS tag), c AS (SELECT tag, page_id, (length(html) - length(replace(html, '<' || tag || '>', ''))) // (length(tag) + 2) + (length(html) - length(replace(html, '<' || tag || ' ', ''))) // (length(tag) + 2) AS n FROM pages CROSS JOIN k WHERE html IS NOT NULL)
SELECT tag, sum(n)::BIGINT AS n, count(*) AS n_docs FROM c WHERE n > 0 GROUP BY tag"""
)
def source_census(spark, sf_dir):
    """How often some elements occur, read through the node source: two columns and a condition that goes into the scan."""
    register_sources(spark)
    found = read_nodes(spark, f"{sf_dir}/pages.parquet", ["doc_id", "tag"]).where(F.col("tag").isin(*_COUNTED))
    return found.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
