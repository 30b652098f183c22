"""Registered queries of the HTML engine and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import transform
from ..functions.sanitizer import Config
from ..operators import cascade, selecting, serialising
from ..operators import nodes as N
from ..sources.html import spread
from ..streaming.chunks import assemble
from .ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query, and its DuckDB SQL if SQL can express it."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return run

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "pages").select("page_id", "html"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parse_nodes(_pages(spark, sf_dir))


@query()
def sanitize_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.sanitize_html(F.col("html")).alias("clean"))


@query()
def sanitize_pages_strict(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.sanitize_html(F.col("html"), Config.preset("strict"), fragment=True).alias("clean"))


@query()
def sanitize_pages_mode(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.sanitize_html_mode(F.col("html"), "permissive").alias("clean"))


@query("SELECT count(*) AS n_pages, 0::BIGINT AS n_changed FROM pages")
def sanitize_twice(spark, sf_dir):
    once = _pages(spark, sf_dir).select(C.sanitize_html(F.col("html")).alias("a"))
    return once.select("a", C.sanitize_html(F.col("a")).alias("b")).agg(F.count("*").alias("n_pages"), F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).cast("long").alias("n_changed"))


@query(
    """SELECT page_id, (length(html) - length(replace(html, '<script', ''))) // 7 AS n_scripts, (length(html) - length(replace(html, '<!--', ''))) // 4 AS n_comments
FROM pages WHERE html LIKE '%<script%' OR html LIKE '%<!--%'"""
)
def sanitize_audit(spark, sf_dir):
    gone = _pages(spark, sf_dir).select("page_id", F.explode(C.sanitize_audit(F.col("html"))).alias("x")).where("x.action = 'remove'")
    count = lambda name: F.sum(F.when(F.col("x.element") == name, 1).otherwise(0)).cast("long")
    return gone.groupBy("page_id").agg(count("script").alias("n_scripts"), count("#comment").alias("n_comments")).where("n_scripts + n_comments > 0")


@query()
def minify_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.minify_html(F.col("html")).alias("small"))


@query()
def pretty_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.pretty_html(F.col("html")).alias("pretty"))


_DECODE = "regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query(f"SELECT page_id, {_DECODE.format(chr(40) + 'regexp_extract(html, ' + chr(39) + '<title>([^<]*)' + chr(39) + ', 1)' + chr(41))} AS title FROM pages WHERE html LIKE '%<title>%'")
def page_titles(spark, sf_dir):
    return serialising.text_content(_nodes(spark, sf_dir), F.col("tag") == "title", "title").select(F.col("doc_id").alias("page_id"), "title")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages")
def page_links(spark, sf_dir):
    return N.elements(_nodes(spark, sf_dir), "a").select(F.col("doc_id").alias("page_id"), N.attribute_of("href").alias("href"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages")
def page_comments(spark, sf_dir):
    return _nodes(spark, sf_dir).where("node_type = 8").select(F.col("doc_id").alias("page_id"), F.col("text").alias("comment"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages")
def page_languages(spark, sf_dir):
    return N.elements(_nodes(spark, sf_dir), "html").select(F.col("doc_id").alias("page_id"), N.attribute_of("lang").alias("lang"))


@query()
def tag_census(spark, sf_dir):
    """All tags, those that the parser puts in (html, tbody, b again in each paragraph) too, so SQL over the source can't say it."""
    return N.tag_census(_nodes(spark, sf_dir))


@query(
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages), u AS (SELECT page_id, len(h) AS k, unnest(h) AS href, unnest(range(1, len(h) + 1)) AS child_no FROM l)
SELECT page_id, child_no, href, child_no = 1 AS is_first, child_no = k AS is_last FROM u"""
)
def list_positions(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    items = N.with_siblings(nodes).where("tag = 'li'").select(*N.TREE, "node_id", "child_no", (F.col("node_id") == F.col("first_id")).alias("is_first"), (F.col("node_id") == F.col("last_id")).alias("is_last"))
    links = N.elements(nodes, "a").select(*N.TREE, F.col("parent_id").alias("node_id"), N.attribute_of("href").alias("href"))
    return items.join(links.hint("merge"), [*N.TREE, "node_id"]).select(F.col("doc_id").alias("page_id"), F.col("child_no").cast("long").alias("child_no"), "href", "is_first", "is_last")


@query("SELECT page_id, (length(html) - length(replace(html, '<a href', ''))) // 7 AS n_nav_links FROM pages WHERE html LIKE '%<a href%'")
def links_in_navigation(spark, sf_dir):
    return selecting.select(_nodes(spark, sf_dir), "nav a").groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n_nav_links"))


@query("SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n_paragraphs FROM pages")
def select_paragraphs(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.size(C.select_all(F.col("html"), "article > p")).cast("long").alias("n_paragraphs"))


@query(f"SELECT page_id, {_DECODE.format('regexp_extract(html, ' + chr(39) + '<div class=\"ad\">([^<]*)' + chr(39) + ', 1)')} AS ad FROM pages WHERE html LIKE '%<div class=\"ad\">%'")
def advert_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.text_content(F.col("html"), "div.ad").alias("ad")).where("ad is not null")


@query(
    r"""WITH s AS (SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n, unnest(regexp_extract_all(html, '<style>p\{([a-z]+):([^}]*)\}</style>', 1)) AS name, unnest(regexp_extract_all(html, '<style>p\{([a-z]+):([^}]*)\}</style>', 2)) AS value FROM pages)
SELECT page_id, name, value AS margin, n AS n_elements FROM s WHERE n > 0"""
)
def computed_margin(spark, sf_dir):
    """What the cascade gives all elements of all pages, by property and value."""
    won = cascade.cascaded(_nodes(spark, sf_dir))
    return won.groupBy(F.col("doc_id").alias("page_id"), "name", F.col("value").alias("margin")).agg(F.count("*").alias("n_elements"))


@query()
def remove_adverts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", C.edit_html(F.col("html"), lambda h: transform.remove(h, "div.ad, nav, footer")).alias("html"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages"""
)
def url_parts(spark, sf_dir):
    u = spread(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", C.parse_url(F.col("url")).alias("u"))
    return u.select("page_id", "u.scheme", "u.host", "u.path", "u.query", "u.fragment")


@query(
    r"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages WHERE url LIKE '%?%')
SELECT page_id, split_part(p, '=', 1) AS name, split_part(p, '=', 2) AS value FROM p WHERE p <> ''"""
)
def url_params(spark, sf_dir):
    q = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("q"))
    return q.select("page_id", F.explode(C.query_params(F.col("q"))).alias("x")).select("page_id", "x.name", "x.value")


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM documents""")
def escape_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(C.escape_html(F.col("text"))).alias("escaped"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '>[ \t\n\r\x0B\f]+<', '><', 'g'), '[ \t\n\r\x0B\f]+', ' ', 'g'))) AS normal FROM documents")
def normalize_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(C.normalize_text(F.col("text"))).alias("normal"))


@query("SELECT doc_id, md5(text) AS whole FROM documents WHERE text <> ''")
def assemble_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text <> ''")
    parts = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,700}"), F.lit(0))).alias("seq", "chunk"))
    return assemble(parts).select("doc_id", F.md5("html").alias("whole"))


_NAMES = ("onclick", "on1", "onfoo", "class", "hx-get", "@click", "x-on:click", "v-html", ":if", "data-a", "slot", "formaction", "phx-click", "aria-label", "bind:value", "(click)")


@query(
    "WITH n AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + r"""]) AS name)
SELECT name, regexp_matches(name, '^on[A-Za-z]') OR name IN ('v-html','formaction') AS dangerous, regexp_matches(name, '^(hx-|phx-|x-|v-|@|:|\*ng|\[|\(|bind:|on:|use:|slot)') AS framework,
regexp_matches(name, '^(x-on[:.]|v-on[:.]|hx-on[:-]|phx-(click|submit|change|blur|focus|keyup|keydown|window-)|@|\(|on:)') AS event FROM n"""
)
def attribute_policy(spark, sf_dir):
    n = spark.createDataFrame([(x,) for x in _NAMES], "name string")
    return n.select("name", C.is_dangerous_attribute(F.col("name")).alias("dangerous"), C.is_framework_attribute(F.col("name")).alias("framework"), C.is_framework_event(F.col("name")).alias("event"))


@query(
    """SELECT event_type, 'x ' || event_type AS added, '' AS removed, 'data-' || lower(regexp_replace(event_type, '([A-Z])', '-\\1', 'g')) AS dataset, count(*) AS n
FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def event_classes(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    c = F.col("event_type")
    added = F.array_join(F.array_union(C.class_tokens(F.lit("x x")), C.class_tokens(c)), " ")
    return e.select("event_type", added.alias("added"), C.remove_class(c, c).alias("removed"), C.dataset_attribute(c).alias("dataset"), "n")


@query(
    """SELECT event_type, '<h1>' || event_type || '</h1>' || chr(10) || '<ul>' || chr(10) || '<li><strong>' || event_type || '</strong> &amp; <del>' || count(*) || '</del></li>' || chr(10) || '</ul>' || chr(10) AS html
FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def markdown_reports(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.select("event_type", C.markdown_to_html(F.format_string("# %s\n\n- **%s** & ~~%d~~", "event_type", "event_type", "n")).alias("html"))


@query()
def markdown_documents(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", C.sanitize_html(C.markdown_to_html(F.col("text")), fragment=True).alias("clean"))
