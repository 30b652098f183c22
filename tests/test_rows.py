"""Operators over node rows against the walkers of parsed trees."""

import pytest
from pyspark.sql import functions as F

from sievedom.functions import selectors
from sievedom.functions.dom import parse
from sievedom.operators import nodes as N
from sievedom.operators import selecting

SMALL = "/root/testdata/sf0.001"
#: Pages with the hard cases: nested lists, siblings, templates, foreign elements, raw text, odd white space, deep nesting.
ODD = [
    "<ul class='a b'><li id=x class=' b  c '>1<li>2<ul><li class=b>3</ul><li data-k='v w'>4</ul><ol><li>5</ol>",
    "<div><p>a<p class=q>b</div><div></div><div><!-- c --></div><div> </div><template><div class=q><p>in</p><template><b>deep</b></template></div></template><p>c<b>d<i>e</b>f</i>",
    "<table class=t><tr><td>1<td>2<tr><td colspan=2>3</table><form><input checked><input disabled name=a><input type=TEXT></form>",
    "<svg viewBox='0 0 1 1'><circle r=1 /><foreignObject><p>x</foreignObject></svg><math><mi>x</math><style>p > a{color:red}</style><script>if (a<b) '</p>'</script><pre>\n\n x</pre><textarea>\n<b></textarea>",
    "", "plain & text < here", "<a href='x?a=1&b=2' title='\"q\" <'>l</a><br><img src=x alt=''><xmp><b></xmp><noscript><p>n</noscript>", "<div>" * 300 + "<p class=end>x" + "</div>" * 300,
    "<p lang=en-GB>a</p><p lang=en>b</p><p lang=english>c</p><p LANG=EN>d</p><h1>t</h1><p>e</p><p>f</p><h2></h2>", None,
]


@pytest.fixture(scope="module")
def pages(spark):
    real = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    return real.union(spark.createDataFrame([(10_000 + i, h) for i, h in enumerate(ODD)], "page_id long, html string")).repartition(4)


@pytest.fixture(scope="module")
def nodes(pages):
    return N.parse_nodes(pages).persist()


SELECTORS = [
    "p", "*", "#x", ".b", "li.b.c", "nav li > a", "article > p", "ul > li", "li li", "div p b", "body > div ~ p", "h1 + p", "p + p", "h1 ~ p", "li + li a", "ul ul > li, ol > li", "li:first-child", "li:last-child > a", "li:nth-child(2n+1)",
    "p:nth-of-type(2)", "p:nth-last-child(-n+2)", "p:first-of-type", "td:only-child", "b:only-of-type", "div:empty", ":root", ":root > body", "p:not(.q)", "li:not(ul ul > li)", "div:not(:first-child):not(.ad)", "ul:has(> li > ul)", "div:has(p b)",
    "[data-k]", "[data-k~=w]", "[lang|=en]", "[href^='/t' i]", "[href$='2']", "[title*='q']", "[class='']", "input:checked", "input[type=text i]", ":is(ul, ol) > li:not(:last-child)", "circle", "tr td", "article p:not(:first-of-type) + p",
    "p:nth-last-of-type(1)", "html > head + body > *", "nav ~ article > h1 ~ p:nth-child(odd)",
]


def test_selectors(pages, nodes):
    """All selectors on all pages, in one pass, match what the tree walker matches."""
    names = {f"m{i}": s for i, s in enumerate(SELECTORS) if ":has(>" not in s}
    got = {}
    for r in selecting.matching(nodes.where("tree_id = 0"), names).select("doc_id", "node_id", *names).collect():
        for n in names:
            if r[n]:
                got.setdefault((r.doc_id, n), set()).add(r.node_id)
    for r in pages.collect():
        if r.html is None:
            continue
        doc = parse(r.html)
        at = {id(n): i for i, n in enumerate([doc, *doc.walk()])}
        for n, s in names.items():
            assert got.get((r.page_id, n), set()) == {at[id(e)] for e in selectors.select(doc, s)}, (r.page_id, s)


def test_one_exchange(nodes):
    plan = selecting.matching(nodes, {"a": "nav li > a", "b": "h1 + p", "c": "p:not(article p)", "d": "ul:has(b)"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_index(nodes):
    index = selecting.element_index(nodes).persist()
    for kind, key, s in (("tag", "li", "li"), ("class", "b", ".b"), ("id", "x", "#x"), ("attribute", "data-k", "[data-k]")):
        here = lambda df: sorted(map(tuple, df.where("tree_id = 0").select("doc_id", "node_id").collect()))
        assert here(selecting.find(index, kind, key)) == here(selecting.select(nodes, s)) != []


def test_not_selectors(nodes):
    for s in ("p:contains(x)", "p:hover", "", "p >> "):
        with pytest.raises(ValueError):
            selecting.select(nodes, s)
    assert selecting.select(nodes.where(F.lit(False)), "p").count() == 0


SHEETS = [
    "<style>p{margin:0} .a{color:red} #i{color:blue} div p.a{color:green;width:1px} div > p{height:2px} h1 + p{top:1px} h1 ~ p{left:2px}</style><div><h1>x</h1><p class='a'>1</p><p id=i class='a b' style='color:pink;margin:3px'>2<b>3</b></p></div><p class=b>4</p>",
    "<style>p{margin:0 !important;margin:1px} @media screen{p{color:red}} @media print{p{color:black}} p:hover{color:white} *{top:0} p:first-child{left:1px} p:nth-of-type(2n){left:2px}</style><style>p{color:blue} p:not(.z):not([k]){right:1px} [lang|=en i]{bottom:4px}</style>"
    "<section><p style='margin:9px; color:a !important'>a<p class=z>b<p lang=EN-gb k>c<i>d</i></section>",
    "<style>ul ul > li + li a, li a[href^='/x' i]{color:red} li li li a{color:green} ul > li:last-child > a{width:2px} frob{</style><ul><li><a href='/X'>1</a><ul><li><a>2</a><li><a>3</a><ul><li><a>4</a></ul></ul><li><a href=/y>5</a></ul>",
    "<template><style>p{margin:1px}</style></template><p>x</p>", "<p style=''>x</p>", "", None,
]


def walked_cascade(html):
    """Winning declarations by matching every rule with every element of the tree."""
    from sievedom.functions import css

    doc = parse(html)
    out = {}
    for at, e in enumerate([doc, *doc.walk()]):
        if e.type != 1:
            continue
        found = []
        for no, s in enumerate(x for x in doc.walk() if x.name == "style"):
            for rule in css.rule_rows(s.text()):
                if rule["inside"] not in (None, "@media screen"):
                    continue
                for part in css.split_top(rule["selector"], ","):
                    try:
                        ok = "hover" not in part and selectors.matches(e, part.strip())
                    except ValueError:
                        ok = False
                    if ok:
                        spec = max(selectors.specificity(c) for c in selectors.compiled(part.strip()))
                        found += [(d["important"], False, spec, no, rule["rule_no"], i, d["name"], d["value"]) for i, d in enumerate(rule["declarations"])]
        for i, (n, v) in enumerate(css.declarations(e.get("style") or "")):
            found.append((v.endswith("!important"), True, (0, 0, 0), 0, 0, i, n, v.removesuffix("!important").rstrip()))
        for d in sorted(found):
            out[at, d[6]] = d[7]
    return out


def test_cascade(spark):
    from sievedom.operators import cascade

    real = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    pages = real.union(spark.createDataFrame([(10_000 + i, h) for i, h in enumerate(SHEETS)], "page_id long, html string")).repartition(3).persist()
    got = {}
    for r in cascade.cascaded(N.parse_nodes(pages)).collect():
        assert (r.node_id, r.name) not in got.setdefault(r.doc_id, {})
        got[r.doc_id][r.node_id, r.name] = r.value
    for r in pages.collect():
        if r.html is not None:
            assert got.get(r.page_id, {}) == walked_cascade(r.html), r.page_id
    # what is nearest around a row, as the nearest list around each element
    from sievedom.operators import policing

    nodes = N.parse_nodes(pages)
    near = policing.nearest(nodes, F.col("tag").isin("ul", "div", "section"), F.col("node_id"), "near").where("tree_id = 0")
    found = {(r.doc_id, r.node_id): r.near for r in near.collect()}
    assert len(found) == nodes.where("tree_id = 0").count()
    for r in pages.where("page_id >= 10000 and html is not null").collect():
        doc = parse(r.html)
        at = {id(n): i for i, n in enumerate([doc, *doc.walk()])}
        for n in doc.walk():
            up = n.parent
            while up is not None and up.name not in ("ul", "div", "section"):
                up = up.parent
            assert found[r.page_id, at[id(n)]] == (at[id(up)] if up is not None else None)
    assert cascade.cascaded(N.parse_nodes(pages.where("page_id < 0"))).count() == 0


def test_serialising(pages, nodes):
    """Whole pages, elements and their texts as the tree's own serialiser gives them."""
    from sievedom.functions.dom import inner_html, outer_html, root_of
    from sievedom.operators import serialising

    whole = {r.doc_id: r.html for r in serialising.documents(nodes).collect()}
    wanted = F.col("tag").isin("li", "div", "p", "template", "svg", "pre", "br", "script", "textarea", "body", "title")
    place = lambda df: {(r.doc_id, r.tree_id, r.node_id): r[-1] for r in df.collect()}
    outer, inner, text = place(serialising.outer_html(nodes, wanted)), place(serialising.inner_html(nodes, wanted)), place(serialising.text_content(nodes, wanted))
    n = 0
    for r in pages.collect():
        if r.html is None:
            assert r.page_id not in whole
            continue
        doc = parse(r.html)
        assert whole[r.page_id] == outer_html(doc), r.page_id
        trees = [doc]
        for no, tree in enumerate(trees):
            for at, e in enumerate([tree, *tree.walk()]):
                if e.content is not None:
                    trees.append(e.content)
                if e.type == 1 and e.name in ("li", "div", "p", "template", "svg", "pre", "br", "script", "textarea", "body", "title"):
                    key = (r.page_id, no, at)
                    assert (outer[key], inner[key], text[key]) == (outer_html(e), inner_html(e), e.text())
                    n += 1
        assert whole[r.page_id].endswith("</html>") and root_of(doc)
    assert n == len(outer) == len(inner) == len(text) > 500


MORE = [
    "<svg><style>p{color:red}</style><a href='javascript:x'>k</a><a xlink:href='#f'>l</a><rect style='fill:url(#x);color:red' fill='url(javascript:1)' width=1 onclick=x /><math><mi>x</mi></math><g><title>t<b>u</b></title></g></svg><p>after</p>",
    "<math><mi mathcolor='javascript:x' dir=ltr>a</mi><annotation-xml><svg><circle r=1></svg></annotation-xml><mtext><svg><a href='data:text/html,x'>z</a></svg><p>q</p></mtext></math>",
    "<x-a src='java&#x09;script:1' data-x=1 href=/ok id=n><y>gone<i>too</i></y><b>b</b></x-a><template><script>1</script><p onclick=x id=location>in</p><template><style>p{color:red;behavior:url(x)}</style></template></template>",
    "<a href='&#106;avascript&#58;x' target=_blank rel='NoOpener x'>1</a><a href='&#x110000;&#xD800;/x&nbsp;' target=_blank>2</a><a href='data:image/png;base64,iVBORw0KGgo='>3</a><a href='data:image/png;base64,AAAA'>4</a><a href='DATA:IMAGE/GIF;BASE64,R0lGODlhAQAB'>5</a>",
    "<video src='data:video/mp4,x' poster='data:video/mp4,x'></video><audio src='data:audio/x;y'></audio><img srcset='a.png 1x, javascript:x 2x' src=b><img srcset='a 1x, ,b 2x'><base href='/x/'><base href='//e'><base target=_top><meta http-equiv=' Refresh ' content=1><meta charset=UTF-8><meta charset=x>",
    "<iframe sandbox src=/x></iframe><iframe src=/x></iframe><iframe sandbox=allow-scripts></iframe><object data=/a.pdf></object><object data=/a.pdf type=text/html></object><object data=x type='image/png; x'></object><embed src=/v.mp4><embed src=/v><embed>",
    "<p style='color:red;behavior:x' class='a' hx-get='/x' x-on:click='javascript:1' @click=1 :if=1 slot=s v-model=m contenteditable=maybe dir=RTL dir2 hidden=hidden inert aria-label=x data-y='</style>' lang='" + "é" * 300 + "</script>'>p</p>",
    "<form action='../x' method=get><input name=cookie type=text required=required><select><option selected>1</select><button type=submit formaction=x disabled>b</button></form><!-- c --><noscript><p>x</noscript><frob-x>c</frob-x><frob>d</frob>",
    "<section><article><h2 title='<!--'>x</h2></article></section><style> </style><style>p{color:red}</style><style>@import 'x'; p{x:y}</style><textarea><b></textarea><table><tr><td>1<svg><desc><p>z</desc></svg></table>",
]


def configurations():
    from sievedom.functions.sanitizer import Config

    return {
        "default": Config.preset("default"), "strict": Config.preset("strict"), "permissive": Config.preset("permissive"), "bare": Config(), "none": Config.preset("none"), "trusted": Config.preset("trusted"),
        "lists": Config(elements=({"name": "p", "attributes": ["class", "style"]}, {"name": "a", "removeAttributes": ["target"]}, {"name": "li"}, {"name": "svg"}, {"name": "template"}, {"name": "rect"}), removeAttributes=("lang", "id")),
        "unwrapping": Config(replaceWithChildrenElements=("svg", "ul", "b", "section"), attributes=("href", "src", "class", "hx-get", "width"), comments=True, customAttrPrefixes=("@",), strictUriValidation=True, removeEmbeds=True),
    }


@pytest.mark.parametrize("name", sorted(configurations()))
def test_policy(spark, name):
    """What is left of the rows is what the walker leaves of the pages: attacks, odd pages and real ones."""
    from sievedom.functions.sanitizer import sanitize
    from sievedom.operators import policing, serialising
    from sievedom.plans.attacks import attack_rows

    config = configurations()[name]
    html = [r.html for r in attack_rows(spark).select("html").collect()] + [h for h in ODD if h is not None] + MORE + [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect() if r.html is not None][:20]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").repartition(8)
    nodes = N.parse_nodes(pages).persist()
    got = {r.doc_id: r.html for r in serialising.documents(policing.clean_rows(nodes, config)).collect()}
    wrong = [(h, got.get(i), w) for i, h in enumerate(html) if got.get(i) != (w := sanitize(h, config))]
    assert not wrong, (len(wrong), wrong[:4])


def test_uris(spark):
    from sievedom.functions import uri
    from sievedom.operators import policing

    some = ["", " ", "http://e/", " java\tscript:x", "JAVASCRIPT:x", "&#x6A;avascript:1", "&#00000000000000106;avascript:1", "&#99999999999;x", "&#xFFFFFFF;javascript:", "&nbsp;vbscript:x", "data:,", "data:image/png;base64,iVBORw0KGgoA", "data:image/png;base64,QUJD"]
    some += ["data:image/webp;base64,UklGRgAAAABXRUJQ", "data:image/webp;base64,UklGRgAAAABXRUJR", "data:image/bmp;base64,QQ==", "data:image/bmp;base64,Q Q=", "data:image/bmp;charset=x;base64,QQ==", "data:image/svg+xml;base64,QUJD", "data:image/jpg;base64,/9j/", "data:image/gif;base64", "data:video/mp4,x", "data:audio/x"]
    some += ["//e/x", "../x", "a/../b", "..\\x", "mailto:a", "ftp://e", "x:y", "HTTPS://e", "#a", " #b", "&#35;c", "&amp;#35;c", "é" * 2048, "é" * 2049, "file:///x", "​javascript:1", "　x", "a&#0;b", "&#x1F600;", "\x7fjavascript:x", "1http:x"]
    rows = spark.createDataFrame([(s,) for s in some], "s string")
    v = F.col("s")
    got = rows.select("s", policing.normal_uri(v), policing.uri_ok(v), policing.uri_ok(v, "video"), policing.strict_uri_ok(v), policing.fragment_ok(v), policing.srcset_ok(v)).collect()
    for r in got:
        s = r.s
        assert tuple(r)[1:] == (uri.normalize_uri(s), uri.validate_uri(s), uri.validate_video_uri(s), uri.validate_strict_uri(s), uri.validate_svg_uri(s), uri.validate_srcset(s)), s


SPACED = [
    "<div>a<!-- 1 -->b<b>c</b>d<!-- 2 --><!-- 3 -->e</div>\n<p>\n\t<!-- x -->\n</p> <pre>\n\n <!-- y -->\n</pre><code> <i>\n</i> </code><template>\n<b>\t</b>x<!-- z -->y</template>", "<ul>\n<li>1</li>\n <li>2</li>\t</ul><textarea>\n\n</textarea><!-- end -->",
    "<script>\n</script><style>\n</style><p> </p>",
]


def test_tidying(spark):
    """Merged texts and minified pages as the tree's own functions make them."""
    from sievedom.functions import transform
    from sievedom.functions.sanitizer import Config, Walker, root_of
    from sievedom.operators import policing, serialising, tidying

    html = SPACED + MORE + [h for h in ODD if h]
    nodes = N.parse_nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).persist()
    config = Config.preset("default")
    merged = tidying.merged_texts(policing.clean_rows(nodes, config)).where("node_type = 3").select("doc_id", "tree_id", "node_id", "text").collect()
    got = {}
    for r in sorted(merged):
        got.setdefault((r.doc_id, r.tree_id), []).append(r.text)
    n = 0
    for i, h in enumerate(html):
        doc = parse(h)
        Walker(config).clean(root_of(doc))
        transform.normalize(root_of(doc))
        want = [x.data for x in root_of(doc).walk() if x.type == 3]
        assert got.get((i, 0), []) == want, h
        n += len(want)
    assert n > 50 and "ab" in got[0, 0]
    for comments, display in ((False, False), (True, True)):
        small = {r.doc_id: r.html for r in serialising.documents(tidying.minified(nodes, comments, display)).collect()}
        for i, h in enumerate(html):
            assert small[i] == transform.minify(h, comments, display), h
