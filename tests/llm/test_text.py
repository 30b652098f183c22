"""Personal data, page text and the pipeline."""

import hashlib
import html
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from sievedom.llm import html_main, pii

from . import cases

TEXTS = [
    "mail a.b@c.de, x@y z@@q.org +1 (743) 555-3824 and 4111 1111 1111 1111", "1.2.3.4 999.1.1.1 1.2.3.4.5.6 01.002.3.0004", "", None, "é@é.fr a@b.c@d.e", "9" * 20000, "a" * 20000 + "@b.c",
    "+123456789 +1-2 ++12345678901 4111-1111-1111-1112", "call id 123-45-6789 now",
]


def brute(text):
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((0, m.start(), m.end()))
    if len(text) < 15000:
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(x) <= 255 for x in m[0].split(".")):
                spans.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            spans.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((3, m.start(), m.end()))
    said = ",".join(f"{pii.KINDS[k]}:{i}:{j}" for k, i, j in sorted(spans))
    return *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), said


@pytest.mark.parametrize("kind", ["cases", "documents"])
def test_pii(spark, kind):
    docs = cases.frame(spark, TEXTS) if kind == "cases" else spark.read.parquet(f"{cases.SMALL}/documents.parquet")
    got = pii.find_pii(docs).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(brute(r.text))
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == Counter((d, *b[:5]) for d, v in want.items() for b in v)
    for r in got:
        assert any(r.spans.startswith(b[5]) for b in want[r.doc_id])


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please call phone: +1 (743) 555-{3000 + i} today") for i in range(20)] + [(50, "please call phone: 7435553999 today"), (51, "rows 1234567 of it")]
    rows += [(100 + i, f"your card 4{i:03d}{'0' * 12} here") for i in range(200) if pii.luhn(f"4{i:03d}{'0' * 12}")] + [(999, "your card 4999000000000001 here")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999] == "id:10:26" and got[51] == ""


def test_patterns_find_other_outlines(spark):
    """What only the word before or after tells, and what has several pieces."""
    rows = [(i, f"please call phone: +1 (743) 555-{3000 + i} today") for i in range(20)]
    rows += [(50, "please call phone: 7435553999 today"), (51, "rows 1234567 of it"), (52, "please call phone: (743) 555-3824 today"), (53, "the phone:743 555 3825, and 5 times")]
    cards = [f"4{i:03d} 0000 0000 0000" for i in range(200)]
    rows += [(100 + i, f"your card {c} here") for i, c in enumerate(cards) if pii.luhn(c.replace(" ", ""))]
    rows += [(999, "your card 4999 0000 0000 0001 here"), (1000, "my card 4998 0000 0000 0001 5 times")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {50: "7435553999", 52: "(743) 555-3824", 53: "743 555 3825", 999: "4999 0000 0000 0001", 1000: "4998 0000 0000 0001"}
    texts = dict(rows)
    assert {i: got[i].spans for i in want} == {i: f"id:{texts[i].index(v)}:{texts[i].index(v) + len(v)}" for i, v in want.items()}
    assert got[51].spans == "" and all(got[i].n_id == 1 for i in want)


def test_runs():
    of = lambda t: [t[i:j] for i, j in pii.runs(t)]
    assert of("x (743 555) 12") == ["(743 555)", "(743 555) 12", "555) 12"] and of("a1 2 3 4 5 6 7b") == ["2 3 4 5 6"]
    assert of("") == of("1 2 3") == of("9" * 30) == [] and max(len(x.replace(" ", "")) for x in of("1 " * 5000)) == pii.MOST


def article_brute(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not m:
        return ""
    body = re.sub(r"<[^<>]*\Z", "", m[1]) if m.end() == len(page) else m[1]
    out = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br>" in b else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in out if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages(sf):
    t = pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pydict()
    wrong = [i for i, h in zip(t["page_id"], t["html"], strict=True) if html_main.main_text(h) != article_brute(h)]
    assert not wrong


def test_hard_pages():
    prose = "It was a long day, and the road went on. Nobody came, so we waited. "
    page = (
        "<header><h1>Site</h1></header><div id=sidebar><p>" + prose + "</p></div><div class='cookie-notice'>We use cookies, you know.</div>"
        "<div class=content><h2>Title &amp; more</h2><p>" + prose * 3 + "<p class=ad>Buy, buy, buy.</p><p>One\n  two<br>three " + prose + "</p><ul><li>first<li>second</ul></div>"
        "<section id=comments><p>" + prose + "</p></section><form><p>Name</p></form><script>var a = '<p>no</p>'</script><footer>" + prose + "</footer>"
    )
    want = ["Title & more", (prose * 3).strip(), "One two three " + prose.strip(), "first", "second"]
    assert html_main.main_text(page) == "\n".join(want)
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<nav>a</nav>") == html_main.main_text("<p") == ""
    assert html_main.main_text("plain &lt; text") == "plain < text"
    assert html_main.main_text("<p>" + "x, " * 40000) == ("x, " * 40000).strip()
    assert isinstance(html_main.main_text("<div a='" * 2000), str)


def test_marks_round_the_article():
    prose = "It was a long day, and the road went on. Nobody came, so we waited. "
    for mark in ("layout with-sidebar", "no-sidebar", "comments-open", "post type-post tag-news", "elementor-widget elementor-widget-theme-post-content"):
        page = f"<body><div class='{mark}'><div class=sidebar><p>Other, and more.</p></div><div><h1>Title</h1><p>{prose * 3}</p><p>{prose}</p></div></div><p>Foot.</p></body>"
        assert html_main.main_text(page) == "\n".join(["Title", (prose * 3).strip(), prose.strip()])
    posts = "".join(f"<div class='post tag-{i}'><p>{prose}{i}.</p></div>" for i in range(4))
    assert html_main.main_text(f"<body>{posts}</body>") == "\n".join(f"{prose}{i}." for i in range(4))
    page = f"<body><main><article><h1>Title</h1><p>{prose}</p></article><div id=comments>" + f"<article class=comment><p>{prose}</p></article>" * 5 + "</div></main></body>"
    assert html_main.main_text(page) == f"Title\n{prose.strip()}"


def test_links_in_the_article():
    prose = "It was a long day, and the road went on. Nobody came, so we waited. "
    page = (
        f"<body><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul><article><h1><a href=/t>Title</a></h1><p>{prose * 3}</p><h2><a href='#x'>Section</a></h2><ul><li>One<li><a href=/c>Two</a></ul>"
        f"<p>{prose}</p><p><a href=/s>Source</a></p><ol><li><a href=/1>First source</a><li><a href=/2>Second source</a></ol></article><ul><li><a href=/d>More</a><li><a href=/e>Terms</a></ul></body>"
    )
    want = ["Title", (prose * 3).strip(), "Section", "One", "Two", prose.strip(), "Source", "First source", "Second source"]
    assert html_main.main_text(page) == "\n".join(want)
    for name in ("div", "body"):
        assert html_main.main_text(page.replace("article>", f"{name}>") if name == "div" else page.replace("<article>", "").replace("</article>", "")).split("\n")[:7] == want[:7]


LONG = "The small river runs past seven old mills, and nobody has counted how many boats were tied there since the bridge was closed. "


def test_ratios_decide(monkeypatch):
    """A page of nameless divs: menus, the article, a list of other stories."""
    story = "".join(f"<p>{LONG * 2}Part {i}.</p>" for i in range(6))
    cloud = "".join(f"<div>Item number {i}</div>" for i in range(150))  # more text than the article has, in small pieces
    page = f"<body><div><div>Home</div><div>About us</div><div>Contact</div>{cloud}</div><div>{story}</div><div><div>More stories</div><div>Weather</div><div>Copyright</div></div>"
    want = "\n".join(f"{LONG * 2}Part {i}." for i in range(6))
    assert html_main.main_text(page) == want
    flat = f"<body><div>Home</div><div>About us</div><h2>The mills</h2>{story}<div>Weather</div><div>Copyright"
    assert html_main.main_text(flat) == "The mills\n" + want
    monkeypatch.setattr(html_main, "fused", lambda found: [1.0] * len(found))
    assert html_main.main_text(page) != want and html_main.main_text(flat) != "The mills\n" + want


def test_misleading_names():
    """Names of other things round the article, in it, and on inline elements; the text of forms that hold the page."""
    story = "".join(f"<p>{LONG}Part {i}.</p>" for i in range(5))
    want = "\n".join(f"{LONG}Part {i}." for i in range(5))
    for wrap in ('<div class="post side-project">{}</div>', '<div class="search-result">{}</div>', '<div class="tags-share-wrapper content">{}</div>', '<div id="side">{}</div>', "<form id=aspnet>{}</form>", '<section class="comments-open">{}</section>'):
        inner = f"<article>{story}</article>"
        assert html_main.main_text(wrap.format(inner)) == want
        assert html_main.main_text("<nav><a href=/>Home</a></nav>" + wrap.format(inner) + "<footer>Copyright 2020 by us.</footer>") == want
        assert html_main.main_text("<nav><a href=/>Home</a></nav>" + wrap.format(story) + "<footer>Copyright 2020 by us.</footer>") == want
    assert html_main.main_text(f"<article>{story}<span class=ad>Buy now</span><span hidden>unseen</span></article>") == want
    comments = "".join(f"<p>I have been there, and it was nice, really. Comment {i}.</p>" for i in range(5))
    assert html_main.main_text(f"<main>{story}<div class=comments>{comments}</div></main>") == want


def test_comments_notices_and_inline_elements():
    """Unnamed comments longer than the post, a nameless notice before main, and inline elements that hold no text of the article."""
    post, said = "<p>" + "The mill stood by the river, and it was old. " * 4 + "</p>", "<p>" + "I think so too, and I would add that this is fine. " * 3 + "</p>"
    want = ("The mill stood by the river, and it was old. " * 4).strip()
    for head in ("Reader comments", "12 Comments", "Comments (3)", "Kommentare"):
        assert html_main.main_text(f"<body><div class=post>{post}<p>It was short.</p></div><section><h2>{head}</h2>{said * 6}</section></body>") == f"{want}\nIt was short."
    flat = f"<body><h1>Mills</h1>{post}<h3>Comments</h3>{said * 2}<h2>Mills today</h2>{post}</body>"
    assert html_main.main_text(flat) == f"Mills\n{want}\nMills today\n{want}"
    assert html_main.main_text(f"<article><h1>Comments</h1>{post}</article>") == f"Comments\n{want}" and html_main.main_text(f"<article><h1>Mills</h1>{post}<h2>Discussion</h2>{post}</article>") == f"Mills\n{want}\nDiscussion\n{want}"
    notice = "<p>" + "This site is closed for repairs on Monday, we are sorry. " * 3 + "</p>"
    assert html_main.main_text(f"<div>{notice}</div><main>{post}{post}</main>") == f"{want}\n{want}"
    for inline in ("<button>buy</button>", "<math><mi>x</mi></math>", "<svg><text>t</text></svg>", "<span class=ad>Buy</span>", "<script>x<y</script>", "<select><option>1<option>2</select>"):
        page = f"<article><p>{want} It went on.{inline} after, <i>so</i> it is.</p><p>{want}</p></article>"
        assert html_main.main_text(page) == f"{want} It went on. after, so it is.\n{want}", inline
    assert html_main.main_text(f"<article><p>{want} a<span class=ad><div>Buy</div></span>b, so it went.</p></article>").count("\n") >= 1


def test_odd_letters_and_raw_text():
    """Letters whose lower case is longer move nothing, and many raw elements take linear time."""
    assert html_main.main_text(f"<html><title>İstanbul</title><body><article><p>{LONG}</p></article>") == LONG.strip()
    assert html_main.main_text(f"<article><p>İİİ {LONG}</p><iframe src=x>no</IFRAME ><p>{LONG}</p></article>") == f"İİİ {LONG.strip()}\n{LONG.strip()}"
    import time

    began = time.time()
    html_main.main_text("<textarea>x</textarea><iframe></iframe>" * 50_000 + f"<p>{LONG}")
    assert time.time() - began < 20


def test_page_rows(spark):
    rows = [(1, "u", "<p>a, b.</p>", 1), (1, "u", "<p>a, b.</p>", 1), (None, None, None, 2)]
    got = html_main.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "a, b.", 5)] * 2 + [(None, None, "", 0)])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.extract_main(none).count() == 0 and pii.find_pii(spark.createDataFrame([], cases.SCHEMA)).count() == 0


def test_pipeline(spark):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{cases.SMALL}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, cases.SMALL))
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert now.items() <= kept.items() and now
        if name == "exact":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in kept.values()]
            assert len(now) == len(set(norm))
        kept = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, cases.SMALL)
    assert {r.doc_id for r in out.collect()} == set(kept)
