"""URLs, edits, encodings, modes and SQL names."""

import pytest
from pyspark.sql import functions as F

from sievedom.functions import columns as C
from sievedom.functions import css, edits, encoding, urls
from sievedom.functions.sanitizer import Config, refresh_ok, sanitize, sanitize_mode
from sievedom.plans.attacks import _rows
from sievedom.plans.register import register
from sievedom.plans.ship import ship

# URLs as the standard reads them.
URLS = [
    ("http://[::1]:80/x", None, "http://[::1]/x"), ("HTTP://EX.com:080/a/../b/./c?q=1 2#f g", None, "http://ex.com/b/c?q=1%202#f%20g"), ("../x?y", "http://h/a/b/c", "http://h/a/x?y"), ("//o/x", "https://h/p", "https://o/x"),
    ("http://h:99999/", None, None), ("http://a b/", None, None), ("http://1.2.3/", None, "http://1.2.0.3/"), ("http://256.1.1.1/", None, None), ("mailto:x@y", None, "mailto:x@y"), ("/x", "mailto:a", None), ("?z", "http://h/a?b#c", "http://h/a?z"),
    ("http:\\\\h\\p", None, "http://h/p"), ("http://h%41/", None, "http://ha/"), ("x", None, None), ("#f", "mailto:a", "mailto:a#f"), ("http://u@h/", None, "http://u@h/"), ("file:///a/../b", None, "file:///b"), ("http://h/%2e%2e/a", None, "http://h/a"),
    ("http://[::ffff:1.2.3.4]/", None, "http://[::ffff:102:304]/"), ("http://[::1", None, None), ("data:text/plain,a b", None, "data:text/plain,a b"), ("http:x", "http://h/a/b", "http://h/a/x"), ("", "http://h/a?b#c", "http://h/a?b"),
]


@pytest.mark.parametrize(("url", "base", "want"), URLS)
def test_urls(url, base, want):
    parts = urls.parse_url(url, base)
    assert (parts and urls.url_string(parts)) == want
    if want:
        assert urls.url_string(urls.parse_url(want)) == want


def test_url_parts():
    u = "https://a.example:99/p?q#f"
    assert urls.with_part(u, "scheme", "http") == "http://a.example:99/p?q#f" and urls.with_part(u, "scheme", "x") == u and urls.with_part(u, "port", "443") == "https://a.example/p?q#f"
    assert urls.with_part(u, "hostname", "b:1") == "https://b:99/p?q#f" and urls.with_part(u, "host", "b:1") == "https://b:1/p?q#f" and urls.with_part(u, "host", "a b") == u
    assert urls.with_part(u, "username", "a@") == "https://a%40@a.example:99/p?q#f" and urls.with_part(u, "query", "") == "https://a.example:99/p#f" and urls.with_part("x", "query", "") is None
    assert urls.search_params("?a=1&b=%20+&c&=d") == [("a", "1"), ("b", "  "), ("c", ""), ("", "d")] and urls.search_string([("a b", "é&~*")]) == "a+b=%C3%A9%26%7E*"
    with pytest.raises(ValueError):
        urls.with_part(u, "color", "")


def test_edits():
    page = "<ul><li id=a>x</li><li>y</li></ul>"
    body = lambda h: edits.body_html(h)
    assert body(edits.move_before(page, "#a", None)) == '<ul><li>y</li><li id="a">x</li></ul>' and body(edits.move_before(page, "li + li", "#a")) == '<ul><li>y</li><li id="a">x</li></ul>'
    assert body(edits.move_before(page, "ul", "#a")) == body(page)
    assert edits.fragment_nodes("a<b>c</b><!--d-->") == ["a", "<b>c</b>", "<!--d-->"] and edits.fragment_nodes("<tr><td>1", "tbody") == ["<tr><td>1</td></tr>"]
    assert edits.position(page, "#a", "li + li") == 4 and edits.position(page, "li + li", "#a") == 2 and edits.position(page, "ul", "p") is None
    assert edits.camel("user-id") == "userId" and edits.kebab("userId") == "user-id" and edits.dataset("<p data-user-id=7>", "p") == {"userId": "7"}
    assert edits.is_empty("<p> </p>", "p") and not edits.is_empty("<p><i></i></p>", "p") and edits.is_empty("<br>", "br")
    assert edits.minify_string("<p> <b>x </b>\n </p> <pre> <i> </pre><!--c-->", comments=False) == "<p><b>x </b></p><pre> <i> </pre>"
    with pytest.raises(ValueError):
        edits.create_comment("a--b")
    with pytest.raises(ValueError):
        edits.insert_adjacent(page, "#a", "inside", "x")


def test_encodings():
    assert encoding.decode("é€".encode("cp1252"), "latin1") == "é€" and encoding.decode(b"\xff\xfea\0") == "a" and encoding.decode(b"\xef\xbb\xbfa") == "a" and encoding.decode(b"a\xff") == "a�"
    assert encoding.detect(b"<meta charset='windows-1251'>") == "cp1251" and encoding.detect(b"<meta charset=utf-16>") == "utf-8" and encoding.lookup("no such") is None
    assert encoding.encode("é中", "latin1") == b"\xe9&#20013;"


def test_modes():
    page = "<p style='color:red' id=location>x<!--c--><script>1</script><style>p{}</style></p>"
    assert sanitize_mode(page, "permissive") == sanitize_mode(page, "strict") == "<p>x</p>"
    assert "<script>" in sanitize_mode(page, "minimum") and "<!--c-->" in sanitize_mode(page, "minimum") and 'id="location"' in sanitize_mode(page, "minimum")
    assert "script" not in sanitize_mode(page, "minimum", harden=True) and "location" not in sanitize_mode(page, "minimum", harden=True)
    embed = {"allow_embeds": True}
    for bad in ("<object data='http://e/x.html'></object>", "<object data=/a.pdf type=text/html></object>", "<embed src=/a.swf>", "<embed src=/a type=application/x-silverlight>"):
        assert sanitize_mode(bad, embed) == sanitize_mode(bad, embed, True) == ""
    assert sanitize_mode("<embed src=/a.flac>", embed) == '<embed src="/a.flac">'
    assert "<base target" in sanitize("<base target=_top rel=noopener>") or "<base" in sanitize("<base target=_self>")
    assert refresh_ok("5; url=/x") and not refresh_ok("0") and not refresh_ok("9;url=javascript:x") and not refresh_ok("x")
    c = Config(elements=({"name": "p"},), removeAttributes=("id",))
    assert c.element_allowed("p") and not c.element_allowed("b") and not c.attribute_allowed("id") and not c.attribute_allowed("@click") and c.attribute_allowed("title")
    with pytest.raises(ValueError):
        sanitize_mode(page, "no such")
    with pytest.raises(ValueError):
        Config.resolve(None, {"elements": [{"name": "p"}], "removeElements": ["b"]})


def test_rulesets():
    style = "color: var(--c); width: calc(1px); height: frob(1); top: expression(1); margin: 1px"
    assert css.CssPolicy.of("default").inline(style) == "width: calc(1px); margin: 1px" and css.CssPolicy.of("strict").inline(style) == "margin: 1px"
    assert css.CssPolicy.of("permissive").inline(style) == "color: var(--c); width: calc(1px); height: frob(1); margin: 1px"
    assert [r["inside"] for r in css.rule_rows("a{b:c}@media x{d{e:f}}")] == [None, "@media x"]


def test_attacks_have_many_forms():
    rows = _rows()
    assert len(rows) > 500 and len({r[2] for r in rows}) > 0.95 * len(rows)


def test_wrong_arguments_fail_when_the_column_is_made(spark):
    for make in (lambda: C.sanitize_html_mode(F.col("h"), "no such"), lambda: C.text_content(F.col("h"), "p["), lambda: C.set_url_part(F.col("h"), "color", F.lit("")), lambda: C.edit_params(F.col("h"), "turn"), lambda: C.decode_bytes(F.col("h"), "no such")):
        with pytest.raises((ValueError, KeyError)):
            make()


def test_sql_names(spark):
    register(spark)
    spark.createDataFrame([(1, "<p onclick=x>a<b>c</b></p><script>1</script>"), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    assert [r[0] for r in spark.sql("SELECT sanitize_html(html, 'strict') FROM some_pages ORDER BY id").collect()] == ["<html><head></head><body><p>a<b>c</b></p></body></html>", None]
    assert spark.sql("SELECT p.id, n.tag FROM some_pages p, LATERAL dom_nodes(p.html) n WHERE n.tag = 'b'").collect() == [(1, "b")]
    assert spark.sql("SELECT html_text(html, 'p'), html_select(html, 'b') FROM some_pages WHERE id = 1").first() == ("ac", ["<b>c</b>"])
    assert spark.sql("SELECT * FROM html_fragment('<td>1<td>2', 'tr') ORDER BY pos").collect() == [(0, "<td>1</td>"), (1, "<td>2</td>")]


def test_sanitised_stream(spark, tmp_path):
    ship(spark)
    spark.createDataFrame([(1, "<p onclick=x>a</p>"), (2, None)], "id int, html string").write.parquet(str(tmp_path / "in"))
    clean = spark.readStream.schema("id int, html string").parquet(str(tmp_path / "in")).select("id", C.sanitize_html(F.col("html"), fragment=True).alias("clean"))
    q = clean.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cleaned").collect())) == [(1, "<p>a</p>"), (2, None)]


def test_files(spark, tmp_path):
    from sievedom.sources.html import read_html, write_html

    (tmp_path / "a.html").write_bytes(b"<meta charset=windows-1252><p>\xe9\n</p>")
    (tmp_path / "b.html").write_bytes("\ufeff<p>中</p>".encode("utf-16-le"))
    (tmp_path / "c.html").write_bytes(b"x" * 300)
    got = {r.path[-6]: (r.html, r.error) for r in read_html(spark, str(tmp_path), max_bytes=200).collect()}
    assert got == {"a": ("<meta charset=windows-1252><p>é\n</p>", None), "b": ("<p>中</p>", None), "c": (None, "300 bytes, over the limit")}
    write_html(spark.createDataFrame([(1, "a\n b")], "doc_id int, html string"), str(tmp_path / "out"), "doc_id")
    assert spark.read.json(str(tmp_path / "out")).first().html == "a\n b"


def test_command_line(tmp_path, capsys):
    from sievedom.__main__ import main

    (tmp_path / "a.html").write_text("<p onclick=x id=a>b<script>1</script></p>")
    assert main([str(tmp_path / "a.html"), "-f"]) == 0 and capsys.readouterr().out == '<p id="a">b</p>\n'
    (tmp_path / "a.md").write_text("# x")
    assert main([str(tmp_path / "a.md"), "--md", "-f", "-o", str(tmp_path / "o")]) == 0 and (tmp_path / "o").read_text().strip() == "<h1>x</h1>"
    (tmp_path / "c.json").write_text('{"removeElements": ["p"]}')
    main([str(tmp_path / "a.html"), "-f", "--config-file", str(tmp_path / "c.json")])
    assert capsys.readouterr().out.strip() == ""
    (tmp_path / "c.json").write_text(" " * 600_000)
    with pytest.raises(SystemExit):
        main([str(tmp_path / "a.html"), "--config-file", str(tmp_path / "c.json")])


def test_drives_and_names():
    """File URLs with drives, and names by the rules that keep the sharp s; refusals are None."""
    from sievedom.functions.urls import parse_url, url_string

    for url, base, want in [
        ("file:///C|/x/../y", None, "file:///C:/y"), ("file://C|/x", None, "file:///C:/x"), ("file://C:/../..", None, "file:///C:/"), ("/x", "file:///D:/y/z", "file:///D:/x"), ("x", "file:///D:/y/z", "file:///D:/y/x"), ("C|/x", "file:///D:/y", "file:///C:/x"),
        ("..", "file:///D:", "file:///D:/"), ("C|a", "file:///x/y", "file:///x/C|a"), ("//server/f", "file:///tmp/m", "file://server/f"), ("file:///w|m", None, "file:///w|m"), ("file://h:80/x", None, None), ("file://localhost/x", None, "file:///x"), ("file:", None, "file:///"),
        ("http://fa\u00df.de/", None, "http://xn--fa-hia.de/"), ("http://XN--FA-HIA.de", None, "http://xn--fa-hia.de/"), ("http://xn--/", None, None), ("http://xn--zzz-/", None, None), ("http://B\u00dcCHER.de/", None, "http://xn--bcher-kva.de/"), ("http://a\u00adb.c/", None, "http://ab.c/"),
        ("http://\u2603.net/", None, "http://xn--n3h.net/"), ("http://\uff27\uff4f.com", None, "http://go.com/"), ("http://a\u3002b/", None, "http://a.b/"), ("http://\u0301a/", None, None), ("http://\ue000.a/", None, None),
    ]:
        parts = parse_url(url, base)
        assert (None if parts is None else url_string(parts)) == want, (url, base)
