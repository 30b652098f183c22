"""Markdown conversion."""

import time

import pytest

from sievedom.functions.markdown import markdown_to_html
from sievedom.functions.sanitizer import sanitize

CASES = [
    ("", ""),
    ("# Hi #\n\ntext", "<h1>Hi</h1>\n<p>text</p>\n"),
    ("Title\n===\nb\n---", "<h1>Title</h1>\n<h2>b</h2>\n"),
    ("This is **GFM** *it* ***both*** snake_case_name", "<p>This is <strong>GFM</strong> <em>it</em> <em><strong>both</strong></em> snake_case_name</p>\n"),
    ("| A | B |\n|---|:-:|\n| 1 | 2 |", '<table>\n<thead>\n<tr>\n<th>A</th>\n<th align="center">B</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td align="center">2</td>\n</tr>\n</tbody>\n</table>\n'),
    ("- [x] a\n- [ ] b", '<ul>\n<li class="task-list-item"><input type="checkbox" class="task-list-item-checkbox" disabled checked> a</li>\n<li class="task-list-item"><input type="checkbox" class="task-list-item-checkbox" disabled> b</li>\n</ul>\n'),
    ("~~S~~, https://example.com autolink, and <span>raw</span>", '<p><del>S</del>, <a href="https://example.com">https://example.com</a> autolink, and <span>raw</span></p>\n'),
    ("2. a\n3. b", '<ol start="2">\n<li>a</li>\n<li>b</li>\n</ol>\n'),
    ("- a\n  - b", "<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul></li>\n</ul>\n"),
    ("> q\nmore\n\n***", "<blockquote>\n<p>q\nmore</p>\n</blockquote>\n<hr>\n"),
    ("```py\na < b\n```", '<pre><code class="language-py">a &lt; b\n</code></pre>\n'),
    ("    code", "<pre><code>code\n</code></pre>\n"),
    ('[x](/u "t") ![p](i.png) [r]\n\n[r]: /ref', '<p><a href="/u" title="t">x</a> <img src="i.png" alt="p"> <a href="/ref">r</a></p>\n'),
    ("`a``b` \\*x\\* a  \nb", "<p><code>a``b</code> *x* a<br>\nb</p>\n"),
    ("<div>\n*x*\n</div>\n\n*y*", "<div>\n*x*\n</div>\n<p><em>y</em></p>\n"),
    ("[ a [b](c) ]]", '<p>[ a <a href="c">b</a> ]]</p>\n'),
    ("mail a@b.org or www.x.org.", '<p>mail <a href="mailto:a@b.org">a@b.org</a> or <a href="http://www.x.org">www.x.org</a>.</p>\n'),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_case(text, want):
    assert markdown_to_html(text) == want


def test_result_is_sanitised():
    assert "javascript" not in sanitize(markdown_to_html("[x](javascript:alert(1)) <script>javascript</script>"))


@pytest.mark.parametrize("text", ["[" * 20000, "*a " * 20000, "`" * 5000, "> " * 3000, "- " * 3000, "![" * 9000, "<" * 20000, "a_" * 20000])
def test_long_odd_text(text):
    began = time.time()
    markdown_to_html(text)
    assert time.time() - began < 20
