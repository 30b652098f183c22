"""Attacks on a sanitiser, built by rule: each with what a clean page must not hold, and what it must."""

from __future__ import annotations

from collections import Counter
from html import escape

from pyspark.sql import DataFrame, SparkSession

_EVENTS = (
    "abort afterprint animationcancel animationend animationiteration animationstart auxclick beforecopy beforecut beforeinput beforeprint beforetoggle beforeunload blur cancel canplay change click close "
    "contextmenu copy cuechange cut dblclick drag dragend dragenter dragleave dragover dragstart drop durationchange ended error focus focusin focusout formdata fullscreenchange gotpointercapture hashchange "
    "input invalid keydown keypress keyup load loadeddata loadstart lostpointercapture message mousedown mouseenter mouseleave mousemove mouseout mouseover mouseup mousewheel offline online pagehide pageshow "
    "paste pause play playing pointercancel pointerdown pointerenter pointermove pointerup popstate progress ratechange reset resize scroll scrollend search seeked seeking select selectionchange show stalled "
    "submit suspend timeupdate toggle touchend touchmove touchstart transitioncancel transitionend transitionstart unhandledrejection unload volumechange waiting wheel"
).split()
_HOSTS = ("p", "div", "a", "img", "body", "video", "svg", "details", "input")


def _spellings(scheme: str) -> dict[str, str]:
    """Ways to write a scheme in an attribute that a browser reads as the scheme."""
    return {
        "plain": scheme, "upper": scheme.upper(), "mixed": "".join(c.upper() if i % 2 else c for i, c in enumerate(scheme)), "decimal": "".join(f"&#{ord(c)};" for c in scheme), "hex": "".join(f"&#x{ord(c):x};" for c in scheme),
        "padded": "".join(f"&#{ord(c):07d};" for c in scheme), "tab": scheme[:4] + "&#9;" + scheme[4:], "line": scheme[:3] + "\n" + scheme[3:], "leading": " \x01&#14; " + scheme, "named": scheme.replace(":", "&colon;"),
    }


def _vectors():
    for i, e in enumerate(_EVENTS):
        host = _HOSTS[i % len(_HOSTS)]
        quote = ('="alert(1)"', "=alert(1)", "='alert(1)'", "\n=\n`alert(1)`", "")[i % 5]
        yield "handlers", f"<{host} on{e}{quote} title=t>kept{i}</{host}>", [f"on{e}", "alert"], [] if host in ("video", "svg", "img", "input") else [f"kept{i}"]
        yield "handlers", f"<P ON{e.upper()}={'alert(2)'} oN{e}=3>kept</P>", [f"on{e}", "alert"], ["<p>kept</p>"]
    for scheme in ("javascript:", "vbscript:"):
        for how, text in _spellings(scheme).items():
            for tag, attr in (("a", "href"), ("img", "src"), ("iframe", "src"), ("form", "action"), ("object", "data"), ("embed", "src"), ("video", "poster"), ("button", "formaction"), ("body", "background")):
                yield "schemes", f'<{tag} {attr}="{text}alert(1)">k</{tag}><p>after {how}</p>', [scheme, "alert"], ["after"]
    for body in ("text/html,<script>alert(1)</script>", "text/html;base64,PHNjcmlwdD4=", "image/svg+xml,<svg onload=alert(1)>", "application/javascript,alert(1)", "image/png;base64,PHNjcmlwdD4="):
        for tag, attr in (("a", "href"), ("img", "src"), ("iframe", "src"), ("embed", "src"), ("object", "data")):
            yield "data", f'<{tag} {attr}="data:{escape(body)}">k</{tag}><i>after</i>', ["data:", "alert"], ["<i>after</i>"]
    for i, tag in enumerate(("script", "SCRIPT", "ScRiPt", "script/x", "script\n", "script src=//e/x.js", "script type=module", "svg><script", "math><script", "template><script")):
        yield "scripts", f"<{tag}>alert(1)</script>{'</svg>' if 'svg' in tag else '</math>' if 'math' in tag else '</template>' if 'template' in tag else ''}<b>after {i}</b>", ["script", "alert"], [f"<b>after {i}</b>"]
    for tag in ("iframe", "object", "embed", "applet", "frame", "frameset", "layer", "bgsound", "xml", "isindex", "portal", "marquee onstart=alert(1)", "blink", "keygen onfocus=alert(1)"):
        name = tag.split()[0]
        yield "elements", f"<i>before</i><{tag} src=//evil.example/x data=//evil.example/x srcdoc='<script>alert(1)</script>'></{name}>", [f"<{name}", "evil.example", "alert"], ["<i>before</i>"]
    for name in ("location", "document", "cookie", "__proto__", "constructor", "parentNode", "attributes", "innerHTML", "body", "forms"):
        for tag in ("form", "img", "a", "input"):
            yield "clobbering", f"<{tag} id={name} name={name} title=t><p>kept</p>", [f'id="{name.lower()}"', f'name="{name.lower()}"'], ["kept"]
    for css in ("x:expression(alert(1))", "behavior:url(x.htc)", "-moz-binding:url(x.xml#a)", "background:url(javascript:alert(1))", "background:url('vbscript:alert(1)')", "background:url(data:text/html;base64,eA==)", "x:progid(alert)",
                "width:eXpReSsIoN(alert(1))", "background:\\75rl(javascript:alert(1))", "@import 'x'", "-o-link:'javascript:alert(1)'", "color:red;x:url(//evil.example/x)"):
        yield "styles", f'<p style="{escape(css)}">kept</p>', ["alert", "expression", "behavior", "binding", "javascript", "evil.example", "@import", "text/html"], ["kept</p>"]
        yield "styles", f"<p>kept</p><style>p {{ {css} }}</style>", ["alert", "expression", "behavior", "binding", "javascript", "evil.example", "@import", "text/html"], ["<p>kept</p>"]
    for tag in ("foreignObject", "animate", "set", "animateMotion", "animateTransform", "feImage", "script", "handler", "switch"):
        yield "svg", f"<svg><{tag} attributeName=href to='javascript:alert(1)' href='javascript:alert(1)'>alert(1)</{tag}></svg><p>kept</p>", ["javascript", f"<{tag.lower()}"], ["<p>kept</p>"]
    for tag in ("maction", "annotation-xml", "semantics", "mpadded", "mphantom"):
        yield "mathml", f"<math><{tag} actiontype=statusline xlink:href='javascript:alert(1)' href='javascript:alert(1)'>x</{tag}></math><p>kept</p>", ["javascript", f"<{tag}"], ["<p>kept</p>"]
    for end in ("style", "script", "title", "textarea", "noscript", "xmp", "iframe", "noembed", "noframes"):
        yield "mutation", f'<p title="</{end}><img src=x onerror=alert(1)>">kept</p>', ["onerror", "alert", f"</{end}>"], ["kept"]
        yield "mutation", f'<{end}><p title="</{end}><img src=x onerror=alert(1)>"></p><b>kept</b>', ["onerror=", 'onerror="'], ["kept"]
    for fill in ("\0", "\x01", "\x0b", "​", "\xad", "/"):
        yield "controls", f"<img{fill} src=x{fill} on{fill}error=alert(1)><b>after</b>", ["onerror=", 'onerror="'], []  # the rest can be in an unknown element
        yield "controls", f'<a href="java{fill}script:alert(1)" onclick{fill}=alert(2)>kept</a>', ['="javascript', "onclick="], ["kept"]


def _rows() -> list[tuple]:
    return [(s, i, h, f, k) for i, (s, h, f, k) in enumerate(_vectors())]


#: Suites and how many vectors each has.
SUITES = dict(Counter(r[0] for r in _rows()))


def attack_rows(spark: SparkSession) -> DataFrame:
    """suite, vector_id, html, forbidden (lower case), kept (lower case)."""
    return spark.createDataFrame(_rows(), "suite string, vector_id int, html string, forbidden array<string>, kept array<string>").repartition(spark.sparkContext.defaultParallelism)
