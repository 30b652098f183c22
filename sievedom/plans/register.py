"""SQL names for the functions: ``register(spark)``, then SELECT sanitize_html(html, 'strict') and FROM dom_nodes(html)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import edits, transform, uri, urls
from ..functions.markdown import markdown_to_html
from ..functions.sanitizer import Config, sanitize, sanitize_mode
from ..operators.nodes import node_rows
from .ship import ship


def _vectorised(f, kind):
    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

    names = ", ".join(f"a{i}: pd.Series" for i in range(f.__code__.co_argcount))
    scope = {"batch": batch, "pd": pd}
    exec(f"def wrapped({names}) -> pd.Series:\n    return batch({', '.join(f'a{i}' for i in range(f.__code__.co_argcount))})", scope)  # a fixed number of arguments
    return F.pandas_udf(scope["wrapped"], kind)


_FUNCTIONS = {
    "sanitize_html": (lambda html, preset: sanitize(html, Config.preset(preset)), T.StringType()),
    "sanitize_html_config": (lambda html, config: sanitize(html, Config.resolve(None, config)), T.StringType()),
    "sanitize_html_mode": (lambda html, mode: sanitize_mode(html, mode), T.StringType()),
    "markdown_to_html": (lambda text: markdown_to_html(text), T.StringType()),
    "minify_html": (lambda html: transform.minify(html), T.StringType()),
    "pretty_html": (lambda html: transform.pretty(html), T.StringType()),
    "html_text": (lambda html, selector: transform.text_content(html, selector), T.StringType()),
    "html_attribute": (lambda html, selector, name: transform.attribute(html, selector, name), T.StringType()),
    "html_select": (lambda html, selector: transform.select_all(html, selector), T.ArrayType(T.StringType())),
    "html_remove": (lambda html, selector: transform.remove(html, selector), T.StringType()),
    "html_insert": (lambda html, selector, where, new: edits.insert_adjacent(html, selector, where, new), T.StringType()),
    "validate_uri": (lambda value: uri.validate_uri(value), T.BooleanType()),
    "url_set": (lambda url, part, value: urls.with_part(url, part, value), T.StringType()),
}


class _Nodes:
    def eval(self, html: str):
        if html is not None:
            from sievedom.functions.dom import parse

            for r in node_rows(0, parse(html)):
                yield r["tree_id"], r["node_id"], r["parent_id"], r["depth"], r["last_desc"], r["node_type"], r["tag"], r["ns"], {a["name"]: a["value"] for a in r["attrs"] or ()}, r["text"]


class _Fragment:
    def eval(self, html: str, context: str):
        for i, node in enumerate(edits.fragment_nodes(html, context) if html is not None else ()):
            yield i, node


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL, and gives their names."""
    ship(spark)
    for name, (f, kind) in _FUNCTIONS.items():
        spark.udf.register(name, _vectorised(f, kind))
    nodes = F.udtf(_Nodes, returnType="tree_id int, node_id int, parent_id int, depth int, last_desc int, node_type int, tag string, ns string, attrs map<string,string>, text string")
    spark.udtf.register("dom_nodes", nodes)
    spark.udtf.register("html_fragment", F.udtf(_Fragment, returnType="pos int, html string"))
    return [*_FUNCTIONS, "dom_nodes", "html_fragment"]
