"""The CSS cascade over ``dom_nodes``: which declarations hold for which elements, as joins and one window.

Stylesheets are parsed once each, however many pages share one.  A rule's
compound selectors are rows keyed by an id, class or tag that an element must
have; elements meet them by their own ids, classes and tags, and conditions
that are left are checked on the pair.  Chains then go from left to right: what
passes a step is looked for among ancestors, parents or siblings of what may
pass the next, by windows over the rows of one rule in one tree.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import css
from ..functions.columns import class_tokens
from ..functions.dom import ELEMENT, TEXT
from ..functions.selectors import _nth, compiled, specificity
from ..plans.ship import ship
from .nodes import TREE
from .selecting import _HAVE, _NTH, attribute, positions

_TEST = "struct<kind:string,name:string,op:string,value:string,flag:boolean,a:int,b:int,negated:boolean>"
_STEP = f"struct<step:int,how:string,key:string,tests:array<{_TEST}>>"
_DECLARED = "array<struct<name:string,value:string,important:boolean>>"
_RULES = f"array<struct<rule_no:int,inside:string,spec:array<int>,steps:array<{_STEP}>,declarations:{_DECLARED}>>"
#: Preludes of groups whose rules hold on a screen without being asked for its size.
SCREEN = r"(?i)(@media (all|screen|only screen)|@layer\b[^,]*|@supports .*)( @media (all|screen))?"


def _tests(parts: tuple, negated: bool = False) -> list[dict] | None:
    """A compound selector's conditions; None if it holds a pseudo-class that says nothing about a tree at rest, as :hover."""
    out = []
    blank = {"kind": None, "name": None, "op": None, "value": None, "flag": False, "a": 0, "b": 0, "negated": negated}
    for p, argument in parts:
        pseudo = p["pseudo"]
        if p["tag"]:
            out.append(blank | {"kind": "tag", "name": p["tag"].lower()})
        elif p["id"]:
            out.append(blank | {"kind": "id", "name": p["id"]})
        elif p["cls"]:
            out.append(blank | {"kind": "class", "name": p["cls"]})
        elif p["attr"]:
            value = next((p[k] for k in ("q", "s", "w") if p[k] is not None), None)
            flag = bool(p["flag"])
            out.append(blank | {"kind": "attribute", "name": p["attr"].lower(), "op": p["op"], "value": value.lower() if flag and value else value, "flag": flag})
        elif pseudo == "not":
            chains = compiled(argument)
            if negated or any(len(c) != 1 or len(c[0][1]) != 1 for c in chains):
                return None
            inner = [_tests(c[0][1], True) for c in chains]
            if None in inner:
                return None
            out += [t for some in inner for t in some]
        elif pseudo == "root":
            out.append(blank | {"kind": "root"})
        elif pseudo in _HAVE:
            out.append(blank | {"kind": "attribute", "name": pseudo})
        elif pseudo is not None:
            if pseudo in _NTH:
                place, text = _NTH[pseudo]
            elif pseudo.startswith("nth-"):
                place, text = "_".join(x for x, there in (("last", pseudo.startswith("nth-last-")), ("type", pseudo.endswith("of-type"))) if there), argument
            else:
                return None
            a, b = _nth(text)
            out.append(blank | {"kind": "nth", "name": place, "a": int(a), "b": int(b)})
    return out


def _key(tests: list[dict]) -> str:
    """What an element must have: an id, else a class, else a tag, else nothing."""
    for kind in ("id", "class", "tag"):
        for t in tests:
            if t["kind"] == kind and not t["negated"]:
                return f"{kind} {t['name']}"
    return "any"


def sheet_rules(text: str) -> list[dict]:
    """A stylesheet's rules, one for each alternative of a selector that can be read."""
    out = []
    for rule in css.rule_rows(text):
        for part in css.split_top(rule["selector"], ","):
            try:
                (chain,) = compiled(part.strip())
                tests = [_tests(parts) for _, parts in chain]
                spec = list(specificity(chain))
            except (ValueError, KeyError):
                continue
            if None not in tests:
                steps = [{"step": i, "how": how, "key": _key(t), "tests": t} for i, ((how, _), t) in enumerate(zip(chain, tests, strict=True))]
                out.append({"rule_no": rule["rule_no"], "inside": rule["inside"], "spec": spec, "steps": steps, "declarations": rule["declarations"]})
    return out


def _inline_style(text: str) -> list[dict]:
    return [{"name": n, "value": v.removesuffix("!important").rstrip(), "important": v.endswith("!important")} for n, v in css.declarations(text)]


def _of_each(f: Callable[[str], list], kind: str) -> Callable:
    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in column], dtype=object)

    return F.pandas_udf(texts, kind)


def stylesheets(nodes: DataFrame) -> DataFrame:
    """Each style element's text outside template contents: doc_id, sheet_no (its node), css."""
    rows = nodes.where("tree_id = 0").repartition(*TREE)
    inside = W.partitionBy(*TREE).orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    style = F.when((F.col("node_type") == ELEMENT) & (F.lower("tag") == "style"), F.struct("node_id", "last_desc"))
    held = rows.select("doc_id", "node_id", "node_type", "text", F.last(style, ignorenulls=True).over(inside).alias("_in")).where((F.col("node_type") == TEXT) & (F.col("_in.last_desc") >= F.col("node_id")))
    texts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return held.groupBy("doc_id", F.col("_in.node_id").alias("sheet_no")).agg(F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("css"))


def rule_steps(sheets: DataFrame, applies: Column | None = None) -> DataFrame:
    """A row for each compound of each alternative of each rule of the distinct stylesheets: sheet (a hash of the text), rule_no, alt, step, n_steps, how, key, tests, spec, declarations."""
    ship(sheets.sparkSession)
    distinct = sheets.select(F.sha2("css", 256).alias("sheet"), "css").dropDuplicates(["sheet"])
    rules = distinct.select("sheet", F.posexplode(_of_each(sheet_rules, _RULES)("css")).alias("alt", "r")).select("sheet", "alt", "r.*")
    rules = rules.where(F.col("inside").isNull() | F.regexp_like("inside", F.lit(rf"\A{SCREEN}\z")) if applies is None else applies)
    return rules.select("sheet", "rule_no", "alt", "spec", "declarations", F.size("steps").alias("n_steps"), F.inline("steps"))


def _holds(t: Column) -> Column:
    """One condition on one element."""
    value = F.get(F.filter("attrs", lambda a: a["name"] == t["name"]), F.lit(0))["value"]
    have = F.when(t["flag"], F.lower(value)).otherwise(value)
    want, some = t["value"], F.length(t["value"]) > 0
    by_attribute = (
        F.when(t["op"].isNull(), have.isNotNull()).when(t["op"] == "=", have == want).when(t["op"] == "~=", F.array_contains(F.split(have, r"\s+"), want) & some)
        .when(t["op"] == "|=", (have == want) | F.startswith(have, F.concat(want, F.lit("-")))).when(t["op"] == "^=", F.startswith(have, want) & some)
        .when(t["op"] == "$=", F.endswith(have, want) & some).when(t["op"] == "*=", F.contains(have, want) & some)
    )
    at = F.when(t["name"] == "", F.col("_at")).when(t["name"] == "last", F.col("_at_last")).when(t["name"] == "type", F.col("_at_type")).otherwise(F.col("_at_last_type"))
    nth = F.when(t["a"] == 0, at == t["b"]).otherwise((F.try_mod(at - t["b"], t["a"]) == 0) & (F.try_divide(at - t["b"], t["a"]) >= 0))
    found = (
        F.when(t["kind"] == "tag", F.lower("tag") == t["name"]).when(t["kind"] == "id", attribute("id") == t["name"]).when(t["kind"] == "class", F.array_contains(F.col("_classes"), t["name"]))
        .when(t["kind"] == "attribute", by_attribute).when(t["kind"] == "root", F.col("depth") == 1).when(t["kind"] == "nth", nth)
    )
    return F.coalesce(found, F.lit(False)) != t["negated"]


_RULE = ["doc_id", "tree_id", "sheet_no", "rule_no", "alt"]


def matched_rules(nodes: DataFrame, sheets: DataFrame | None = None, applies: Column | None = None) -> DataFrame:
    """Pairs of an element outside template contents and a rule of its page that matches: doc_id, tree_id, node_id, tag, sheet_no, rule_no, alt, spec, declarations.

    ``sheets`` (doc_id, sheet_no, css) are the page's style elements unless
    others are given, as linked ones.  ``applies`` is a condition on inside, the
    preludes of the groups a rule lies in; by default those of SCREEN do.
    Selectors with states (:hover), :has, :is or a :not of more than one simple
    selector match nothing.
    """
    sheets = stylesheets(nodes) if sheets is None else sheets
    # kept, since it is asked for its longest chain first, and small: rules of distinct sheets; its size is known then
    steps = rule_steps(sheets, applies).persist()
    longest = steps.agg(F.max("n_steps")).first()[0] or 0
    e = positions(nodes.where((F.col("tree_id") == 0) & (F.col("node_type") == ELEMENT)).repartition(*TREE))
    classes = F.coalesce(class_tokens(attribute("class")), F.array().cast("array<string>"))
    e = e.withColumn("_classes", classes)
    keys = F.concat(
        F.array(F.lit("any"), F.concat(F.lit("tag "), F.lower("tag"))), F.transform("_classes", lambda c: F.concat(F.lit("class "), c)),
        F.when(attribute("id").isNotNull(), F.array(F.concat(F.lit("id "), attribute("id")))).otherwise(F.array().cast("array<string>")),
    )
    of = sheets.select("doc_id", "sheet_no", F.sha2("css", 256).alias("sheet"))
    wanted = steps.groupBy("sheet").agg(F.collect_set("key").alias("_keys"))
    # only keys that a page's sheets ask for meet its elements, and all rules of a sheet meet each key once; a row for each page, so never broadcast
    offered = of.join(wanted, "sheet").hint("merge")
    met = e.join(offered, "doc_id").withColumn("key", F.explode(F.array_intersect(keys, "_keys"))).drop("_keys").join(steps, ["sheet", "key"])
    met = met.where(F.forall("tests", _holds)).select(
        *_RULE, "node_id", "parent_id", "last_desc", "tag", "step", "n_steps", "how", "spec", "declarations", F.col("_at").alias("at"), (F.col("step") == 0).alias("_passed"),
    )
    if longest > 1:
        met = met.repartition("doc_id", "tree_id")
    for k in range(1, longest):
        met = _next_step(met, k)
    return met.where("_passed and step = n_steps - 1").select("doc_id", "tree_id", "node_id", "tag", "sheet_no", "rule_no", "alt", "spec", "declarations")


def _next_step(met: DataFrame, k: int) -> DataFrame:
    """Marks the rows of step ``k`` whose ancestor, parent or sibling, as their combinator says, has passed the step before."""
    both = met.withColumn("_on", (F.col("step") == k - 1) & F.col("_passed"))
    on = F.col("_on")
    above = W.partitionBy(*_RULE).orderBy("node_id", "_on").rowsBetween(W.unboundedPreceding, -1)
    family = W.partitionBy(*_RULE, F.when(on, F.col("node_id")).otherwise(F.col("parent_id")))
    beside = W.partitionBy(*_RULE, "parent_id").orderBy("node_id", "_on").rowsBetween(W.unboundedPreceding, -1)
    marked = both.select(
        "*", F.max(F.when(on, F.col("last_desc"))).over(above).alias("_reach"), F.max(on).over(family).alias("_child"), F.max(F.when(on, F.col("at"))).over(beside).alias("_before"),
    )
    ok = F.when(F.col("how") == " ", F.col("_reach") >= F.col("node_id")).when(F.col("how") == ">", F.col("_child")).when(F.col("how") == "+", F.col("_before") == F.col("at") - 1).otherwise(F.col("_before").isNotNull())
    return marked.withColumn("_passed", F.when(F.col("step") == k, F.coalesce(ok, F.lit(False))).otherwise(F.col("_passed"))).drop("_on", "_reach", "_child", "_before")


def cascaded(nodes: DataFrame, sheets: DataFrame | None = None, applies: Column | None = None) -> DataFrame:
    """The declaration that holds for each element and property: doc_id, tree_id, node_id, tag, name, value, important, and where it is from: sheet_no and rule_no (null for a style attribute).

    More important ones win, then those of style attributes, then by
    specificity, then the last.  Nothing is inherited.
    """
    rules = matched_rules(nodes, sheets, applies)
    own = nodes.where((F.col("tree_id") == 0) & (F.col("node_type") == ELEMENT)).withColumn("_style", attribute("style")).where("_style is not null")
    own = own.select("doc_id", "tree_id", "node_id", "tag", F.lit(None).cast("int").alias("sheet_no"), F.lit(None).cast("int").alias("rule_no"), F.lit(None).cast("array<int>").alias("spec"), _of_each(_inline_style, _DECLARED)("_style").alias("declarations"))
    rows = rules.drop("alt").unionByName(own).select("doc_id", "tree_id", "node_id", "tag", "sheet_no", "rule_no", "spec", F.posexplode("declarations").alias("_no", "d"))
    rows = rows.select("doc_id", "tree_id", "node_id", "tag", "sheet_no", "rule_no", "spec", "_no", "d.*")
    best = W.partitionBy("doc_id", "tree_id", "node_id", "name").orderBy(F.desc("important"), F.desc(F.col("rule_no").isNull()), F.desc("spec"), F.desc("sheet_no"), F.desc("rule_no"), F.desc("_no"))
    return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "spec", "_no")
