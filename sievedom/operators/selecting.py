"""CSS selectors over ``dom_nodes``, for all documents and many selectors at once.

A tree's nodes are preorder intervals, so an element is below another if it
comes after it and not after its last descendant.  Merging the sorted lists of
two kinds of elements with a stack then comes down to one running maximum: an
element has an ancestor of a kind exactly if the largest last descendant among
earlier elements of that kind reaches it.  Child and sibling steps are windows
over the rows that share a parent.  All windows lie within one tree, so there is
one exchange, by tree, however many selectors there are, and no join.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import class_tokens
from ..functions.dom import ELEMENT, TEXT
from ..functions.selectors import _nth, compiled
from .nodes import TREE

_NTH = {"first-child": ("", "0n+1"), "last-child": ("last", "0n+1"), "first-of-type": ("type", "0n+1"), "last-of-type": ("last_type", "0n+1")}
_HAVE = ("checked", "disabled", "required", "selected")


def attribute(name: str) -> Column:
    """An attribute's value, null if the element has none of that name."""
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


def positions(nodes: DataFrame) -> DataFrame:
    """Adds an element's place among its parent's elements and among those of its name, from both ends."""
    family, kind = W.partitionBy(*TREE, "parent_id"), W.partitionBy(*TREE, "parent_id", "tag")
    whole = lambda w: F.count("*").over(w)
    out = nodes.withColumn("_at", F.row_number().over(family.orderBy("node_id"))).withColumn("_at_type", F.row_number().over(kind.orderBy("node_id")))
    return out.withColumn("_at_last", whole(family) - F.col("_at") + 1).withColumn("_at_last_type", whole(kind) - F.col("_at_type") + 1)


def _nth_column(place: str, text: str) -> Column:
    a, b = map(int, _nth(text))
    at = F.col({"": "_at", "last": "_at_last", "type": "_at_type", "last_type": "_at_last_type"}[place])
    return at == b if a == 0 else ((at - b) % a == 0) & ((at - b) / a >= 0)


def _attribute_test(part: dict) -> Column:
    have = F.coalesce(attribute(part["attr"]), attribute(part["attr"].lower()))
    if part["op"] is None:
        return have.isNotNull()
    want = next(part[k] for k in ("q", "s", "w") if part[k] is not None)
    if part["flag"]:
        have, want = F.lower(have), want.lower()
    lit = F.lit(want)
    found = {
        "=": have == lit, "~=": F.array_contains(F.split(have, r"\s+"), want) if want.strip() else F.lit(False), "|=": (have == lit) | F.startswith(have, F.lit(want + "-")),
        "^=": F.startswith(have, lit), "$=": F.endswith(have, lit), "*=": F.contains(have, lit),
    }[part["op"]]
    return F.coalesce(found & F.lit(bool(want) or part["op"] in ("=", "~=", "|=")), F.lit(False))


class _Pass:
    """Selectors taken apart into columns, and the rounds of windows that the columns need."""

    def __init__(self, nodes: DataFrame):
        self.df, self.made, self.no = nodes, {}, 0

    def name(self) -> str:
        self.no += 1
        return f"_s{self.no}"

    def test(self, part: dict, argument: str | None) -> Column:
        """A simple selector as a condition on the row."""
        if part["tag"]:
            return F.lower("tag") == part["tag"].lower()
        if part["id"]:
            return F.coalesce(attribute("id") == part["id"], F.lit(False))
        if part["cls"]:
            return F.coalesce(F.array_contains(class_tokens(attribute("class")), part["cls"]), F.lit(False))
        if part["attr"]:
            return _attribute_test(part)
        pseudo = part["pseudo"]
        if pseudo is None:
            return F.lit(True)
        if pseudo in ("not", "is", "where", "matches"):
            any_of = reduce(or_, [F.col(self.made[repr(chain)]) for chain in compiled(argument)])
            return ~any_of if pseudo == "not" else any_of
        if pseudo == "has":
            return F.coalesce(F.col(self.made["has", argument]) <= F.col("last_desc"), F.lit(False))
        if pseudo == "empty":
            return F.coalesce(F.col("_content") > F.col("last_desc"), F.lit(True))
        if pseudo == "root":
            return (F.col("depth") == 1) & (F.col("tree_id") == 0)
        if pseudo in _HAVE:
            return attribute(pseudo).isNotNull()
        if pseudo.startswith("only-"):
            of_type = "_type" if pseudo.endswith("of-type") else ""
            return (F.col(f"_at{of_type}") == 1) & (F.col(f"_at_last{of_type}") == 1)
        if pseudo in _NTH:
            return _nth_column(*_NTH[pseudo])
        if pseudo.startswith("nth-"):
            place = ("last" if pseudo.startswith("nth-last-") else "") + ("_type" if pseudo.endswith("of-type") else "")
            return _nth_column(place.strip("_") if place == "_type" else place, argument)
        raise ValueError(f"not a selector over rows: :{pseudo}")

    def inner(self, chains: Iterable[tuple]) -> list[str]:
        """Arguments of functional pseudo-classes in some chains."""
        return [(p["pseudo"], a) for chain in chains for _, parts in chain for p, a in parts if p["pseudo"] in ("not", "is", "where", "matches", "has")]

    def add(self, chains: list[tuple]) -> None:
        """Makes a column for each chain, all of them in the same rounds."""
        chains = list({repr(c): c for c in chains if repr(c) not in self.made}.values())
        if not chains:
            return
        nested = self.inner(chains)
        self.add([c for _, a in nested for c in compiled(a)])
        has = [a for a in dict.fromkeys(a for p, a in nested if p == "has") if ("has", a) not in self.made]
        if has:
            later = W.partitionBy(*TREE).orderBy("node_id").rowsBetween(1, W.unboundedFollowing)
            for a in has:
                self.made["has", a] = self.name()
            next_of = lambda a: F.min(F.when(reduce(or_, [F.col(self.made[repr(c)]) for c in compiled(a)]), F.col("node_id"))).over(later)
            self.df = self.df.select("*", *[next_of(a).alias(self.made["has", a]) for a in has])
        own = {(i, k): self.name() for i, chain in enumerate(chains) for k in range(len(chain))}
        tests = {(i, k): reduce(and_, [self.test(p, a) for p, a in chains[i][k][1]]) for i, k in own}
        self.df = self.df.select("*", *[tests[x].alias(n) for x, n in own.items()])
        state = {i: own[i, 0] for i in range(len(chains))}
        for k in range(1, max(map(len, chains))):
            self.step({i: (chains[i][k][0], state[i], own[i, k]) for i in state if k < len(chains[i])}, state)
        self.made |= {repr(chain): state[i] for i, chain in enumerate(chains)}

    def step(self, asked: dict[int, tuple[str, str, str]], state: dict[int, str]) -> None:
        """One combinator further: of the elements that pass on their own, those whose ancestor, parent or sibling has passed."""
        new = {i: self.name() for i in asked}
        false = F.lit(False)
        below, beside = W.partitionBy(*TREE).orderBy("node_id"), W.partitionBy(*TREE, "parent_id").orderBy("node_id")
        before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
        made = {}
        for i, (how, passed, own) in asked.items():
            if how == " ":
                made[i] = F.max(F.when(F.col(passed), F.col("last_desc"))).over(before(below)) >= F.col("node_id")
            elif how == "+":
                made[i] = F.lag(passed).over(beside)
            elif how == "~":
                made[i] = F.max(passed).over(before(beside))
        if made:
            self.df = self.df.select("*", *[F.coalesce(F.col(asked[i][2]) & c, false).alias(new[i]) for i, c in made.items()])
        children = {i: (passed, own) for i, (how, passed, own) in asked.items() if how == ">"}
        if children:
            # each element once as a child under its parent's number, and once as what its own number stands for
            flags = list(dict.fromkeys(p for p, _ in children.values()))
            roles = F.array(
                F.struct(F.col("parent_id").alias("_key"), F.lit(True).alias("_child"), *[F.lit(None).cast("boolean").alias(f"_p{f}") for f in flags]),
                F.struct(F.col("node_id").alias("_key"), F.lit(False).alias("_child"), *[F.col(f).alias(f"_p{f}") for f in flags]),
            )
            two = self.df.select("*", F.inline(roles)).where(F.col("_child") | reduce(or_, [F.col(f"_p{f}") for f in flags]))
            family = W.partitionBy(*TREE, "_key")
            two = two.select("*", *[F.coalesce(F.max(f"_p{f}").over(family), false).alias(f"_q{f}") for f in flags]).where("_child")
            two = two.select("*", *[(F.col(own) & F.col(f"_q{p}")).alias(new[i]) for i, (p, own) in children.items()])
            self.df = two.drop("_key", "_child", *[f"_p{f}" for f in flags], *[f"_q{f}" for f in flags])
        state |= new


def matching(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """The element rows of ``nodes`` with a boolean column for each selector, named as given.

    Selectors are those of ``functions.selectors`` but ``:contains``: tags, ids,
    classes, attributes, ``:not``, ``:is``, ``:has``, ``:empty``, ``:root``, positions,
    and the four combinators.  Each tree is searched by itself, template contents,
    too.  A selector that can't be read is a ValueError.
    """
    chains = {name: compiled(s) for name, s in selectors.items()}
    used = _uses([c for some in chains.values() for c in some])
    rows = nodes.repartition(*TREE)
    if "empty" in used:
        holds = (F.col("node_type") == ELEMENT) | (F.col("node_type") == TEXT) & (F.length("text") > 0)
        later = W.partitionBy(*TREE).orderBy("node_id").rowsBetween(1, W.unboundedFollowing)
        rows = rows.withColumn("_content", F.min(F.when(holds, F.col("node_id"))).over(later))
    rows = rows.where(F.col("node_type") == ELEMENT)
    if any(x.endswith(("-child", "of-type")) for x in used):
        rows = positions(rows)
    work = _Pass(rows)
    work.add([c for some in chains.values() for c in some])
    return work.df.select(*nodes.columns, *[reduce(or_, [F.col(work.made[repr(c)]) for c in some]).alias(name) for name, some in chains.items()])


def _uses(chains: list[tuple]) -> set[str]:
    found = set()
    for chain in chains:
        for _, parts in chain:
            for p, a in parts:
                if p["pseudo"]:
                    found.add(p["pseudo"])
                    if p["pseudo"] in ("not", "is", "where", "matches", "has"):
                        found |= _uses(list(compiled(a)))
    return found


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The element rows that a selector matches, outside template contents."""
    return matching(nodes.where("tree_id = 0"), {"_match": selector}).where("_match").drop("_match")


def element_index(nodes: DataFrame) -> DataFrame:
    """Postings of elements: kind (tag, id, class, attribute), key, and the element's place; one row for each, to be stored sorted by kind and key."""
    e = nodes.where(F.col("node_type") == ELEMENT)
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    classes = F.transform(F.coalesce(class_tokens(attribute("class")), F.array().cast("array<string>")), lambda c: entry("class", c))
    names = F.transform("attrs", lambda a: entry("attribute", a["name"]))
    ids = F.when(attribute("id").isNotNull(), F.array(entry("id", attribute("id")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))
    return e.select(F.inline(F.concat(F.array(entry("tag", F.col("tag"))), ids, classes, names)), *TREE, "node_id", "parent_id", "depth", "last_desc")


def find(index: DataFrame, kind: str, key: str) -> DataFrame:
    """Elements with a tag, id, class or attribute, from the index."""
    return index.where((F.col("kind") == kind) & (F.col("key") == key)).drop("kind", "key")
