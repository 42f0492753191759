"""Tag expressions: text to Column predicates over an array of (k, v)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that make a closed way an area (fixed values).
AREA_KEYS = ("building", "landuse", "natural", "leisure", "amenity", "boundary", "waterway")


@dataclass(frozen=True)
class Expression:
    """One parsed expression: the kinds it speaks of, and a test of single tags."""

    kinds: frozenset[str]
    op: str  # key, prefix, equals, any, differs
    key: str
    values: tuple[str, ...] = ()

    def tag_test(self, t: Column) -> Column:
        k, v = t["k"], t["v"]
        if self.op == "key":
            return k == self.key
        if self.op == "prefix":
            return k.startswith(self.key)
        if self.op == "equals":
            return (k == self.key) & (v == self.values[0])
        if self.op == "any":
            return (k == self.key) & v.isin(*self.values)
        return (k == self.key) & (v != self.values[0])


def parse(text: str) -> Expression:
    """``[nwr]*/key``, ``key=value``, ``key=a,b``, ``key!=value`` (the key must exist), ``prefix:*``."""
    text = text.strip()
    kinds, rest = frozenset("nwr"), text
    head, slash, tail = text.partition("/")
    if slash and head and set(head) <= set("nwr"):
        kinds, rest = frozenset(head), tail
    if not rest:
        raise ValueError(f"empty tag expression: {text!r}")
    key, differs, value = rest.partition("!=")
    if differs:
        return _made(kinds, "differs", key, (value,), text)
    key, equals, value = rest.partition("=")
    if equals:
        values = tuple(value.split(",")) if "," in value else (value,)
        return _made(kinds, "any" if len(values) > 1 else "equals", key, values, text)
    if rest.endswith(":*"):
        return _made(kinds, "prefix", rest[:-1], (), text)
    return _made(kinds, "key", rest, (), text)


def _made(kinds: frozenset[str], op: str, key: str, values: tuple[str, ...], text: str) -> Expression:
    if not key:
        raise ValueError(f"tag expression without a key: {text!r}")
    return Expression(kinds, op, key, values)


def parse_lines(text: str) -> list[Expression]:
    """One expression a line; ``#`` starts a comment, empty lines are skipped."""
    lines = (line.split("#", 1)[0].strip() for line in text.splitlines())
    return [parse(line) for line in lines if line]


def matches(expressions: list[Expression | str], kind: str, tags: str | Column = "tags") -> Column:
    """Whether an element of ``kind`` has a tag that meets one of the expressions that speak of its kind."""
    mine = [e for e in (parse(x) if isinstance(x, str) else x for x in expressions) if kind in e.kinds]
    if not mine:
        return F.lit(False)
    return F.exists(tags, lambda t: reduce(lambda a, b: a | b, [e.tag_test(t) for e in mine]))


def tag_value(key: str, tags: str | Column = "tags") -> Column:
    """The value of the first tag with this key, or null."""
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def is_area(tags: str | Column = "tags") -> Column:
    """Whether tags make a closed way an area: ``area=no`` rules it out, else ``area=yes`` or an area key."""
    no = F.exists(tags, lambda t: (t["k"] == "area") & (t["v"] == "no"))
    yes = F.exists(tags, lambda t: ((t["k"] == "area") & (t["v"] == "yes")) | t["k"].isin(*AREA_KEYS))
    return ~no & yes
