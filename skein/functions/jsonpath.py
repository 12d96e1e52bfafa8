"""Paths into JSON values: $, .field, [n], [*]; filter rules over what they lead to; and values as text.

A path is compiled once to a chain of selectors, each from one value to those it leads to, and a rule to a predicate.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from types import NoneType
from typing import Any

STEP = re.compile(r"\.(?P<name>[^.\[\]]+)|\[(?P<place>\d+)\]|\[(?P<every>\*)\]")
JOINER = "、"

Selector = Callable[[Any], Iterator]


def by_name(name: str) -> Selector:
    return lambda v: iter((v[name],) if isinstance(v, dict) and name in v else ())


def by_place(place: int) -> Selector:
    return lambda v: iter(v[place : place + 1] if isinstance(v, list) else ())


def every(value: Any) -> Iterator:
    return iter(value.values() if isinstance(value, dict) else value if isinstance(value, list) else ())


@lru_cache(maxsize=1024)
def parse(path: str) -> tuple[str | int, ...]:
    """Steps of a path: field names, indexes, and ... for every item."""
    rest = path.strip()
    if not rest.startswith("$"):
        rest = rest if rest[:1] in ("", ".", "[") else f".{rest}"
    rest = rest.removeprefix("$")
    found = list(STEP.finditer(rest))
    if "".join(m[0] for m in found) != rest:
        raise ValueError(f"no path: {path!r}")
    kinds = {"name": str, "place": int, "every": lambda _: ...}
    return tuple(kinds[m.lastgroup](m[m.lastgroup]) for m in found)


def selector(steps: tuple) -> Selector:
    """From a value to all that the steps lead to; none where something is missing; a null that is present counts."""
    if not steps:
        return lambda v: iter((v,))
    here = every if steps[0] is ... else by_place(steps[0]) if isinstance(steps[0], int) else by_name(steps[0])
    onward = selector(steps[1:])
    return lambda v: (x for inner in here(v) for x in onward(inner))


def resolve(value: Any, steps) -> list:
    return list(compiled(tuple(steps))(value))


@lru_cache(maxsize=1024)
def compiled(steps: tuple) -> Selector:
    return selector(steps)


# How each type reads, and what it is called.
TEXT: dict[type, Callable[[Any, str], str]] = {
    NoneType: lambda v, _: "",
    bool: lambda v, _: json.dumps(v),
    int: lambda v, _: str(v),
    float: lambda v, _: str(v),
    str: lambda v, _: v,
    list: lambda v, joined: texts(v, joined),
    dict: lambda v, _: json.dumps(v, ensure_ascii=False, sort_keys=True),
}
NAMES = {NoneType: "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}


def as_text(value: Any, joined: str = JOINER) -> str:
    return TEXT[type(value)](value, joined)


def texts(values, joined: str = JOINER) -> str:
    """The values that read as something, joined."""
    return joined.join(filter(None, (as_text(v, joined) for v in values)))


def kind(value: Any) -> str:
    return NAMES[type(value)]


# What each operator asks of the values found; numbers and booleans compare as in Python.
ASKS: dict[str, Callable[[list, Any], bool]] = {
    "equals": lambda found, x: x in found,
    "not_equals": lambda found, x: found != [] and x not in found,
    "in": lambda found, xs: not all(v not in xs for v in found),
    "exists": lambda found, x: (found != []) is x,
}
OPERATORS = tuple(ASKS)
Rule = tuple[str, str, Any]


def check_rule(rule: dict) -> Rule:
    """(path, operator, expected) of a filter rule."""
    used = [o for o in OPERATORS if o in rule]
    if not isinstance(rule.get("path"), str) or len(used) != 1 or set(rule) - {"path", *OPERATORS}:
        raise ValueError(f"a filter has a path and one of {OPERATORS}: {rule!r}")
    op, expected = used[0], rule[used[0]]
    if op == "in" and not (isinstance(expected, list) and expected) or op == "exists" and not isinstance(expected, bool):
        raise ValueError(f"`in` takes a list with items, `exists` a boolean: {rule!r}")
    parse(rule["path"])
    return rule["path"], op, expected


def predicate(rules: list[Rule]) -> Callable[[Any], bool]:
    """Whether all rules hold for a record."""
    tests = [(compiled(parse(path)), ASKS[op], expected) for path, op, expected in rules]
    return lambda record: all(ask(list(select(record)), expected) for select, ask, expected in tests)


def passes(record: Any, rules: list[Rule]) -> bool:
    return predicate(rules)(record)


PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def visit(value: Any, path: str = "$", depth: int = 20) -> Iterator[tuple[str, str]]:
    """(path, kind) of the value and everything in it, parents first; array items share one path."""
    todo = [(path, value, depth)]
    while todo:
        at, v, left = todo.pop()
        yield at, kind(v)
        if left > 0 and isinstance(v, (dict, list)):
            inner = [(f".{k}" if PLAIN_NAME.fullmatch(k) else f"[{json.dumps(k, ensure_ascii=False)}]", x) for k, x in v.items()] if isinstance(v, dict) else [("[*]", x) for x in v]
            todo += [(at + step, x, left - 1) for step, x in reversed(inner)]
