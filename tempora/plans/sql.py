"""The SQL dialect: SELECT items FROM table WHERE filter GROUP BY labels.

item := metric | * | interpolator(metric[, 'tolerance']) | function(metric | * | interpolator(metric[, 'tolerance'])), each with
[AS alias]. Times and steps aren't part of it. What the dialect lacks is an error rather than ignored.
"""

from __future__ import annotations

import re

from tempora.functions.aggregates import ALL, NEEDS
from tempora.functions.interpolate import parse_interpolator
from tempora.functions.times import parse_duration
from tempora.plans.spec import Column

_CLAUSES = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\b(from|where|group\s+by|having|order\s+by|limit|union|intersect|except|join|distinct|over)\b", re.IGNORECASE)
_ITEM = re.compile(r"(?P<expr>.+?)(?:\s+as\s+(?P<alias>`[^`]+`|\"[^\"]+\"|[A-Za-z_][\w:]*))?", re.IGNORECASE | re.DOTALL)
_CALL = re.compile(r"(?P<name>[A-Za-z_]\w*)\s*\((?P<inner>.*)\)", re.DOTALL)
_NAME = re.compile(r"`(?P<quoted>[^`]+)`|(?P<plain>[A-Za-z_:][\w:]*)")


def _clauses(text: str) -> dict[str, str]:
    m = re.fullmatch(r"\s*select\s+(.*?);?\s*", text, re.IGNORECASE | re.DOTALL)
    if not m:
        raise ValueError("only SELECT is known")
    body, out, at, key = m[1], {}, 0, "select"
    for c in _CLAUSES.finditer(body):
        if not c[1]:
            continue
        word = re.sub(r"\s+", " ", c[1].lower())
        if word not in ("from", "where", "group by"):
            raise ValueError(f"{word.upper()} isn't supported")
        if word in out or word == key:
            raise ValueError(f"{word.upper()} comes twice")
        out[key], at, key = body[at : c.start()].strip(), c.end(), word
    out[key] = body[at:].strip()
    if any(not v for v in out.values()):
        raise ValueError("an empty clause")
    return out


def _split(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, at, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                raise ValueError("a bracket too many")
        elif c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    if depth or quote:
        raise ValueError("an open bracket or quote")
    return [*out, text[at:].strip()]


def _metric(text: str) -> str:
    if text == "*":
        return "*"
    if not (m := _NAME.fullmatch(text)):
        raise ValueError(f"not a metric: {text!r}")
    return m["quoted"] or m["plain"]


def _item(text: str) -> Column:
    m = _ITEM.fullmatch(text)
    if not m or not text:
        raise ValueError(f"can't read {text!r}")
    expr, alias = m["expr"].strip(), (m["alias"] or "").strip('`"')
    call = _CALL.fullmatch(expr)
    if not call:
        return Column(_metric(expr), alias=alias)
    name, function = call["name"].lower(), ""
    inner = call["inner"].strip()
    if name.removesuffix(ALL) in NEEDS:
        function, call = name, _CALL.fullmatch(inner)
        if not call:
            return Column(_metric(inner), function, alias)
        name = call["name"].lower()
    interpolator = parse_interpolator(name)
    args = _split(call["inner"].strip())
    if len(args) > 2 or len(args) == 2 and not re.fullmatch(r"'[^']*'", args[1]):
        raise ValueError(f"{name} takes a metric and a tolerance in quotes")
    return Column(_metric(args[0]), function, alias, interpolator, parse_duration(args[1].strip("'")) if len(args) == 2 else 0)


def parse_select(text: str) -> tuple[list[Column], str, str, list[str]]:
    """Columns, table, filter and labels to group by."""
    parts = _clauses(text)
    columns = [_item(x) for x in _split(parts["select"])]
    table = parts.get("from", "")
    if table and not _NAME.fullmatch(table):
        raise ValueError("FROM takes one table")
    groups = [x for x in _split(parts["group by"])] if "group by" in parts else []
    for g in groups:
        if not re.fullmatch(r"[A-Za-z_]\w*", g):
            raise ValueError(f"GROUP BY takes labels, not {g!r}")
    for i, c in enumerate(columns):
        if c.wildcard and c.alias:
            raise ValueError("all metrics can't share an alias")
        if any(o.name == c.name for o in columns[:i]) or c.alias and any(c.alias == o.metric for o in columns if o is not c):
            raise ValueError(f"column {c.name!r} isn't clear")
    return columns, "" if table.lower() == "dual" else table.strip("`"), parts.get("where", ""), groups
