"""The filter language over labels and metric names, as a Column.

    expr := or;  or := and ('or' and)*;  and := not ('and' not)*;  not := 'not' not | '(' expr ')' | test
    test := operand (== | = | != | <> | < | <= | > | >=) operand | starts(name, 'text') | exists(name) | name [not] in ('a', 'b')
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_.:]*)|(?P<sign>==|!=|<>|<=|>=|[=<>(),]))")
_METRIC = ("__name__", "_name")
_COMPARE = {"==": "__eq__", "=": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise ValueError(f"can't read the filter at {text[at:]!r}")
        kind, at = m.lastgroup or "", m.end()
        out.append((kind, m[kind]))
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Takes the next token if it is one of these, in any letter case."""
        if self.peek()[0] in ("name", "sign") and self.peek()[1].lower() in words:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.word(sign):
            raise ValueError(f"the filter lacks {sign!r} before {self.peek()[1]!r}")

    def any_of(self) -> Column:
        left = self.all_of()
        while self.word("or"):
            left = left | self.all_of()
        return left

    def all_of(self) -> Column:
        left = self.negated()
        while self.word("and"):
            left = left & self.negated()
        return left

    def negated(self) -> Column:
        if self.word("not"):
            return ~self.negated()
        if self.word("("):
            inner = self.any_of()
            self.need(")")
            return inner
        return self.test()

    def literal(self) -> str:
        kind, text = self.peek()
        if kind not in ("text", "number"):
            raise ValueError(f"the filter needs a value before {text!r}")
        self.at += 1
        return text[1:-1].replace(text[0] * 2, text[0]) if kind == "text" else text

    def operand(self) -> tuple[Column, str]:
        kind, text = self.peek()
        if kind == "name":
            self.at += 1
            return attribute(text), "name"
        return F.lit(self.literal()), kind

    def test(self) -> Column:
        kind, text = self.peek()
        if kind == "name" and text.lower() in ("starts", "exists") and self.tokens[self.at + 1 : self.at + 2] == [("sign", "(")]:
            self.at += 2
            name = attribute(self.peek()[1])
            self.at += 1
            if text.lower() == "exists":
                self.need(")")
                return name.isNotNull()
            self.need(",")
            prefix = self.literal()
            self.need(")")
            return F.coalesce(name.startswith(prefix), F.lit(False))
        left, left_kind = self.operand()
        inverted = self.word("not")
        if self.word("in"):
            self.need("(")
            values = [self.literal()]
            while self.word(","):
                values.append(self.literal())
            self.need(")")
            found = F.coalesce(left.isin(values), F.lit(False))
            return ~found if inverted else found
        sign = self.peek()[1]
        if inverted or sign not in _COMPARE:
            raise ValueError(f"the filter needs a comparison before {sign!r}")
        self.at += 1
        right, right_kind = self.operand()
        if "number" in (left_kind, right_kind) and "text" not in (left_kind, right_kind):
            left, right = left.try_cast("double"), right.try_cast("double")
        return F.coalesce(getattr(left, _COMPARE[sign])(right), F.lit(sign in ("!=", "<>")))


def attribute(name: str) -> Column:
    return F.col("metric") if name in _METRIC else F.col("labels")[name]


def parse_filter(text: str | None) -> Column | None:
    """The filter as a Column over metric and labels; none for empty text. A label that a series lacks equals nothing."""
    if not (text or "").strip():
        return None
    parser = _Parser(text or "")
    out = parser.any_of()
    if parser.peek()[0] != "end":
        raise ValueError(f"the filter goes on after its end with {parser.peek()[1]!r}")
    return out
