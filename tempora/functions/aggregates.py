"""Aggregate functions over samples or over rollup rows.

Six primitives can be merged; the other functions are computed from them. Whatever is asked for, each primitive that is needed
is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMITIVES = ("count", "sum", "sqr", "max", "min", "last")
NEEDS = {**{p: (p,) for p in PRIMITIVES}, "avg": ("count", "sum"), "stddev": ("count", "sum", "sqr"), "stdvar": ("count", "sum", "sqr"), "rate": ("last",)}
ALL = "_all"


def parse_functions(text: str) -> list[str]:
    """A comma list with blanks skipped; '*' stands for all primitives."""
    found: list[str] = []
    for name in filter(None, (x.strip() for x in text.split(","))):
        for f in PRIMITIVES if name == "*" else (name,):
            if f not in NEEDS:
                raise ValueError(f"unknown aggregate function {f!r}")
            if f not in found:
                found.append(f)
    return found


def stored(functions: list[str]) -> list[str]:
    """The primitives that a table must keep for these functions; count is always one of them."""
    need = {"count"} | {p for f in functions for p in NEEDS[f]}
    return [p for p in PRIMITIVES if p in need]


def parse_label_sets(text: str) -> list[list[str]]:
    """'a,b;c' as lists of label names."""
    return [sorted(x.strip() for x in part.split(",") if x.strip()) for part in text.split(";") if part.strip()]


def split_function(name: str) -> tuple[str, bool]:
    """A function without its suffix, and whether that said to aggregate across series."""
    across = name.endswith(ALL)
    base = name.removesuffix(ALL)
    if base not in NEEDS:
        raise ValueError(f"unknown aggregate function {name!r}")
    return base, across


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def over_samples(primitive: str, given: Column, v: Column, order: Column) -> Column:
    """A primitive over raw samples where `given` holds; nothing there gives null."""
    x = F.when(given, v)
    return {
        "count": lambda: F.sum(F.when(given, F.lit(1).cast("long"))),
        "sum": lambda: F.sum(x),
        "sqr": lambda: F.sum(x * x),
        "max": lambda: F.max(x),
        "min": lambda: F.min(x),
        "last": lambda: F.max_by(x, F.when(x.isNotNull(), order)),
    }[primitive]()


def over_rollups(primitive: str, given: Column) -> Column:
    """A primitive merged from rollup rows where `given` holds."""
    x = F.when(given, F.col(primitive))
    if primitive in ("max", "min"):
        return getattr(F, primitive)(x)
    if primitive == "last":
        return F.max_by(x, F.when(x.isNotNull(), F.struct("last_t", "lset")))
    return F.sum(x)


def derived(function: str, part: dict[str, Column]) -> Column:
    """A function from its primitives."""
    if function in PRIMITIVES:
        return part[function]
    n, total = part["count"], part["sum"] if "sum" in part else None
    if function == "avg":
        return total / n
    if function in ("stddev", "stdvar"):
        variance = F.when(n > 1, F.greatest(n * part["sqr"] - total * total, F.lit(0.0)) / (n * (n - 1)))
        return F.sqrt(variance) if function == "stddev" else variance
    raise ValueError(f"{function} isn't computed within a cell")
