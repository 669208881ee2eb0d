"""What a query asks for, and the checks before it is planned."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tempora.functions.aggregates import split_function
from tempora.functions.interpolate import parse_interpolator


@dataclass(frozen=True)
class Column:
    """A column of a result: a metric ('' or '*' for all of them), and a function, which may end in _all."""

    metric: str
    function: str = ""
    alias: str = ""
    interpolator: str = ""
    tolerance: int = 0

    @property
    def wildcard(self) -> bool:
        return self.metric in ("", "*")

    @property
    def base(self) -> str:
        return split_function(self.function)[0] if self.function else ""

    @property
    def across(self) -> bool:
        return bool(self.function) and split_function(self.function)[1]

    @property
    def name(self) -> str:
        return self.alias or (f"{self.base}({self.metric or '*'})" if self.function else self.metric or "*")


@dataclass(frozen=True)
class Query:
    start: int
    stop: int
    columns: list[Column]
    step: int = 0
    window: int = 0
    filter: str = ""
    group_by: list[str] = field(default_factory=list)
    rollups: bool = False

    @property
    def kind(self) -> str:
        """raw, sampled, cells, across or mixed."""
        with_function = [c for c in self.columns if c.function]
        if not with_function:
            return "sampled" if self.step else "raw"
        if any(c.across for c in with_function):
            return "across"
        return "cells" if len(with_function) == len(self.columns) else "mixed"


def product(names: str, functions: str, interpolator: str = "next_val") -> list[Column]:
    """Columns of comma lists of metrics and functions, metric by metric."""
    metrics = [x.strip() for x in names.split(",")]
    wanted = [f.strip() for f in functions.split(",") if f.strip()]
    for f in wanted:
        if wanted.count(f) > 1:
            raise ValueError(f"function {f!r} comes twice")
    return [Column(m, f, interpolator=interpolator) for m in metrics for f in (wanted or [""])]


def resolved(query: Query) -> Query:
    """The query with defaults in place; raises ValueError for one that can't be answered.

    Tolerance is two steps as asked for. Aggregates without a step have one as long as the range. A metric has one interpolator
    and one tolerance: the first given holds for all its columns, and different ones are an error.
    """
    if query.stop < query.start:
        raise ValueError("the end of the range is before its start")
    if query.step < 0 or query.window < 0:
        raise ValueError("step and window can't be negative")
    if not query.columns:
        raise ValueError("no columns")
    per_metric: dict[str, tuple[str, int]] = {}
    for c in query.columns:
        if c.wildcard and c.alias:
            raise ValueError("all metrics can't share an alias")
        if c.function:
            split_function(c.function)
        name, tolerance = per_metric.get(c.metric, ("", 0))
        given = parse_interpolator(c.interpolator) if c.interpolator else ""
        if name and given and name != given:
            raise ValueError(f"different interpolators for {c.metric!r}")
        if tolerance and c.tolerance and tolerance != c.tolerance:
            raise ValueError(f"different tolerances for {c.metric!r}")
        per_metric[c.metric] = name or given, tolerance or c.tolerance
    columns = [replace(c, interpolator=per_metric[c.metric][0] or "none", tolerance=per_metric[c.metric][1] or 2 * query.step) for c in query.columns]
    names = [c.name for c in columns]
    for c in columns:
        if names.count(c.name) > 1:
            raise ValueError(f"two columns are named {c.name!r}")
        if c.alias and any(c.alias == o.metric for o in columns if o is not c):
            raise ValueError(f"alias {c.alias!r} is a metric of the query too")
    out = replace(query, columns=columns)
    if out.kind == "across" and not all(c.across for c in columns):
        raise ValueError("either all functions go across series or none")
    if any(c.across and c.base == "rate" for c in columns):
        raise ValueError("rate doesn't go across series")
    if any(c.wildcard for c in columns) and not all(c.wildcard for c in columns):
        raise ValueError("all metrics and single ones can't be mixed")
    if out.kind in ("cells", "across", "mixed") and not out.step:
        if out.stop == out.start:
            raise ValueError("an aggregate over a single instant needs a step")
        out = replace(out, step=out.stop - out.start)
    if out.kind == "mixed" and any(c.base == "rate" for c in columns if c.function) and out.window:
        raise ValueError("rate has no window")
    return out
