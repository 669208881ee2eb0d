"""Metric names, labels and label sets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_METRIC = re.compile(r"[A-Za-z_:][A-Za-z0-9_:]*")
_LABEL = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
NAME = "__name__"
_SIGNS, _ESCAPED = r"([,=\\])", r"\\\1"


def check_metric(name: str) -> str:
    if not _METRIC.fullmatch(name or ""):
        raise ValueError(f"not a metric name: {name!r}")
    return name


def check_label(name: str) -> str:
    if not _LABEL.fullmatch(name or ""):
        raise ValueError(f"not a label name: {name!r}")
    return name


def valid_metric(column: Column) -> Column:
    return column.rlike(f"^{_METRIC.pattern}$")


def parse_labels(text: str | None) -> dict[str, str]:
    """'k1=v1,k2=v2' as a dict in order of the names."""
    found: dict[str, str] = {}
    for pair in filter(None, (p.strip() for p in (text or "").split(","))):
        if pair.count("=") != 1:
            raise ValueError(f"not a label: {pair!r}; give name=value")
        name, value = pair.split("=")
        if name in found:
            raise ValueError(f"label {name!r} comes twice")
        found[check_label(name)] = value
    return dict(sorted(found.items()))


def format_labels(labels: dict[str, str]) -> str:
    return ",".join(f"{k}={re.sub(_SIGNS, _ESCAPED, v)}" for k, v in sorted(labels.items()))


def filter_labels(labels: dict[str, str], names: list[str]) -> dict[str, str]:
    return {k: v for k, v in sorted(labels.items()) if k in set(names)}


def compare_labels(a: dict[str, str], b: dict[str, str]) -> int:
    x, y = sorted(a.items()), sorted(b.items())
    return (x > y) - (x < y)


def lset(labels: Column) -> Column:
    """The canonical text of a label map; a backslash goes before a comma, an equals sign or a backslash of a value."""
    # sorted by the type's own order and escaped without a pattern: this is done for every sample that comes in
    return F.array_join(F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), _escaped(e["value"]))), ",")


def _escaped(value: Column) -> Column:
    for sign in ("\\", ",", "="):
        value = F.replace(value, F.lit(sign), F.lit("\\" + sign))
    return value


def lset_of(labels: Column, names: list[str]) -> Column:
    """The canonical text of some labels of a map that has them all, without looking at the others: plain string functions, which stay in generated code."""
    parts = [F.concat(F.lit(f"{n}="), _escaped(labels[n])) for n in sorted(names)]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def labels_from_text(column: Column) -> Column:
    """A label map from 'k=v,k=v'; empty text is no label."""
    text = F.trim(F.coalesce(column, F.lit("")))
    pairs = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value"))))


def subset(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else F.map_filter(labels, lambda k, _: F.lit(False))
