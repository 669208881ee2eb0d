"""What a series is worth between two samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERPOLATORS = ("none", "nan", "prev_val", "next_val", "linear")


def parse_interpolator(name: str | None) -> str:
    name = (name or "none").strip().lower()
    name = {"lin": "linear", "prev": "prev_val", "next": "next_val"}.get(name, name)
    if name not in INTERPOLATORS:
        raise ValueError(f"unknown interpolator {name!r}")
    return name


def between(name: str, g: Column, t0: Column, v0: Column, t1: Column, v1: Column, tolerance: int) -> Column:
    """The value at g of a series whose samples around it are (t0, v0), perhaps null, and (t1, v1)."""
    before, after = t0.isNotNull() & (g - t0 <= tolerance), t1 - g <= tolerance
    if name == "none":
        return v1
    if name == "nan":
        return F.lit(float("nan"))
    if name == "prev_val":
        return F.when(before, v0)
    if name == "next_val":
        return F.when(after, v1)
    return F.when(before & after, F.when(F.isnan(v0) | F.isnan(v1), float("nan")).otherwise(v0 + (v1 - v0) * (g - t0) / (t1 - t0)))


def interpolate(name: str, g: int, t0: int, v0: float, t1: int, v1: float, tolerance: int) -> tuple[int, float] | None:
    """The same for plain numbers: the time and value, or None."""
    nan = float("nan")
    if name == "none":
        return t1, v1
    if name == "nan":
        return g, nan
    if name == "prev_val":
        return (g, v0) if g - t0 <= tolerance else None
    if name == "next_val":
        return (g, v1) if t1 - g <= tolerance else None
    if g - t0 > tolerance or t1 - g > tolerance:
        return None
    return g, nan if v0 != v0 or v1 != v1 else v0 + (v1 - v0) * (g - t0) / (t1 - t0)
