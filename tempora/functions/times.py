"""Durations, times and rates as text, and the arithmetic of cells, chunks and partitions. All in milliseconds."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
_UNITS = {"s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}
_DURATION = re.compile(r"([0-9]+)([smhd]?)")
_RATE = re.compile(r"([0-9]+)/([smh])")


def parse_duration(text: str | None) -> int:
    """'10m' and the like; a bare number means hours, nothing means 0."""
    text = (text or "").strip()
    if not text:
        return 0
    if not (m := _DURATION.fullmatch(text)):
        raise ValueError(f"not a duration: {text!r}; give a number with s, m, h or d")
    return int(m[1]) * _UNITS[m[2] or "h"]


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def parse_time(text: str, now: int | None = None) -> int:
    """'now', 'now-1h', 'now+5m', Unix milliseconds or RFC 3339."""
    text = text.strip()
    now = now_ms() if now is None else now
    if text == "now":
        return now
    if text[:3] == "now" and text[3:4] in ("+", "-"):
        shift = parse_duration(text[4:])
        return now + shift if text[3] == "+" else now - shift
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"not a time: {text!r}; give now, now-<duration>, milliseconds or RFC 3339") from e
    if at.tzinfo is None:
        raise ValueError(f"not a time: {text!r} has no zone")
    return int((at - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1000 + 0.5)


def format_time(ms: int) -> str:
    """RFC 3339 in UTC."""
    at = datetime.fromtimestamp(ms // 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return at + (f".{ms % 1000:03d}".rstrip("0") if ms % 1000 else "") + "Z"


def resolve_range(start: str = "", stop: str = "", last: str = "", step: str = "", now: int | None = None) -> tuple[int, int, int]:
    """from, to and step; the last hour unless said otherwise, and `last` goes before a start."""
    now = now_ms() if now is None else now
    to = parse_time(stop, now) if stop else now
    begin = to - parse_duration(last) if last else parse_time(start, now) if start else to - HOUR
    return begin, to, parse_duration(step)


def parse_rate(text: str) -> int:
    """Samples an hour of '1/s', '12/m' or '2/h'."""
    if not (m := _RATE.fullmatch((text or "").strip())):
        raise ValueError(f"not a rate: {text!r}; give <number>/<s, m or h>")
    if not int(m[1]):
        raise ValueError("the rate must be above 0")
    return int(m[1]) * (HOUR // _UNITS[m[2]])


def cells(start: int, stop: int, step: int) -> int:
    """Cells of a grid; the last one may hold only samples at `stop` itself."""
    return (stop - start) // step + 1


def partition_start(t: int, interval: int) -> int:
    return t // interval * interval


def partition_range(start: int, stop: int, interval: int) -> range:
    """Starts of the partitions that a time range touches."""
    return range(partition_start(start, interval), stop + 1, interval)


def chunk_of(t: int, partition: int, chunk: int) -> int:
    """The number of a chunk in its partition, from 1 on."""
    return (t - partition) // chunk + 1


def bucket_of(t: int, granularity: int) -> int:
    return t // granularity * granularity
