"""Answers as text, CSV or JSON. Rows come from the executors one partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.labels import format_labels
from tempora.functions.times import format_time

FORMATS = ("text", "csv", "json", "none")


def _series(answer: DataFrame) -> Iterator[tuple[str, dict, str, list]]:
    """metric, labels, aggregate and [(time, value)] of each series of an answer in long form."""
    rows = answer.orderBy("metric", "lset", "aggregate", "time").toLocalIterator(prefetchPartitions=True)
    for (metric, _, aggregate), own in groupby(rows, key=lambda r: (r["metric"], r["lset"], r["aggregate"])):
        points = list(own)
        yield metric, points[0]["labels"] or {}, aggregate, [(r["time"], r["value"]) for r in points]


def _labels(labels: dict, aggregate: str) -> dict:
    return labels | ({"Aggregate": aggregate} if aggregate else {})


def to_text(answer: DataFrame) -> Iterator[str]:
    for metric, labels, aggregate, points in _series(answer):
        yield f"Name: {metric}  Labels: {format_labels(_labels(labels, aggregate))}"
        for t, v in points:
            yield f"  {format_time(t)}  v={v if isinstance(v, str) else format(v, '.2f')}"
        yield ""


def to_csv(answer: DataFrame) -> Iterator[str]:
    for metric, labels, aggregate, points in _series(answer):
        text = format_labels(_labels(labels, aggregate)).replace('"', '""')
        for t, v in points:
            value = '"' + v.replace('"', '""') + '"' if isinstance(v, str) else format(v, ".6f")
            yield f'{metric},"{text}",{value},{t}'


def to_json(answer: DataFrame) -> Iterator[str]:
    """An array of {target, datapoints: [[value, time], ...]}."""
    yield "["
    comma = ""
    for metric, labels, aggregate, points in _series(answer):
        own = _labels(labels, aggregate)
        target = metric + (f"{{{format_labels(own)}}}" if own else "")
        yield comma + json.dumps({"target": target, "datapoints": [[None if v != v else v, t] for t, v in points]})
        comma = ","
    yield "]"


def to_nothing(answer: DataFrame) -> Iterator[str]:
    yield f"{answer.select('lset').distinct().count()} label sets"


def lines(answer: DataFrame, format_: str) -> Iterator[str]:
    makers = {"text": to_text, "csv": to_csv, "json": to_json, "none": to_nothing}
    if format_ not in makers:
        raise ValueError(f"unknown format {format_!r}; choose from {', '.join(FORMATS)}")
    return makers[format_](answer)


def json_frame(answer: DataFrame) -> DataFrame:
    """The JSON objects as a column, for sinks that write from the executors."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("time", "value"))), lambda p: F.array(p["value"], p["time"].cast("double")))
    return answer.groupBy("metric", "lset", "aggregate").agg(points.alias("datapoints")).select(F.to_json(F.struct(F.concat_ws("", "metric", F.lit("{"), "lset", F.lit("}")).alias("target"), "datapoints")).alias("json"))


def nan_compatible(answer: DataFrame) -> DataFrame:
    """Nulls as NaN in number columns and as empty text in text columns."""
    return answer.select(*[F.coalesce(F.col(f"`{n}`"), F.lit(float("nan"))).alias(n) if t == "double" else F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in answer.dtypes])
