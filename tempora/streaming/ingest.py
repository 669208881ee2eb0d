"""Streams of samples into a table, and the last-time rule as a stateful operator."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempora.sources import samples as canonical
from tempora.sources.table import Table


#: How long to wait for a stream to be drained.
DRAIN_SECONDS = 24 * 3600
#: Groups over which the last-time rule deals series; a checkpoint holds for one number.
SERIES_GROUPS = 512
_STATE = pa.schema([("metric", pa.string()), ("lset", pa.string()), ("last", pa.int64()), ("known", pa.bool_())])


def into_table(stream: DataFrame, table: Table, checkpoint: str, override: bool = False, tries: int = 3, **trigger: object) -> StreamingQuery:
    """Appends each micro-batch to the table.

    A batch that comes again after a failure changes nothing: its samples aren't later than those that the table has by then, and
    a batch that failed has left nothing behind. One that fails is tried `tries` times, but for samples that can't be stored.
    `trigger` is what writeStream.trigger takes; the default empties what is there and ends. How much a batch takes is the
    source's to say: maxFilesPerTrigger or maxBytesPerTrigger for `events_stream`.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        for left in reversed(range(tries)):
            try:
                return table.append(batch, override)
            except ValueError:
                raise
            except Exception:
                if not left:
                    raise

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drained(query: StreamingQuery, seconds: float = DRAIN_SECONDS) -> bool:
    """Waits until all that the stream has is in the table; False if that takes longer. A stream that fails raises its error."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if not query.isActive:
            if (error := query.exception()) is not None:
                raise error
            return True
        status = query.status
        if query.lastProgress and not status["isDataAvailable"] and not status["isTriggerActive"]:
            return True
        time.sleep(0.05)
    return not query.isActive


def monotonic(stream: DataFrame) -> DataFrame:
    """The samples of a stream that are later than all before them of their series; the state is the last time and whether the series is numeric.

    Within a micro-batch samples are taken in order of time, and of those at one time the first. Samples of the other type than
    the series has are dropped. Series are dealt over a fixed number of groups whose rows are judged together: a call for each
    series would cost more than its few samples. The state of a group is a row for each of its series.
    """
    series = ["metric", "lset"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values("t_ms", kind="stable").drop_duplicates([*series, "t_ms"])
        known = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame({"metric": [], "lset": [], "last": [], "known": []})
        known = known.astype({"metric": object, "lset": object, "last": "int64", "known": bool})
        found = rows[[*series, "t_ms"]].merge(known, "left", series)  # in the order of the rows
        later = rows["t_ms"].to_numpy() > found["last"].fillna(-1).astype("int64").to_numpy()
        rows, found = rows[later], found[later]
        number = rows["s"].isna().to_numpy()
        first = found.assign(number=number).groupby(series, dropna=False, sort=False)["number"].transform("first")
        kept = number == found["known"].where(found["known"].notna(), first).astype(bool).to_numpy()
        rows, found = rows[kept], found[kept]
        if len(rows):
            new = found[series].assign(last=rows["t_ms"].to_numpy(), known=number[kept])
            table = pa.Table.from_pandas(pd.concat([known, new]).drop_duplicates(series, keep="last"), _STATE, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _STATE) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            yield rows[list(canonical.COLUMNS)]

    group = F.pmod(F.xxhash64(*series), F.lit(SERIES_GROUPS)).alias("group")
    return stream.select(*canonical.COLUMNS, group).groupBy("group").applyInPandasWithState(step, canonical.SCHEMA, "series binary", "append", GroupStateTimeout.NoTimeout)


def events_stream(spark: SparkSession, path: str, schema: object, **options: str) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)
