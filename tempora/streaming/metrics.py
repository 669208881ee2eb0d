"""Counters of what a query or a stream has read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that has its samples, series times and bounds once an action has run; no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("samples"), F.min("t_ms").alias("first_t"), F.max("t_ms").alias("last_t"), F.count_if(F.col("s").isNotNull()).alias("text_samples")), seen


class Throughput(StreamingQueryListener):
    """Rows and batches of each stream by its name."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.rows.setdefault(str(event.name or event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        key = str(p.name or p.id)
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
