"""A table's schema document: how long chunks and partitions are, and what is rolled up."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from tempora.functions.aggregates import PRIMITIVES, parse_functions, parse_label_sets, stored
from tempora.functions.times import DAY, HOUR, parse_duration, parse_rate

# Bytes of a sample, of a chunk at most and at least, and of a partition at most; buckets of a partition at most.
SAMPLE_BYTES, MAX_CHUNK_BYTES, MIN_CHUNK_BYTES, MAX_PARTITION_BYTES = 8, 32_000, 200, 1_700_000
MAX_BUCKETS = 130_000


@dataclass
class Schema:
    rate: int
    chunk_ms: int
    partition_ms: int
    granularity_ms: int
    aggregates: list[str] = field(default_factory=list)
    label_sets: list[list[str]] = field(default_factory=list)
    version: int = 1
    partitions: list[int] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Schema:
        return Schema(**json.loads(text))


def check_granularity(granularity: int, partition: int) -> int:
    if granularity <= 0 or (DAY % granularity and granularity % DAY):
        raise ValueError("the granularity must divide a day or be whole days")
    if partition // granularity > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} rollup buckets in a partition")
    return granularity


def make_schema(rate: str = "1/s", aggregates: str = "", granularity: str = "1h", label_sets: str = "") -> Schema:
    """Sizes that follow from the expected rate of samples of one series.

    A chunk holds as many whole hours as fit in its bytes; a partition grows by 24 chunks while it fits in its own.
    """
    per_hour = parse_rate(rate)
    hours = MAX_CHUNK_BYTES // SAMPLE_BYTES // per_hour
    if not hours:
        raise ValueError(f"a rate of {rate} fills more than a chunk in an hour")
    chunks = 24
    while (chunks + 24) * hours * per_hour * SAMPLE_BYTES < MAX_PARTITION_BYTES:
        chunks += 24
    functions = parse_functions(aggregates)
    sets = parse_label_sets(label_sets)
    if sets and not functions:
        raise ValueError("label sets need aggregates")
    partition = chunks * hours * HOUR
    return Schema(per_hour, hours * HOUR, partition, check_granularity(parse_duration(granularity), partition), stored(functions) if functions else [], sets)


ALL_PRIMITIVES = list(PRIMITIVES)
