"""Arrow batches small enough to bound what a task holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 256
SENT = 1000


def portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, for what is held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def send_small_batches(spark: SparkSession) -> None:
    """From now on the session sends whole texts to Python in batches of at most ``SENT`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(SENT, int(spark.conf.get(name)))))


HELD: dict[str, Any] = {}


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``key`` in this Python worker; it is let go when another key is asked for."""
    if key not in HELD:
        HELD.clear()
        HELD[key] = make()
    return HELD[key]
