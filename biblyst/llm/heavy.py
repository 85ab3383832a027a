"""Exact heavy hitters of an array column in two passes, with tiny shuffles.

A value in at least a fraction f of all rows is in at least a fraction f of
the rows of some chunk. Pass one keeps each chunk's local heavy hitters as
candidates, pass two counts just those over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.session import materialize

#: Values a chunk holds before it is counted (64 MB).
CHUNK = 8_000_000
#: Candidates that may be sent to the tasks (16 MB); beyond that all values are counted by a shuffle.
MAX_CANDIDATES = 2_000_000
_SCHEMA = "value long, n long"


def _counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], int]]:
    parts: list[np.ndarray] = []
    rows = held = 0
    for b in batches:
        v = b.column(0).flatten().to_numpy(zero_copy_only=False)
        parts.append(v)
        held += len(v)
        rows += b.num_rows
        if held > CHUNK:
            yield parts, rows
            parts, rows, held = [], 0, 0
    if rows:
        yield parts, rows


def _batch(v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["value", "n"])


def heavy_hitters(df: DataFrame, column: str, fraction: float, least: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, counts, rows): values of the array ``column`` in at least ``fraction`` of the rows and ``least`` rows.

    Arrays must hold no value twice. At most mean array length / fraction
    values qualify, which bounds what comes to the driver.
    """
    rows = df.count()
    one = df.select(column)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, n in _chunks(batches):
            v, c = _counts(parts)
            keep = c >= fraction * n
            # a chunk of few rows can't tell; it keeps all that it has
            yield _batch(v[keep], c[keep]) if fraction * n > 1 else _batch(v, c)

    floor = max(least, fraction * rows)
    candidates = materialize(one.mapInArrow(local, _SCHEMA).groupBy("value").agg(F.sum("n").alias("n")), "candidates")
    if candidates.limit(MAX_CANDIDATES + 1).count() <= MAX_CANDIDATES:
        known = df.sparkSession.sparkContext.broadcast(np.sort(candidates.select("value").toPandas()["value"].to_numpy()))

        def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = known.value
            for parts, _ in _chunks(batches):
                v, c = _counts(parts)
                if len(k):
                    at = np.minimum(np.searchsorted(k, v), len(k) - 1)
                    hit = k[at] == v
                    yield _batch(v[hit], c[hit])

        counted = one.mapInArrow(recount, _SCHEMA)
    else:
        counted = one.select(F.explode(column).alias("value"), F.lit(1).cast("long").alias("n"))
    out = counted.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toPandas().sort_values("value")
    return out["value"].to_numpy(np.int64), out["n"].to_numpy(np.int64), rows
