"""Distributed sums of fixed-size dense counters.

Every task counts all of its rows into one array of a fixed size and emits the
array in slices; slices are summed by slice number.  What moves is tasks x size,
never a row for each key, and what reaches the driver is one array of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaver.llm.shared import map_arrow

SLICES = 16
PART = "slot int, part binary"


def dense_sum(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``count(batches)`` (int64, length ``size``) over all partitions of ``df``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        step = size // SLICES
        for i in range(SLICES):
            part = total[i * step : (i + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slot", "part"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # slices are added as they come: a task holds its sums and one batch, however many tasks counted
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, part in zip(b.column("slot").to_pylist(), b.column("part"), strict=True):
                x = np.frombuffer(part.as_buffer(), np.int64)
                if slot in total:
                    total[slot] += x
                else:
                    total[slot] = x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "part"])

    assert size % SLICES == 0
    parts = map_arrow(df, emit, PART)
    rows = map_arrow(parts.repartition(SLICES, "slot"), fold, PART).collect()
    out = np.zeros(size, np.int64)
    step = size // SLICES
    for r in rows:
        out[r.slot * step : (r.slot + 1) * step] = np.frombuffer(r.part, np.int64)
    return out
