"""Signals in chunks at another rate: a polyphase filter, by overlap and save.

Sample m of the result is the sum over k of x[k] * h[m * down - k * up], where h is a low-pass filter
of zero phase (a sinc under a Kaiser window) and x is 0 outside the signal.  Only samples within
``reach`` of a place count, so a chunk needs the ends of its neighbours and nothing else: every chunk
is sent to itself and, cut to its ends, to the chunks beside it, and makes the samples that lie in it.
Chunks of one recording are worked on by different tasks.

Edge cases: a recording of one chunk has zeros beside it; chunks shorter than the reach take what they
need from further ones; null samples count as 0; an empty chunk makes no samples; null recordings and
repeated chunks of one number are not allowed for (chunks of a number are joined in no order).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

#: Fixed values of the filter: half its length in samples of the lower rate, and its window's shape.
HALF, SHAPE = 10, 5.0


def low_pass(up: int, down: int) -> np.ndarray:
    """The filter's 2 * HALF * max(up, down) + 1 taps at the rate times ``up``; they add up to ``up``."""
    most = max(up, down)
    at = np.arange(-HALF * most, HALF * most + 1)
    taps = np.sinc(at / most) * np.kaiser(len(at), SHAPE)
    return up * taps / taps.sum()


def ratio(rate: int, wanted: int) -> tuple[int, int]:
    """(up, down) in lowest terms."""
    g = math.gcd(rate, wanted)
    return wanted // g, rate // g


def polyphase(x: np.ndarray, first: int, begin: int, end: int, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Samples ``begin`` to ``end`` of the result, from samples ``first``, ``first`` + 1, ... of the signal."""
    half = len(taps) // 2
    m = np.arange(begin, end)
    low = -((half - m * down) // up)  # the first sample within the reach: ceil((m * down - half) / up)
    width = 2 * half // up + 1
    k = low[:, None] + np.arange(width)
    tap = m[:, None] * down - k * up + half
    good = (tap >= 0) & (tap < len(taps)) & (k >= first) & (k < first + len(x))
    return np.where(good, x[np.clip(k - first, 0, max(0, len(x) - 1))] * taps[np.clip(tap, 0, len(taps) - 1)], 0.0).sum(axis=1) if len(x) else np.zeros(len(m))


def resample(chunks: DataFrame, keys: Sequence[str], chunk: str, samples: str, up: int, down: int) -> DataFrame:
    """(keys, chunk, samples) at up / down times the rate; ``chunk`` numbers a recording's chunks in order."""
    taps = low_pass(up, down)
    reach = (len(taps) // 2) // up + 1
    size = F.size(samples)
    place = Window.partitionBy(*keys).orderBy(chunk)
    # offsets need sizes only, not samples
    at = chunks.select(*keys, chunk, size.cast("long").alias("_n")).withColumn("_first", F.sum("_n").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    x = chunks.select(*keys, chunk, F.transform(samples, lambda c: F.coalesce(c.cast("double"), F.lit(0.0))).alias("_x")).join(at, [*keys, chunk])
    # where the pieces of a chunk go: the chunks that lie within its reach
    spans = at.where("_n > 0").select(*keys, F.col(chunk).alias("_to"), F.col("_first").alias("_a"), (F.col("_first") + F.col("_n")).alias("_z"))
    grid = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL)))
    cells = spans.withColumn("_cell", grid(F.col("_a") - reach, F.col("_z") - 1 + reach))
    sent = x.where("_n > 0").withColumn("_cell", grid(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    j = sent.join(cells, [*keys, "_cell"])
    low, high = F.greatest(F.col("_first"), F.col("_a") - reach, F.col("_cell") * CELL), F.least(F.col("_first") + F.col("_n"), F.col("_z") + reach, (F.col("_cell") + 1) * CELL)
    j = j.where(low < high).select(*keys, "_to", "_a", "_z", F.struct(low.alias("at"), F.slice("_x", (low - F.col("_first") + 1).cast("int"), (high - low).cast("int")).alias("x")).alias("_p"))
    whole = j.groupBy(*keys, "_to", "_a", "_z").agg(F.array_sort(F.collect_list("_p")).alias("_parts"))
    first, line = F.get("_parts", F.lit(0))["at"], F.flatten(F.transform("_parts", lambda p: p["x"]))

    @F.arrow_udf(ArrayType(DoubleType()))
    def filtered(x: pa.Array, first: pa.Array, a: pa.Array, z: pa.Array) -> pa.Array:
        made = []
        for one, f, lo, hi in zip(x, first.to_pylist(), a.to_pylist(), z.to_pylist(), strict=True):
            made.append(polyphase(one.values.to_numpy(zero_copy_only=False), f, -(-lo * up // down), -(-hi * up // down), up, down, taps).tolist())
        return pa.array(made, pa.list_(pa.float64()))

    return whole.select(*keys, F.col("_to").alias(chunk), filtered(line, first, F.col("_a"), F.col("_z")).alias(samples))


#: Samples of a cell by which chunks find those beside them.
CELL = 1 << 14


def channel_mean(interleaved: Column, channels: int) -> Column:
    """One signal from interleaved channels; a last, unfinished frame is left out."""
    frames = F.floor(F.size(interleaved) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(interleaved, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), mean)).otherwise(F.array().cast("array<double>"))
