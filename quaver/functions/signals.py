"""Signal kernels over arrays of doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rms(block: Column) -> Column:
    """Root mean square; squares are taken in double precision."""
    total = F.aggregate(block, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.greatest(F.size(block), F.lit(1)))


def frames(signal: Column, window: int, hop: int) -> Column:
    """Windows of ``window`` samples centred on multiples of ``hop``, shorter at the edges."""
    half, n = window // 2, F.size(signal)
    count = F.greatest(F.lit(1), F.ceil(n / hop).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(signal, F.greatest(F.lit(1), i * hop - half + 1), F.least(i * hop + half, n) - F.greatest(F.lit(0), i * hop - half)))


def blocks(signal: Column, size: int) -> Column:
    """Whole blocks of ``size`` samples."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.size(signal) / size).cast("int")) - 1), lambda i: F.slice(signal, i * size + 1, F.lit(size)))


def active_blocks(levels: Column, share: float = 0.08, floor: float = 1e-6) -> Column:
    """True for the blocks above ``share`` of the peak level."""
    bar = F.greatest(F.lit(floor), F.lit(share) * F.array_max(levels))
    return F.transform(levels, lambda x: x > bar)


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true values."""
    first = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(flags, first, step, lambda a: a["best"])


def pitch(hz: Column) -> Column:
    """Semitones from middle C, half-even; null for silence and non-finite input."""
    ok = (hz > 0) & ~F.isnan(hz) & (hz < float("inf"))
    return F.when(ok, (F.bround(69 + 12 * F.log2(F.when(ok, hz) / 440)) - 60).cast("int"))


def ticks(seconds: Column) -> Column:
    """Twentieths of a second, half-even, never below 0."""
    return F.greatest(F.lit(0), F.bround(20 * seconds).cast("int"))


def cents(a: Column, b: Column) -> Column:
    """Absolute difference in cents where both are voiced."""
    return F.when((a > 0) & (b > 0), F.abs(1200 * F.log2(a / F.nullif(b, F.lit(0.0)))))


def standardise(group: Sequence[str], value: str, floor: float = 1e-6) -> Column:
    """(x - mean) / max(sample standard deviation, floor) over the samples of a group, one a row."""
    w = Window.partitionBy(*group)
    return (F.col(value) - F.avg(value).over(w)) / F.greatest(F.lit(floor), F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)))


def tone(hz: Column, seconds: Column, rate: int, partials: int = 6, edge: float = 0.08, level: float = 0.15) -> Column:
    """Samples of a tone with falling partials that swells and fades over ``edge`` seconds."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(rate))
        wave = F.lit(0.0)
        for k in range(1, partials + 1):
            wave = wave + F.sin(F.lit(2 * k) * F.pi() * hz * t) / F.lit(k)
        return F.lit(level) * F.least(F.lit(1.0), t / edge) * F.least(F.lit(1.0), (seconds - t) / edge) * wave

    return F.transform(F.sequence(F.lit(0), F.bround(seconds * rate).cast("int") - 1), at)
