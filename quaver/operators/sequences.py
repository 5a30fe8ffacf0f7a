"""Ordered operators: runs, frames, interpolation, and folds whose state hangs on earlier output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def runs(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``run``: the number of the consecutive run of equal values (nulls are equal) a row lies in, from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.lag(F.lit(1)).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def frame_median(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, reach: int) -> DataFrame:
    """Centred median over ``reach`` rows on both sides, shorter at the edges."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("frame_median", F.expr(f"percentile({value}, 0.5)").over(w))


def frame_lower_median(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, reach: int) -> DataFrame:
    """As ``frame_median``, by the rule of pitch trackers' filters: NaN and null do not count, of two middle values the lower
    one is taken, and a frame with no value at all is NaN."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-reach, reach)
    known = F.sort_array(F.collect_list(F.when(~F.isnan(F.col(value)), F.col(value))).over(w))
    df = df.withColumn("_known", known)
    return df.withColumn("frame_median", F.coalesce(F.get("_known", F.floor((F.size("_known") - 1) / 2).cast("int")), F.lit(float("nan")))).drop("_known")


def interpolate(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, end: Column) -> DataFrame:
    """Runs of nulls lie on a line by row distance: between two known values; before the first from 0 at the first row;
    after the last up to ``end`` one row past the last."""
    base = Window.partitionBy(*group).orderBy(*order)
    back, ahead = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(base)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    df = df.withColumn("_l", F.last(mark, ignorenulls=True).over(back)).withColumn("_r", F.first(mark, ignorenulls=True).over(ahead))
    at, begin = F.coalesce("_l.i", F.lit(1)), F.coalesce("_l.v", F.lit(0.0))
    to, finish = F.coalesce("_r.i", F.col("_n") + 1), F.coalesce("_r.v", end)
    line = begin + (finish - begin) * ((F.col("_i") - at) / F.nullif(to - at, F.lit(0)))
    return df.withColumn("filled", F.coalesce(F.col(value), line)).drop("_i", "_n", "_l", "_r")


def until_next(df: DataFrame, group: Sequence[str], order: Sequence[str], start: str, end: Column) -> DataFrame:
    """``stop``: the next row's start, at most ``end``, which is also the last row's; ``falls``: whether some start of the group is not below the next."""
    w = Window.partitionBy(*group)
    after = F.lead(start).over(w.orderBy(*order))
    df = df.withColumn("_next", after)
    falls = F.bool_or(F.coalesce(F.col(start) >= F.col("_next"), F.lit(False))).over(w)
    return df.withColumn("falls", falls).withColumn("stop", F.least(end, F.coalesce("_next", end))).drop("_next")


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """``begin`` and ``finish`` shares of the group's whole ``size`` in order."""
    w = Window.partitionBy(*group)
    upto = F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.greatest(F.lit(1), F.sum(size).over(w))
    return df.withColumn("begin", (upto - F.col(size)) / whole).withColumn("finish", upto / whole)


#: Columns of the edit table whose bit vectors are kept at once for the way back.
STORED = 512


class _Table:
    """The edit table of two token arrays, a column at a time: bits are the rows, one for each token of ``down``.

    ``rises`` and ``falls`` mark the rows that are one more, or one less, than the row above; they follow from those of
    the column before by whole-number operations, so a machine word works on all of its cells at once.
    """

    def __init__(self, down: np.ndarray, across: np.ndarray) -> None:
        self.size, self.full = len(down), (1 << len(down)) - 1
        known, self.columns = np.unique(across, return_inverse=True)
        self.equal = [int.from_bytes(np.packbits(down == token, bitorder="little").tobytes(), "little") for token in known]

    def start(self) -> tuple[int, int]:
        return self.full, 0

    def column(self, j: int, rises: int, falls: int) -> tuple[int, int, int]:
        """(rises, falls) of column ``j`` from those before, and the rows above which the column falls against the one before."""
        equal = self.equal[self.columns[j]]
        level = equal | falls
        across = (((equal & rises) + rises) ^ rises) | equal
        up, down = falls | (self.full & ~(across | rises)), rises & across
        up, down = (up << 1 | 1) & self.full, (down << 1) & self.full
        return down | (self.full & ~(level | up)), up & level, down


def edit_errors(ref: np.ndarray, hyp: np.ndarray) -> int:
    """Substitutions, deletions and insertions together."""
    down, across = (ref, hyp) if len(ref) >= len(hyp) else (hyp, ref)
    table = _Table(down, across)
    rises, falls = table.start()
    for j in range(len(across)):
        rises, falls, _ = table.column(j, rises, falls)
    return len(across) + rises.bit_count() - falls.bit_count()


def edit_counts(ref: np.ndarray, hyp: np.ndarray) -> tuple[int, int, int, int]:
    """(errors, substitutions, deletions, insertions) of two sequences of token numbers, where equal tokens take the diagonal and ties go to substitution, then deletion, then insertion.

    The way back needs two bits of a cell: whether the cell to its left, or the one above, is less than the one across the
    corner; where neither is, a substitution is as good as any.  Vectors are kept at every STORED-th column and made anew
    between, so memory is in proportion to one text.  Deletions and insertions follow from errors, substitutions and lengths.
    """
    m, n = len(ref), len(hyp)
    same = 0
    while same < min(m, n) and ref[m - 1 - same] == hyp[n - 1 - same]:  # the way back begins along the diagonal
        same += 1
    ref, hyp = ref[: m - same], hyp[: n - same]
    turned = len(hyp) > len(ref)
    down, across = (hyp, ref) if turned else (ref, hyp)
    table = _Table(down, across)
    rises, falls = table.start()
    kept = []
    for j in range(len(across)):
        if j % STORED == 0:
            kept.append((rises, falls))
        rises, falls, _ = table.column(j, rises, falls)
    errors = len(across) + rises.bit_count() - falls.bit_count()
    i, j, subs = len(down), len(across), 0
    while i and j:
        first = (j - 1) // STORED * STORED
        rises, falls = kept[first // STORED]
        part = []
        for k in range(first, j):
            before = falls
            rises, falls, above = table.column(k, rises, falls)
            part.append((before, above))
        while i and j > first:
            bit = 1 << (i - 1)
            left, above = part[j - 1 - first][0] & bit, part[j - 1 - first][1] & bit
            if table.equal[table.columns[j - 1]] & bit:
                i, j = i - 1, j - 1
            elif not left and not above:
                i, j, subs = i - 1, j - 1, subs + 1
            elif (left if turned else not above):  # a deletion goes up, or to the left where the texts are turned
                j -= 1
            else:
                i -= 1
    return errors, subs, (errors - subs + m - n) // 2, (errors - subs - m + n) // 2


EDITS = ("errors", "substitutions", "deletions", "insertions")


def _token_pairs(ref: pa.Array, hyp: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token numbers of each row's two arrays; a null array counts as an empty one."""
    tokens = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode().indices.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(pa.concat_arrays([ref.value_lengths(), hyp.value_lengths()]).fill_null(0).to_numpy())])
    part = lambda i: tokens[bounds[i] : bounds[i + 1]]
    return ((part(i), part(len(ref) + i)) for i in range(len(ref)))


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in EDITS]))
def long_edit_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """(errors, substitutions, deletions, insertions) of two token arrays of any length; a null array counts as an empty one."""
    counts = np.array([edit_counts(*pair) for pair in _token_pairs(ref, hyp)], np.int32).reshape(-1, 4)
    return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], EDITS)


@F.arrow_udf(IntegerType())
def token_errors(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The edit distance alone."""
    return pa.array([edit_errors(*pair) for pair in _token_pairs(ref, hyp)], pa.int32())
