"""Ordered work on keys of any size: rows are cut into ranges of key and order, so one key with
all rows is spread over tasks, and what a range needs from those before it is carried over.

``ranged`` writes the rows with their range's number, so both sides of what follows (the rows,
and the carried figures) rest on the same cut even if an executor is lost.  A range's edge splits
one key at most, so carried figures are fewer than the ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.sources.storage import scratch

#: Rows of a range, about; a task holds a few ranges' rows at once.
ROWS = 200_000
PART = "_part"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """``df`` with ``_part``: rising ranges of (keys, order) of about ``rows`` rows, written to the shared folder."""
    folder = scratch(df.sparkSession, "ranges")
    ranges = max(1, math.ceil(df.count() / rows))
    cut = df.repartitionByRange(ranges, *keys, *order).withColumn(PART, F.spark_partition_id())
    cut.write.parquet(folder)
    return df.sparkSession.read.schema(cut.schema).parquet(folder)


def over_edges(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with rows in several ranges: one an edge at most."""
    return cut.groupBy(*keys).agg(F.min(PART).alias("_a"), F.max(PART).alias("_z")).where("_a < _z").select(*keys)


def carried(cut: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """(_part, keys, carried): the last known ``value`` in the ranges before, for the keys that go over an edge."""
    mark = F.when(value.isNotNull(), F.struct(*order))
    ends = cut.groupBy(PART, *keys).agg(F.max_by(value, mark).alias("_end"))
    many = Window.partitionBy(*keys)
    earlier = F.last("_end", ignorenulls=True).over(many.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("carried", earlier).where("carried IS NOT NULL").select(PART, *keys, "carried")


def last_known(cut: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``cut`` with ``name``: the newest known ``value`` of the key up to and with the row, for keys of any size."""
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.last(value, ignorenulls=True).over(within))
    before = carried(cut, keys, order, value)
    same = own[PART] == before[PART]
    for k in keys:
        same = same & own[k].eqNullSafe(before[k])
    return own.join(F.broadcast(before), same, "left").select(*[own[c] for c in cut.columns], F.coalesce(own["_own"], before["carried"]).alias(name))


def numbered(cut: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``cut`` with ``name``: each row's place among its key's rows in order, from 0, for keys of any size."""
    place = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)).cast("long") - 1
    own = cut.withColumn("_own", place)
    counts = cut.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("_before", earlier).where("_before IS NOT NULL").select(PART, *keys, "_before")
    same = own[PART] == before[PART]
    for k in keys:
        same = same & own[k].eqNullSafe(before[k])
    return own.join(F.broadcast(before), same, "left").select(*[own[c] for c in cut.columns], (own["_own"] + F.coalesce(before["_before"], F.lit(0))).alias(name))
