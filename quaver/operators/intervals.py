"""Interval joins.  Points and intervals meet by a bucket of the axis, so that
they are equi-joins with a residual, not nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def covered_buckets(start: Column, stop: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(stop / width))


def points_in(points: DataFrame, at: str, spans: DataFrame, start: str, stop: str, width: int, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Points with start <= at < stop, within equal ``keys``."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("_bucket", F.explode(covered_buckets(F.col(start), F.col(stop), width)))
    s = s.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (p["_bucket"] == s["_bucket"]) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))
    for k in keys:
        on = on & (p[k] == s[f"_{k}"])
    joined = p.join(s, on, how)
    return joined.drop(p["_bucket"]).drop(s["_bucket"]).drop(*[f"_{k}" for k in keys]) if how == "inner" else joined.drop("_bucket")


def not_overlapping(left: DataFrame, right: DataFrame, start: str, stop: str, width: int, group: int = 1024) -> DataFrame:
    """Intervals of ``left`` that overlap none of ``right`` (strict on both ends).

    An interval is free if nothing that starts before its end ends after its start, so
    the greatest end of all earlier starts decides: a running maximum over buckets of the
    axis, over ``group`` buckets at a time, and inside a bucket.  No interval is copied,
    however long it is, and equal starts are combined before they meet.
    """
    names = left.columns
    r = right.groupBy(F.col(start).alias("_k")).agg(F.max(stop).alias("_e"))
    u = left.select(F.struct(*names).alias("_row"), F.col(stop).alias("_k"), F.lit(0).alias("_right"), F.lit(None).cast(right.schema[stop].dataType).alias("_e"))
    u = u.unionByName(r.select(F.lit(None).cast(u.schema["_row"].dataType).alias("_row"), "_k", F.lit(1).alias("_right"), "_e"))
    u = u.withColumn("_b", F.floor(F.col("_k") / width).cast("long")).withColumn("_g", F.floor(F.col("_b") / group).cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = u.groupBy("_g", "_b").agg(F.max("_e").alias("_m"))
    groups = tops.groupBy("_g").agg(F.max("_m").alias("_m")).select("_g", F.max("_m").over(before(Window.orderBy("_g"))).alias("_far"))
    tops = tops.select("_g", "_b", F.max("_m").over(before(Window.partitionBy("_g").orderBy("_b"))).alias("_near")).join(groups, "_g").select("_b", "_near", "_far")
    inner = F.max("_e").over(before(Window.partitionBy("_b").orderBy("_k", "_right")))
    rows = u.withColumn("_own", inner).where("_right = 0").join(tops, "_b").withColumn("_last", F.greatest("_own", "_near", "_far"))
    return rows.where(F.coalesce(F.col("_last") <= F.col(f"_row.{start}"), F.lit(True))).select("_row.*")


def least_in_band(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, band: int, energy: str, value: str, key: str) -> DataFrame:
    """For each left row the ``value`` of the right row within ``band`` that has the least ``energy`` (then the least ``other``)."""
    a = left.select(key, *keys, at).withColumn("_bucket", F.explode(covered_buckets(F.col(at) - band, F.col(at) + band, 4 * band)))
    b = right.withColumn("_b", F.floor(F.col(other) / (4 * band))).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (F.col("_bucket") == F.col("_b")) & (F.abs(F.col(at) - F.col(other)) <= band)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on).groupBy(key).agg(F.min_by(value, F.struct(energy, other, value)).alias("nearest"), F.count(F.lit(1)).alias("n_in_band"))


def band_match(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, tolerance: int) -> DataFrame:
    """Equal keys and abs(a - b) <= tolerance (inclusive)."""
    on = F.abs(F.col(a) - F.col(b)) <= tolerance
    for k in keys:
        on = on & (left[k] == right[k])
    joined = left.join(right, on)
    for k in keys:
        joined = joined.drop(right[k])
    return joined
