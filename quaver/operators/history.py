"""Job-history operators: keyset pages, queues, status changes, elapsed time, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def after_cursor(df: DataFrame, order: str, key: str, cursor_order: Column, cursor_key: Column) -> DataFrame:
    """Rows after a cursor in (order desc, key desc); the predicate reaches the scan."""
    return df.where((F.col(order) < cursor_order) | ((F.col(order) == cursor_order) & (F.col(key) < cursor_key)))


def page(df: DataFrame, order: str, key: str, limit: int) -> DataFrame:
    """One page of (order desc, key desc) and ``has_next``: reads limit + 1 rows by top-k, no full sort."""
    size = max(1, min(limit, 50))
    top = df.orderBy(F.desc(order), F.desc(key)).limit(size + 1)
    place = F.row_number().over(Window.orderBy(F.desc(order), F.desc(key)))
    more = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > size
    return top.withColumn("place", place).withColumn("has_next", more).where(F.col("place") <= size)


def latest(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each group by ``order``: combined on the map side, no sort of a group."""
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*group, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with the same key; of several changes of a key the last by ``order``
    (columns that ``base`` need not have) counts, without an order the greatest row."""
    last = latest(changes, [key], order or [c for c in base.columns if c != key])
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def claim(df: DataFrame, group: Sequence[str], status: str, waiting: str, running: str, order: Sequence[str]) -> DataFrame:
    """``df`` with the first waiting row of each group running, where no row of the group is running yet."""
    is_waiting = F.col(status) == waiting
    first = df.where(is_waiting).groupBy(*group).agg(F.min(F.struct(*order)).alias("_first"))
    busy = df.where(F.col(status) == running).select(*group).distinct()
    next_ = first.join(busy, list(group), "left_anti").select(*group, *[F.col(f"_first.{c}").alias(c) for c in order]).withColumn("_next", F.lit(True))
    out = df.join(next_, [*group, *order], "left")
    return out.withColumn(status, F.when(F.col("_next") & is_waiting, running).otherwise(F.col(status))).select(*df.columns)


def partial_update(base: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Non-null values of allowed columns replace those of ``base``."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in allowed])
    out = base.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in allowed else F.col(c) for c in base.columns])


def insert_missing(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append only what is not there yet (idempotent by key)."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti"))


def guarded_delete(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` does not hold; unknown keeps the row."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def elapsed_in_state(events: DataFrame, group: str, at: str, order: str, running: Column) -> DataFrame:
    """Seconds from each running event to the next event of its group (``at`` in microseconds)."""
    nxt = F.lead(at).over(Window.partitionBy(group).orderBy(at, order))
    spans = events.withColumn("_s", F.when(running, (nxt - F.col(at)) / 1e6))
    return spans.groupBy(group).agg(F.round(F.coalesce(F.sum("_s"), F.lit(0.0)), 3).alias("elapsed_seconds"), F.count(F.when(running, 1)).alias("runs"))


def unexpired(df: DataFrame, age_seconds: Column, value: Column, hit_ttl: int = 2_592_000, miss_ttl: int = 86_400) -> DataFrame:
    """Cache rows that still count: misses (null value) live shorter than hits."""
    return df.where(age_seconds < F.when(value.isNull(), miss_ttl).otherwise(hit_ttl))


def queue_positions(df: DataFrame, group: Sequence[str], queued: Column, order: Sequence[str]) -> DataFrame:
    """1-based place among queued rows of a group, 0 for the others."""
    w = Window.partitionBy(*group, queued).orderBy(*order)
    return df.withColumn("queue_position", F.when(queued, F.row_number().over(w)).otherwise(0))


def running_first(df: DataFrame, group: Sequence[str], running: Column, order: Sequence[str]) -> DataFrame:
    """``place``: running rows of a group first, the others in order."""
    w = Window.partitionBy(*group).orderBy(F.when(running, 0).otherwise(1), *order)
    return df.withColumn("place", F.row_number().over(w))


def settings(rows: DataFrame, group: str, defaults: dict[str, str]) -> DataFrame:
    """(group, a column for each setting, known): the greatest value of each key, or its default; ``known`` counts all keys seen."""
    value = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(defaults[k])).alias(k)
    return rows.groupBy(group).agg(*[value(k) for k in defaults], F.count_distinct("key").alias("known"))


def transition(rows: DataFrame, status: str, wanted: str, rules: dict[tuple[str, str], str]) -> DataFrame:
    """``rows`` with ``now`` and ``done``: a wish that its status does not allow changes nothing, and no other row."""
    now = F.lit(None).cast("string")
    for (s, w), to in rules.items():
        now = F.when((F.col(status) == s) & (F.col(wanted) == w), to).otherwise(now)
    return rows.withColumn("done", now.isNotNull()).withColumn("now", F.coalesce(now, F.col(status)))
