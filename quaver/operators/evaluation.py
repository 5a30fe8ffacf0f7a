"""Statistics of evaluation runs: three medians, macro averages, guards, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.sources.storage import scratch


def rates(df: DataFrame, group: str, errors: str, units: str) -> DataFrame:
    """Per group: sums and the ratio of sums."""
    g = df.groupBy(group).agg(F.sum(errors).alias("errors"), F.sum(units).alias("units"))
    return g.withColumn("rate", F.col("errors") / F.greatest(F.lit(1), F.col("units")))


def macro(rates_: DataFrame) -> DataFrame:
    """The unweighted mean of the groups' ratios."""
    return rates_.agg(F.round(F.avg("rate"), 6).alias("macro_rate"), F.count(F.lit(1)).alias("n_groups"))


#: Values of a group up to which a task puts them in order at once; values of a part of a larger group, about, and the fewest and the most parts.
HELD, PART_VALUES, PARTS = 1 << 20, 1 << 18, (64, 4096)


def values_at(df: DataFrame, group: Sequence[str], value: str, places, held: int | None = None) -> DataFrame:
    """(group, n, largest, found): ``found`` maps 0-based places in rising order to values; exact.

    ``places`` gives an array of places from the group size ``n``.  Groups are counted first: those of at most ``held``
    values (HELD unless given) are put in order one by one, larger ones by ``_values_of_large``, which no size troubles.
    Both give the same.  Null groups are groups.
    """
    held = HELD if held is None else held
    v = df.where(F.col(value).isNotNull()).select(F.struct(*group).alias("_g"), F.col(value).alias("_v"))
    counted = v.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held)
    large = counted.select("_g")
    # at most one group for every ``held`` rows, and none as a rule
    some = [r[0] for r in counted.select("_n").limit(HELD).collect()]
    ordered = v.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("largest"), F.sort_array(F.collect_list("_v")).alias("_s"))
    taken = F.transform(F.array_distinct(places(F.col("n"))), lambda p: F.struct(p.cast("long").alias("p"), F.get("_s", p.cast("int")).alias("v")))
    small = lambda rows: rows.select("_g", "n", "largest", F.map_from_entries(taken).alias("found"))
    if not some:
        out = small(ordered)
    else:
        own = F.broadcast(large) if len(some) < HELD else large
        rest = v.join(own, "_g", "left_anti").groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("largest"), F.sort_array(F.collect_list("_v")).alias("_s"))
        out = small(rest).unionByName(_values_of_large(v.join(own, "_g", "left_semi"), places, max(some)))
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in group], "n", "largest", "found")


def _values_of_large(v: DataFrame, places, most: int) -> DataFrame:
    """(_g, n, largest, found) of (_g, _v), for groups of any size; the largest has ``most`` values.

    A sketch of a group's values cuts them into parts, the more the larger the groups are; the parts are counted, and
    only those that hold a place are combined by value and put in order, each on its own.  So no task sorts a whole
    group, or keeps the distinct values of one.
    """
    bits = (min(max(most // PART_VALUES, PARTS[0]), PARTS[1]) - 1).bit_length()
    parts_ = 1 << bits
    folder = scratch(v.sparkSession, "values")
    cuts = F.percentile_approx("_v", F.array(*[F.lit(i / parts_) for i in range(1, parts_)]), F.lit(4 * parts_))
    whole = v.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.max("_v").alias("largest"), cuts.alias("_cuts"))
    whole.write.parquet(folder)
    whole = v.sparkSession.read.schema(whole.schema).parquet(folder)
    dealt = v.join(whole, "_g").withColumn("_part", F.lit(0))
    for step in (1 << i for i in reversed(range(bits))):  # the cuts below a value, by halving
        dealt = dealt.withColumn("_part", F.col("_part") + F.when(F.get("_cuts", F.col("_part") + (step - 1)) < F.col("_v"), step).otherwise(0))
    parts = dealt.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_in"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = parts.withColumn("_from", before).withColumn("_at", F.explode(F.array_distinct(places(F.col("n"))))).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_in")))
    kept = asked.groupBy("_g", "_part").agg(F.first("_from").alias("_from"), F.collect_list("_at").alias("_ats"))
    inside = dealt.select("_g", "_part", "_v").join(F.broadcast(kept), ["_g", "_part"]).groupBy("_g", "_part", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_from").alias("_from"), F.first("_ats").alias("_ats"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_from")
    hits = inside.withColumn("_to", upto).withColumn("_at", F.explode("_ats")).where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_c")))
    found = hits.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("long"), "_v"))).alias("found"))
    return whole.drop("_cuts").join(found, "_g")


def nth_smallest(df: DataFrame, group: str, value: str, place, name: str) -> DataFrame:
    """The value at a 0-based ``place`` (a function of the group size) in rising order."""
    hit = values_at(df, [group], value, lambda n: F.array(place(n).cast("long")))
    return hit.select(group, F.get(F.map_values("found"), F.lit(0)).alias(name), "n")


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """sorted[n // 2]; groups of one value have none."""
    return nth_smallest(df, group, value, lambda n: F.floor(n / 2), "upper_median").where("n >= 2")


def p95_disc(df: DataFrame, group: str, value: str) -> DataFrame:
    """sorted[ceil(0.95 n) - 1]."""
    return nth_smallest(df, group, value, lambda n: F.ceil(F.lit(95) * n / F.lit(100)) - 1, "p95")


def interpolated(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(group, n, largest, q): quantiles on a line between the two values next to each share's place."""
    low = lambda n, q: F.floor((n - 1) * F.lit(q)).cast("long")
    high = lambda n, q: F.least(n - 1, low(n, q) + 1).cast("long")
    v = values_at(df, group, value, lambda n: F.array(*[f(n, q) for q in shares for f in (low, high)]))
    n = F.col("n")
    at = lambda q: F.col("found")[low(n, q)] + (F.col("found")[high(n, q)] - F.col("found")[low(n, q)]) * ((n - 1) * F.lit(q) - low(n, q))
    return v.select(*group, "n", "largest", F.array(*[at(q) for q in shares]).alias("q"))


def medians(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, median): the mean of the middle two."""
    v = values_at(df, group, value, lambda n: F.array(F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long")))
    n = F.col("n")
    return v.select(*group, "n", ((F.col("found")[F.floor((n - 1) / 2).cast("long")] + F.col("found")[F.floor(n / 2).cast("long")]) / 2).alias("median"))


def complete_ratio(df: DataFrame, group: str, part: str, slow: str, fast: str, parts: int) -> DataFrame:
    """Sum of the slow medians over the sum of the fast, null unless all ``parts`` are there."""
    m = lambda c, n: medians(df, [group, part], c).select(group, part, F.col("median").alias(n))
    g = m(slow, "_s").join(m(fast, "_f"), [group, part], "full")
    whole = F.count(F.lit(1)) == parts
    return g.groupBy(group).agg(F.when(whole, F.round(F.try_divide(F.sum("_s"), F.sum("_f")), 6)).alias("ratio"), F.count(F.lit(1)).alias("n_parts"))


def mode_first_seen(df: DataFrame, group: str, value: str, order: Column) -> DataFrame:
    """The most frequent value; the one seen first wins a tie."""
    c = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return c.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_b")).select(group, F.col(f"_b.{value}").alias(value), "_b.n")


def weighted_vote(df: DataFrame, group: str, value: str, weight: str, order: Column) -> DataFrame:
    """The value with the largest total weight (6 places), first seen on ties."""
    c = df.groupBy(group, value).agg(F.round(F.sum(weight), 4).alias("weight"), F.min(order).alias("_first"))
    return c.groupBy(group).agg(F.max_by(F.struct(value, "weight"), F.struct("weight", -F.col("_first"))).alias("_b")).select(group, F.col(f"_b.{value}").alias(value), "_b.weight")


def gate(summary: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``reasons`` of failed rules in order, and ``passed`` if there are none.  A rule that is unknown fails."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return summary.withColumn("reasons", F.array_join(reasons, ";")).withColumn("passed", F.size(reasons) == 0)


def choose_candidate(candidates: DataFrame, group: str, order: str = "n") -> DataFrame:
    """One row for each group: the winner's columns (null without a usable candidate) and ``uncertain``.

    ``candidates``: group, ``order``, text, family, audio, truncated, estimated, uncovered,
    coverage, score.  Agreement of families counts most, then of recordings, then what is
    measured; the first wins ties.  Everything is combined by text before groups meet.
    """
    from quaver.functions.rules import UNCOVERED
    from quaver.functions.text import normalized

    rows = candidates.withColumn("plain", normalized(F.col("text")))
    usable = rows.where((F.col("plain") != "") & ~F.coalesce("truncated", F.lit(False)))
    row = F.struct(*[c for c in rows.columns if c not in (group, "plain")])
    original = (F.col("family") == "qwen") & (F.col("audio") == "original.wav")
    rank = F.struct(~F.coalesce("estimated", F.lit(True)), F.round("coverage", 2), F.round("score", 2), original, -F.col(order))
    texts = usable.groupBy(group, "plain").agg(F.count_distinct("family").alias("families"), F.count_distinct("audio").alias("audios"), F.count(F.lit(1)).alias("agree"), F.max_by(row, rank).alias("best"), F.max(rank).alias("rank"))
    best = texts.groupBy(group).agg(F.max_by(F.struct("best", "families", "agree"), F.struct("families", "audios", "rank")).alias("w"), F.count(F.lit(1)).alias("texts"))
    alone = (F.col("w.families") <= 1) & ((F.col("w.agree") <= 1) | (F.col("texts") > 1))
    doubt = F.coalesce("w.best.estimated", F.lit(True)) | (F.coalesce("w.best.uncovered", F.lit(0.0)) >= UNCOVERED) | alone
    out = candidates.select(group).distinct().join(best.withColumn("uncertain", doubt), group, "left")
    return out.select(group, "w.best.*", F.coalesce("uncertain", F.lit(True)).alias("uncertain"))


def mean_quality(groups: DataFrame, rows: DataFrame, key: str, score: str, density: str, bound: float = 2.4, none: float = -99.0) -> DataFrame:
    """(key, quality): the mean of ``score`` less what ``density`` has above ``bound``; ``none`` for a group without rows."""
    own = F.col(score) - F.greatest(F.lit(0.0), F.col(density) - bound)
    g = rows.groupBy(key).agg(F.avg(own).alias("quality"))
    return groups.join(g, key, "left").select(key, F.coalesce("quality", F.lit(none)).alias("quality"))
