"""Comparisons of runs: first matches, pairs within a key, rows side by side, key sets, gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.operators.evaluation import gate
from quaver.sources.storage import scratch


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "match") -> DataFrame:
    """``left`` with the first row of ``right`` (by ``order``) of the same keys as a struct ``name``, null where there is none.

    The right side is reduced to one row a key before it meets the left; ``require_matches`` makes a missing one an error.
    """
    rest = [c for c in right.columns if c not in keys]
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias(name))
    return left.join(first, list(keys), "left")


def require_matches(joined: DataFrame, name: str = "match") -> DataFrame:
    """The same rows; a row without a match stops the job that reads them."""
    return joined.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit("no matching row")).cast(joined.schema[name].dataType)))


#: Rows of a key that one tile takes from either side.
TILE = 2_000


def _tiled(df: DataFrame, keys: Sequence[str], name: str, tile: int, counts: DataFrame) -> DataFrame:
    """(keys, ``name``: struct of the other columns, _own: the row's block, _l, _r: blocks of the key on either side).

    ``counts`` (keys, l, r): rows of the two sides.  Only keys with more rows than a tile takes are listed, so the list is
    short and small enough to send to all tasks: at most one key for every ``tile`` rows.
    """
    rest = [c for c in df.columns if c not in keys]
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / tile)).cast("int")
    large = counts.where((F.col("l") > tile) | (F.col("r") > tile)).select(*keys, blocks("l").alias("_l"), blocks("r").alias("_r"))
    j = df.select(*keys, F.struct(*rest).alias(name)).join(large, list(keys), "left").withColumns({"_l": F.coalesce("_l", F.lit(1)), "_r": F.coalesce("_r", F.lit(1))})
    own = F.pmod(F.xxhash64(F.to_json(name)), F.col("_l" if name == "a" else "_r")).cast("int")
    return j.withColumn("_own", own)


def pairs_within(df: DataFrame, keys: Sequence[str], order: str, tile: int = TILE) -> DataFrame:
    """Every unordered pair of rows of a key, once: structs ``a`` and ``b`` with a.order < b.order.

    Rows of a key meet in tiles of two of its blocks, dealt by the key's counted size, so a key of any size is spread over
    tasks, each with ``tile`` rows of either block, about.  Null keys, and null or equal orders, make no pairs.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("l")).withColumn("r", F.col("l"))
    rows = _tiled(df, keys, "a", tile, n)
    left = rows.select(*keys, "a", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_l") - 1)).alias("_j"))
    right = rows.select(*keys, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"))
    j = left.join(right, [*keys, "_i", "_j"])
    x, y = F.col(f"a.{order}"), F.col(f"b.{order}")
    j = j.where(F.when(F.col("_i") == F.col("_j"), x < y).otherwise(x != y))
    return j.select(*keys, F.when(x < y, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(x < y, F.col("b")).otherwise(F.col("a")).alias("b"))


def cross_within(left: DataFrame, right: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` of the same keys, as structs ``a`` and ``b``, in tiles of blocks as ``pairs_within``."""
    of = lambda df, l, r: df.groupBy(*keys).agg((F.count(F.lit(1)) * l).alias("l"), (F.count(F.lit(1)) * r).alias("r"))
    n = of(left, 1, 0).union(of(right, 0, 1)).groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    a, b = _tiled(left, keys, "a", tile, n), _tiled(right, keys, "b", tile, n)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = a.select(*keys, "a", F.col("_own").alias("_i"), every("_r").alias("_j"))
    y = b.select(*keys, "b", every("_l").alias("_i"), F.col("_own").alias("_j"))
    return x.join(y, [*keys, "_i", "_j"]).select(*keys, "a", "b")


def side_by_side(pairs: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """One row for each place of the arrays ``a`` and ``b`` (place, x, y) where their labels are equal throughout."""
    labels = lambda c: F.transform(c, lambda x: x[label])
    same = pairs.where(labels(F.col(a)) == labels(F.col(b)))
    return same.select(*[c for c in pairs.columns if c not in (a, b)], F.posexplode(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("place", "_z")).select("*", "_z.x", "_z.y").drop("_z")


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, only_left, only_right, unlike, repeated, same): what two key sets and their values differ in."""
    count = lambda df, n: df.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias(n), F.min(F.struct(*values)).alias(n + "_v"))
    both = count(left, "l").join(count(right, "r"), [*group, *keys], "full")
    out = both.groupBy(*group).agg(
        F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("l_v").eqNullSafe(F.col("r_v"))).alias("unlike"), F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"),
    )
    return out.withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("unlike") == 0))


def missing_runs(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a grid that no recorded run has."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def select_known(df: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows asked for, the keys asked for that do not exist)."""
    return df.join(asked.select(key).distinct(), key, "left_semi"), asked.select(key).distinct().join(df.select(key), key, "left_anti")


COUNTS = ("errors", "substitutions", "deletions", "insertions", "reference_units")
#: The languages that count, and the least improvement.
LANGUAGES, LEAST = ("en", "es", "ja"), 0.30


def summaries(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, languages, balanced, deletions, insertions, rates): sums by language, ratios of sums, their plain mean."""
    known = rows.where(F.col("language").isin(*LANGUAGES))
    g = known.groupBy(*group, "language").agg(*[F.sum(c).alias(c) for c in COUNTS])
    g = g.withColumn("rate", F.col("errors") / F.greatest(F.lit(1), F.col("reference_units")))
    rate = lambda x: F.max(F.when(F.col("language") == x, F.col("rate"))).alias("rate_" + x)
    return g.groupBy(*group).agg(F.count(F.lit(1)).alias("languages"), F.avg("rate").alias("balanced"), F.sum("deletions").alias("deletions"), F.sum("insertions").alias("insertions"), *[rate(x) for x in LANGUAGES])


def release_gate(before: DataFrame, after: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """(group, improvement, reasons, passed) of pairs of runs.

    ``before``, ``after``: group, id, language and COUNTS of every recording.  ``runs``: one
    row a group with ``frozen`` (both of the evaluation split and complete), ``profiles`` (the
    two that are to be compared), ``corpus`` (one and the same fingerprint) and the frozen ids'
    number ``n_frozen``; frozen ids are those of ``before``.  What is unknown fails.
    """
    sets = key_sets(before, after, ["id"], ["language", "reference_units"], [group])
    sizes = lambda df, n: df.groupBy(group).agg(F.count(F.lit(1)).alias(n), F.count_distinct("id").alias(n + "_ids"))
    a, b = summaries(before, [group]), summaries(after, [group])
    renamed = lambda df, p: df.select(group, *[F.col(c).alias(p + c) for c in df.columns if c != group])
    j = runs.join(sets, group, "left").join(sizes(before, "nb"), group, "left").join(sizes(after, "na"), group, "left").join(renamed(a, "a_"), group, "left").join(renamed(b, "b_"), group, "left")
    j = j.withColumn("improvement", F.when(F.col("a_balanced") > 0, 1 - F.col("b_balanced") / F.nullif("a_balanced", F.lit(0.0))))
    once = lambda n: (F.col(n) == F.col(n + "_ids")) & (F.col(n + "_ids") == F.col("n_frozen"))
    worse = lambda x: F.col("b_rate_" + x).isNull() | F.col("a_rate_" + x).isNull() | (F.col("b_rate_" + x) <= F.col("a_rate_" + x))
    rules: list[tuple[str, Column]] = [
        ("split", F.col("frozen")), ("profiles", F.col("profiles")), ("corpus", F.col("corpus")), ("recordings", (F.col("only_left") == 0) & (F.col("only_right") == 0)),
        ("once", once("nb") & once("na")), ("references", F.col("same")), ("languages", (F.col("a_languages") == len(LANGUAGES)) & (F.col("b_languages") == len(LANGUAGES))), ("improvement", F.col("improvement") >= LEAST),
        *[("worse in " + x, worse(x)) for x in LANGUAGES], ("deletions", F.col("b_deletions") < F.col("a_deletions")), ("insertions", F.col("b_insertions") <= F.col("a_insertions")),
    ]
    return gate(j, rules).select(group, "improvement", "reasons", "passed")


def complete_runs(df: DataFrame, group: Sequence[str], run: str, seconds: str, runs: int = 3) -> DataFrame:
    """(group, median seconds) of the groups that have exactly the runs 1 to ``runs``, once each, with a positive median."""
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.when(F.col(run).between(0, runs + 1), F.col(run)))).alias("which"), F.median(seconds).alias("seconds"))
    whole = F.sequence(F.lit(1), F.lit(runs)).cast(g.schema["which"].dataType)
    return g.where((F.col("n") == runs) & (F.col("which") == whole) & (F.col("seconds") > 0)).drop("n", "which")


def lookup(wanted: DataFrame, records: DataFrame, close: float = 2.0) -> DataFrame:
    """(id, text, record_id, synced, n_texts, needs_input) of every wanted title.

    A record fits with an equal normalised title and artist, a finite duration within
    ``close`` seconds and a voice.  Records of one text count once, the last of them; those
    with times are preferred to those without; only a single text left decides.  Titles that ask the same, and records
    that answer the same, meet once; rows of one id ask together.
    """
    from quaver.functions.rules import finite
    from quaver.functions.text import normalized

    key = lambda df: df.withColumn("_t", normalized(F.col("title"))).withColumn("_a", normalized(F.col("artist")))
    w = key(wanted).select("id", F.col("duration").alias("_want"), "_t", "_a")
    r = key(records.where(finite(F.col("duration")) & ~F.coalesce("instrumental", F.lit(False)))).select("record_id", "duration", "synced_text", "plain_text", "_t", "_a")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    r = r.withColumn("text", F.coalesce(some("synced_text"), some("plain_text"))).where("text IS NOT NULL")
    # what is asked is asked once, and of records that answer alike the last one is kept, before the two meet
    last = F.max(F.struct("record_id", some("synced_text").isNotNull().alias("synced"))).alias("r")
    r = r.groupBy("_t", "_a", "duration", "text").agg(last)
    own = w.where("id IS NOT NULL AND _t IS NOT NULL AND _a IS NOT NULL AND _want IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("_t", "_a", "_want"))).alias("_q"))
    asked = own.select("_q").distinct().select("_q", F.explode("_q").alias("q")).select("_q", "q.*")
    # and only within neighbouring stretches of time; these are twice as long as ``close``, so that rounding leaves out nothing
    width = 2 * close if close > 0 else 1.0
    stretch = lambda c: F.floor(F.least(F.greatest(F.col(c) / width, F.lit(-1e15)), F.lit(1e15)))
    near = r.withColumn("_b", F.explode(F.sequence(stretch("duration") - 1, stretch("duration") + 1)))
    met = asked.withColumn("_b", stretch("_want")).join(near, ["_t", "_a", "_b"]).where(F.abs(F.col("duration") - F.col("_want")) <= close)
    texts = met.groupBy("_q", "text").agg(F.max("r").alias("r"))
    best = texts.groupBy("_q", F.col("r.synced").alias("synced")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("text", "r.record_id")).alias("one"))
    pick = best.groupBy("_q").agg(F.max_by(F.struct("synced", "n", "one"), "synced").alias("b"))
    single = F.col("b.n") == 1
    out = wanted.select("id").join(own.join(pick, "_q").select("id", "b"), "id", "left")
    return out.select("id", F.when(single, F.col("b.one.text")).alias("text"), F.when(single, F.col("b.one.record_id")).alias("record_id"), F.coalesce("b.synced", F.lit(False)).alias("synced"), F.coalesce("b.n", F.lit(0)).alias("n_texts"), (~F.coalesce(single & F.col("b.synced"), F.lit(False))).alias("needs_input"))


def downstream(edges: DataFrame, invalid: DataFrame) -> DataFrame:
    """(stage) of the invalid stages and all that depend on them: ``edges`` (stage, needs), of any depth; cycles end.

    Each round marks what needs an invalid stage.  Beside that, needs double: a need that has just one need itself is
    replaced by that one (both are invalid or neither is), and a need without needs that is not invalid can never be and
    goes.  So a chain of n stages takes log n rounds.  A need found over more steps than there are stages lies on a cycle
    with no way in, and goes too.  Rounds are tables in the shared folder; nothing but counts reaches the driver.
    """
    spark = edges.sparkSession

    def table(df: DataFrame) -> DataFrame:
        folder = scratch(spark, "closure")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    new = table(invalid.select("stage").where("stage IS NOT NULL").distinct())
    open_ = table(edges.select("stage", "needs", F.lit(1).cast("long").alias("steps")).where("stage IS NOT NULL AND needs IS NOT NULL AND stage <> needs").distinct())
    found, size = [new], open_.count()
    most = size
    while True:
        open_ = open_.join(new, "stage", "left_anti")
        hit = table(open_.join(new.select(F.col("stage").alias("needs")), "needs", "left_semi").select("stage").distinct())
        after = open_.join(hit, "stage", "left_anti")
        # needs by what they need themselves: nothing (never invalid), one thing (its need counts instead), or more
        own = after.groupBy(F.col("stage").alias("needs")).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("only"), F.min("steps").alias("more"))
        j = after.join(own, "needs", "left").join(hit.select(F.col("stage").alias("needs"), F.lit(True).alias("hit")), "needs", "left")
        stays, jumps = F.col("hit") | (F.col("n") > 1), F.col("n") == 1
        to = F.when(stays, F.col("needs")).when(jumps, F.col("only"))
        steps = F.when(stays, F.col("steps")).otherwise(F.col("steps") + F.col("more"))
        j = j.select("stage", to.alias("to"), steps.alias("steps"), F.coalesce(~stays, F.lit(True)).alias("moved")).where((F.col("stage") != F.col("to")) & (F.col("steps") <= most))
        both = table(j.groupBy("stage", F.col("to").alias("needs")).agg(F.max("steps").alias("steps"), F.bool_or("moved").alias("moved")))
        left = both.agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved")).first()
        some = hit.limit(1).count() > 0
        if some:
            found.append(hit)
        if not some and not left.moved and left.n == size:
            return reduce(DataFrame.unionAll, found)
        open_, new, size = both.drop("moved"), hit, left.n


def compare_runs(runs: DataFrame, tracks: DataFrame, words: DataFrame, fast: str, slow: str, voiced: float = 0.35, close: float = 50.0) -> DataFrame:
    """Each ``fast`` run against the first ``slow`` one of its language and number, in one row.

    ``runs`` (language, run, mode, job, seconds, errors), ``tracks`` (job, frame, time, hz, confidence), ``words`` (job, j,
    word, start, stop, estimated).  Pitch is compared where the two tracks have the same frames at the same times (null
    else): the median difference in cents and the share below ``close`` where both are voiced, and the share of frames
    where only one is.  Words' edges are compared where all their labels are equal (null else); ``text_kept``: the labels
    make one text.  A run without a slow one stops the job.  Both sides of a pair are brought together by one grouping
    of frames, and one of words.
    """
    from quaver.functions.signals import cents
    from quaver.functions.text import normalized

    side = lambda mode: runs.where(F.col("mode") == mode)
    pairs = require_matches(first_match(side(fast), side(slow).select("language", "run", "job", "seconds", "errors"), ["language", "run"], ["job"]))
    jobs = pairs.select(F.col("job").alias("pair"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("match.job").alias("job")), F.struct(F.lit("b").alias("side"), F.col("job").alias("job")))).alias("s")).select("pair", "s.side", "s.job")
    of = lambda n, value: F.max(F.when(F.col("side") == n, value)).alias(n)

    f = tracks.join(jobs, "job").groupBy("pair", "frame").agg(*[of(n, F.struct("time", "hz", "confidence")) for n in ("a", "b")])
    near = F.abs(F.col("a.time") - F.col("b.time")) <= 1e-6 + 1e-5 * F.abs(F.col("b.time"))
    on = lambda n: F.col(f"{n}.confidence") >= voiced
    both = on("a") & on("b") & (F.col("a.hz") > 0) & (F.col("b.hz") > 0)
    f = f.withColumn("c", F.when(both, cents(F.col("a.hz"), F.col("b.hz"))))
    f = f.groupBy("pair").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("same_time"), F.median("c").alias("middle_cents"), F.avg((F.col("c") < close).cast("double")).alias("share_close"), F.avg((on("a") != on("b")).cast("double")).alias("share_unlike"))

    w = words.join(jobs, "job").select("pair", "side", "j", F.struct(normalized(F.col("word")).alias("label"), "start", "stop", "estimated").alias("w"))
    w = w.groupBy("pair", "j").agg(of("a", F.col("w")), of("b", F.col("w")))
    gap = F.greatest(F.abs(F.col("a.start") - F.col("b.start")), F.abs(F.col("a.stop") - F.col("b.stop")))
    text = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("j", F.col(f"{n}.label").alias("l"))))), lambda x: x["l"]), "")
    guess = lambda n: F.count_if(F.col(f"{n}.estimated"))
    w = w.groupBy("pair").agg(F.bool_and(F.col("a.label").eqNullSafe(F.col("b.label"))).alias("same_labels"), (text("a") == text("b")).alias("text_kept"), F.max(gap).alias("widest"), guess("a").alias("slow_estimated"), guess("b").alias("fast_estimated"))

    j = pairs.join(f, pairs["job"] == f["pair"], "left").drop("pair").join(w, pairs["job"] == w["pair"], "left")
    same = F.coalesce("same_time", F.lit(False))
    return j.select(
        "language", "run", "job", (F.col("errors") <= F.col("match.errors")).alias("errors_pass"), F.try_divide(F.col("match.seconds"), F.col("seconds")).alias("speedup"), same.alias("same_time"),
        *[F.when(same, F.col(c)).alias(c) for c in ("middle_cents", "share_close", "share_unlike")], F.coalesce("text_kept", F.lit(True)).alias("text_kept"), F.when(F.col("same_labels"), F.col("widest")).alias("widest"),
        F.coalesce("slow_estimated", F.lit(0)).alias("slow_estimated"), F.coalesce("fast_estimated", F.lit(0)).alias("fast_estimated"),
    )


def complete_sets(rows: DataFrame, key: str, name: str, names: Sequence[str]) -> DataFrame:
    """(key) of what has every one of ``names``, whatever else it has."""
    seen = rows.where(F.col(name).isin(*names)).groupBy(key).agg(F.count_distinct(name).alias("n"))
    return seen.where(F.col("n") == len(names)).select(key)


def profile_totals(rows: DataFrame, fixture: str, profile: str, seconds: str) -> DataFrame:
    """(profile, total, fixtures) of the profiles that every fixture has: the sum of the fixtures' medians."""
    from quaver.operators.evaluation import medians

    m = medians(rows, [fixture, profile], seconds)
    whole = rows.agg(F.count_distinct(fixture).alias("all"))
    g = m.groupBy(profile).agg(F.sum("median").alias("total"), F.count(F.lit(1)).alias("fixtures"))
    return g.join(F.broadcast(whole), F.col("fixtures") == F.col("all")).drop("all")


def report(rows: DataFrame, stored: DataFrame, group: str, run: str, seconds: str) -> DataFrame:
    """(group, seconds, ratio, total_ratio): complete groups against stored seconds; the total only where every stored group is complete."""
    done = stored.select(group, F.col("seconds").alias("_base")).join(complete_runs(rows, [group], run, seconds), group, "left")
    sums = done.agg(F.sum("_base").alias("_all"), F.sum("seconds").alias("_own"), F.count_if(F.col("seconds").isNull()).alias("_open"))
    out = done.where("seconds IS NOT NULL").join(F.broadcast(sums))
    return out.select(group, "seconds", (F.col("_base") / F.col("seconds")).alias("ratio"), F.when(F.col("_open") == 0, F.col("_all") / F.col("_own")).alias("total_ratio"))
