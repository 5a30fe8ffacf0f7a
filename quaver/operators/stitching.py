"""Words of overlapping windows as one sequence, in column expressions.

A recording is heard in windows that overlap; each window owns the time from its ``core`` on.
At a seam between two windows

* the longest run of up to REACH words that ends the earlier one and begins the later one, equal
  in ``key`` and overlapping in time word by word, is said once (by the earlier window);
* if the next word still begins before the earlier window's last word ends, a word whose middle
  lies before the later window's core is the earlier window's, any other the later's;
* if the two that then meet overlap still, both are cut at the core and marked as estimated, their
  characters with them; both windows become uncertain, and the later one has a conflict.

A seam hangs on the one before it only where a window's words can be touched from both sides.  A
window is solid if no word of it can be touched from both, some word from neither, and its last and
first word only from their own side, or if it has no window before or none behind it.  Seams between
solid windows are found side by side, each from the two windows at it, so a recording of any length is
spread over tasks; all that a seam leaves behind is three figures in either window's row.  Windows
between two solid ones that are not solid themselves (shorter than what they share) are taken in order,
as one group.

Words stay arrays in their window's row throughout.  A range of a recording's windows also gets the last
window of the range before and the first of the one behind, with what lies beyond them in brief.

Input rows: ``rec``, ``seg`` (unique in a recording; ties of ``window_start`` go by it),
``window_start``, ``core``, ``language``, ``words`` (array of struct(key, word, start, stop, chars)),
where chars are struct(char, start, stop).  Other columns are not read.  Null words are left out, and so
are windows of no recording; windows that keep no words have no row in the result; an empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.functions.text import join_words
from quaver.operators.ranges import PART, ROWS, over_edges, ranged
from quaver.sources.storage import scratch

REACH = 32
CHAR = "struct<char:string,start:double,stop:double>"
#: What a group's seams leave of a window's words, place by place; null for a word that is gone.
FATES = "array<struct<start:double,stop:double,estimated:boolean>>"
#: (*fields): a window's words, as an array of struct(*fields), from the columns of its row.
Hear = Callable[..., Column]


def _mid(w: Column) -> Column:
    return (w["start"] + w["stop"]) / 2


def repeated(old: Column, new: Column, reach: int = REACH) -> Column:
    """The size of the longest run that ends ``old``, begins ``new`` and overlaps in time throughout; 0 without one."""
    alike = lambda a, b: (a["key"] == b["key"]) & (F.greatest(a["start"], b["start"]) < F.least(a["stop"], b["stop"]))
    # a run begins at a word like the first new one; few of the earlier words overlap with that in time
    begins = lambda k: alike(F.get(old, F.size(old) - k), F.get(new, F.lit(0)))
    same = lambda k: F.forall(F.zip_with(F.slice(old, -k, k), F.slice(new, F.lit(1), k), alike), lambda x: x)
    most = F.least(F.size(old), F.size(new), F.lit(reach))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, lambda k: begins(k) & same(k))), F.lit(0))


def _meet(old: list[tuple], new: list[tuple], core: float) -> tuple[list[tuple], list[tuple], bool]:
    """What a seam leaves of two windows' words (pos, key, start, stop, estimated), and whether it cuts two of them."""
    alike = lambda pair: pair[0][1] == pair[1][1] and pair[0][2] < pair[1][3] and pair[1][2] < pair[0][3]
    reach = min(REACH, len(old), len(new))
    said = max((k for k in range(reach + 1) if all(map(alike, zip(old[len(old) - k :], new, strict=False)))), default=0)
    new = new[said:]
    if not new or old[-1][3] <= new[0][2]:
        return old, new, False
    sides: dict[bool, list[tuple]] = {True: [], False: []}
    for own, words in ((True, old), (False, new)):
        sides[own] = [w for w in words if ((w[2] + w[3]) / 2 < core) is own]
    old, new = sides[True], sides[False]
    cut = bool(old) and bool(new) and old[-1][3] > new[0][2]
    if cut:
        pos, key, start, stop, _ = old[-1]
        old = [*old[:-1], (pos, key, start, min(stop, core), True)]
        pos, key, start, stop, _ = new[0]
        new = [(pos, key, max(start, core), stop, True), *new[1:]]
    return old, new, cut


def in_order(rows: pd.DataFrame) -> Iterator[tuple]:
    """(seg, fates, conflict, uncertain) of windows that hang on each other; ``fates`` as FATES.

    ``open_`` holds the windows that keep words so far; a window meets the last of them, and one that loses all its
    words to a seam leaves the place to the one before.
    """
    open_: list[tuple[int, list[tuple], list[bool]]] = []
    sizes: dict[int, int] = {}
    for r in rows.sort_values(["window_start", "seg"]).itertuples(index=False):
        words, marks = [(i, w["key"], w["start"], w["stop"], False) for i, w in enumerate(r.words)], [False, False]
        sizes[r.seg] = len(words)
        if open_ and words:
            seg, before, marks_before = open_.pop()
            before, words, cut = _meet(before, words, r.core)
            marks = [cut, cut]
            if before:
                open_.append((seg, before, [marks_before[0], marks_before[1] or cut]))
        if words:
            open_.append((r.seg, words, marks))
    left = {seg: (words, marks) for seg, words, marks in open_}
    for seg, size in sizes.items():
        words, marks = left.get(seg, ([], [False, False]))
        fates: list[dict | None] = [None] * size
        for pos, _, start, stop, estimated in words:
            fates[pos] = {"start": start, "stop": stop, "estimated": estimated}
        yield seg, fates, *marks


def _own(*, back: bool = False) -> Window:
    """A recording's windows of one range in order, or from the last to the first."""
    by = [F.desc(c) if back else F.asc(c) for c in ("window_start", "seg")]
    return Window.partitionBy(PART, "rec").orderBy(*by)


def _so_far(window: Window, *, own: bool = False) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def _extremes(df: DataFrame, hear: Hear) -> DataFrame:
    """``df`` with its windows' latest stop and earliest start."""
    at = lambda c: F.transform("_t", lambda w: w[c])
    return df.withColumn("_t", hear("start", "stop")).withColumn("_h", F.array_max(at("stop"))).withColumn("_l", F.array_min(at("start"))).drop("_t")


def _guests(cut: DataFrame, hear: Hear) -> DataFrame:
    """The windows on either side of a range's edge as rows of the other range, with ``_high``, ``_low`` and ``_core`` of
    all windows beyond them: latest stop, earliest start and core."""
    split = _extremes(cut.join(F.broadcast(over_edges(cut, ["rec"])), "rec", "left_semi"), hear)
    up, down = _so_far(_own()), _so_far(_own(back=True))
    split = split.withColumns({"_up": F.max("_h").over(up), "_down": F.min("_l").over(down), "_cores": F.min("core").over(down), "_i": F.row_number().over(_own()), "_j": F.row_number().over(_own(back=True))})
    ends = split.where("_i = 1 OR _j = 1")
    folder = scratch(cut.sparkSession, "ends")
    ends.write.parquet(folder)
    ends = cut.sparkSession.read.schema(ends.schema).parquet(folder)
    rising, falling = Window.partitionBy("rec").orderBy(PART), Window.partitionBy("rec").orderBy(F.desc(PART))
    columns = [c for c in cut.columns if c != PART]
    none = F.lit(None).cast("double")
    lasts = ends.where("_j = 1").withColumn("_high", F.greatest("_up", F.max(F.greatest("_up", "_h")).over(_so_far(rising)))).withColumn("_to", F.lead(PART).over(rising))
    firsts = ends.where("_i = 1").withColumn("_low", F.least("_down", F.min(F.least("_down", "_l")).over(_so_far(falling)))).withColumn("_core", F.least("_cores", F.min(F.least("_cores", "core")).over(_so_far(falling)))).withColumn("_to", F.lead(PART).over(falling))
    rows = lasts.select(F.col("_to").alias(PART), *columns, "_high", none.alias("_low"), none.alias("_core")).unionByName(firsts.select(F.col("_to").alias(PART), *columns, none.alias("_high"), "_low", "_core"))
    return rows.where(f"{PART} IS NOT NULL").withColumn("_guest", F.lit(True))


def seams(cut: DataFrame, hear: Hear) -> DataFrame:
    """``cut`` with what the seams between solid windows leave behind, and which windows have others.

    ``_seam`` is struct(said, meet, conflict) of the seam before a window (null if one of the two is not solid): the words said
    by the earlier one, whether the words go by their middle, whether two are cut.  ``_next`` is the same of the seam
    behind it, at ``_next_core``.  ``_loose``: in a group, not as its first; ``_opens``: as its first.  ``_gone``: no word is left.
    """
    none = F.lit(None).cast("double")
    plain = cut.withColumns({"_high": none, "_low": none, "_core": none, "_guest": F.lit(False)})
    # windows travel as they came; their words are made where they are met
    j = _extremes(plain.unionByName(_guests(cut, hear)).repartition(PART, "rec"), hear)
    up, down = _own(), _own(back=True)
    j = j.withColumn("_lo", F.least(F.min("_l").over(_so_far(down)), F.min("_low").over(_so_far(down, own=True)))).withColumn("_co", F.least(F.min("core").over(_so_far(down)), F.min("_core").over(_so_far(down, own=True))))
    j = j.withColumn("_hi", F.greatest(F.max("_h").over(_so_far(up)), F.max("_high").over(_so_far(up, own=True)))).withColumn("_w", hear("key", "start", "stop"))
    new, old, core = F.col("_w"), F.col("_old"), F.col("core")
    left = lambda w: (w["start"] < F.col("_hi")) | (_mid(w) < core)
    right = lambda w: (w["stop"] > F.col("_lo")) | (w["stop"] > F.col("_co"))
    firm = ~F.exists(new, lambda w: left(w) & right(w)) & F.exists(new, lambda w: ~left(w) & ~right(w)) & ~left(F.get(new, F.size(new) - 1)) & ~right(F.get(new, F.lit(0)))
    j = j.withColumn("_solid", F.col("_hi").isNull() | F.col("_lo").isNull() | F.coalesce(firm, F.lit(False)))
    j = j.withColumn("_old", F.lag("_w").over(up)).withColumn("_old_solid", F.lag("_solid").over(up))
    j = j.withColumn("_said", F.when(F.col("_solid") & F.col("_old_solid"), repeated(old, new)))
    said = F.col("_said")
    j = j.withColumn("_meet", F.coalesce(F.get(new, said)["start"] < F.get(old, F.size(old) - 1)["stop"], F.lit(False)))
    last, first = F.try_element_at(F.filter(old, lambda w: _mid(w) < core), F.lit(-1)), F.get(F.filter(new, lambda w, i: (i >= said) & (_mid(w) >= core)), F.lit(0))
    j = j.withColumn("_seam", F.when(said.isNotNull(), F.struct(said.alias("said"), F.col("_meet").alias("meet"), (F.col("_meet") & F.coalesce(last["stop"] > first["start"], F.lit(False))).alias("conflict"))))
    j = j.withColumn("_next", F.lead("_seam").over(up)).withColumn("_next_core", F.lead("core").over(up)).withColumn("_next_solid", F.lead("_solid").over(up))
    loose, opens = ~F.col("_solid") | ~F.coalesce("_old_solid", F.lit(True)), F.col("_solid") & ~F.coalesce("_next_solid", F.lit(True))
    # only a recording's first and last window can lose all words to these seams
    gone = F.when(F.col("_hi").isNull() | F.col("_lo").isNull(), F.size(F.filter("_w", _stays)) == 0).otherwise(F.lit(False))
    return j.where("NOT _guest").select(*[c for c in cut.columns if c != PART], "_seam", "_next", "_next_core", loose.alias("_loose"), opens.alias("_opens"), gone.alias("_gone"))


def _stays(w: Column, i: Column) -> Column:
    """Whether the seams between solid windows leave a word."""
    none = lambda c: F.coalesce(c, F.lit(False))
    return (i >= F.coalesce("_seam.said", F.lit(0))) & (~none("_seam.meet") | (_mid(w) >= F.col("core"))) & (~none("_next.meet") | (_mid(w) < F.col("_next_core")))


def _fated(w: Column, i: Column) -> Column:
    """A word as its window's groups leave it; null if it is gone."""
    of = lambda c: F.transform("_fates", lambda f: F.get(f, i)[c])
    stays = _stays(w, i) & F.forall("_fates", lambda f: F.get(f, i).isNotNull())
    return F.when(stays, F.struct(w["word"].alias("word"), F.array_max(of("start")).alias("start"), F.array_min(of("stop")).alias("stop"), w["chars"].alias("chars"), F.exists(of("estimated"), lambda x: x).alias("estimated")))


def _left(df: DataFrame, hear: Hear, *, tied: bool) -> DataFrame:
    """The result's rows from the seams' figures and, if ``tied``, the ``_fates``."""
    words = hear("word", "start", "stop", "chars")
    df = df.withColumn("_w", F.filter(F.transform(words, _fated), lambda w: w.isNotNull()) if tied else F.filter(words, _stays))
    conflict, conflict_behind = F.coalesce("_seam.conflict", F.lit(False)), F.coalesce("_next.conflict", F.lit(False))

    def cut(w: Column, i: Column) -> Column:
        first, last = conflict & (i == 0), conflict_behind & (i == F.size("_w") - 1)
        start, stop = F.when(first, F.greatest(w["start"], F.col("core"))).otherwise(w["start"]), F.when(last, F.least(w["stop"], F.col("_next_core"))).otherwise(w["stop"])
        at = lambda c: F.struct(c["char"].alias("char"), F.greatest(c["start"], start).alias("start"), F.least(c["stop"], stop).alias("stop"))
        inside = lambda c: F.greatest(c["start"], start) < F.least(c["stop"], stop)
        chars = F.coalesce(w["chars"], F.array().cast(f"array<{CHAR}>"))
        clipped = F.struct(w["word"].alias("word"), start.alias("start"), stop.alias("stop"), F.lit(True).alias("estimated"), F.transform(F.filter(chars, inside), at).alias("chars"))
        whole = F.struct(w["word"].alias("word"), w["start"].alias("start"), w["stop"].alias("stop"), F.lit(False).alias("estimated"), chars.alias("chars"))
        return F.when(first | last | w["estimated"] if tied else first | last, clipped).otherwise(whole)

    df = df.withColumn("words", F.transform("_w", cut))
    first, last = F.get("words", F.lit(0)), F.get("words", F.size("words") - 1)
    own = (F.col("_uncertain"), F.col("_conflict")) if tied else (F.lit(False), F.lit(False))
    df = df.withColumn("uncertain", own[0] | conflict | conflict_behind).withColumn("conflict", own[1] | conflict)
    text = join_words(F.transform("words", lambda w: w["word"]), F.coalesce("language", F.lit("")))
    return df.select("rec", "seg", "window_start", "language", first["start"].alias("start"), last["stop"].alias("stop"), text.alias("text"), F.col("uncertain").alias("estimated"), "uncertain", "conflict", "words")


def stitch(windows: DataFrame, rows: int = ROWS // 20, hear: Hear | None = None) -> DataFrame:
    """(rec, seg, window_start, language, start, stop, text, estimated, uncertain, conflict, words) of every window that keeps words.

    ``words``: array of struct(word, start, stop, estimated, chars).  ``rows``: windows of a task, about.  With ``hear``, windows
    need no ``words``: ``hear`` makes them (at least one of a window, none null) from the other columns, which are what travels.
    """
    spark = windows.sparkSession
    if hear is None:
        windows = windows.select("rec", "seg", "window_start", "core", "language", F.filter("words", lambda w: w.isNotNull()).alias("words")).where(F.size("words") > 0)
        hear = lambda *fields: F.transform("words", lambda w: F.struct(*[w[f].alias(f) for f in fields]))
    cut = ranged(windows.where("rec IS NOT NULL"), ["rec"], ["window_start", "seg"], rows)
    folder = scratch(spark, "seams")
    marked = seams(cut, hear)
    marked.write.parquet(folder)
    marked = spark.read.schema(marked.schema).parquet(folder)

    # windows that hang on each other, from the solid one before them to the one behind, which may begin the next group
    members = marked.where("_loose").withColumn("_role", F.lit(1)).unionByName(marked.where("_opens").withColumn("_role", F.lit(2)))
    order = Window.partitionBy("rec").orderBy("window_start", "seg", "_role").rowsBetween(Window.unboundedPreceding, 0)
    runs = members.withColumn("group", F.count_if(F.col("_role") == 2).over(order))
    shape = f"rec {windows.schema['rec'].dataType.simpleString()}, seg {windows.schema['seg'].dataType.simpleString()}, fates {FATES}, conflict boolean, uncertain boolean"

    def fold(rows_: pd.DataFrame) -> pd.DataFrame:
        rec = rows_["rec"].iloc[0]
        return pd.DataFrame([(rec, *x) for x in in_order(rows_)], columns=["rec", "seg", "fates", "conflict", "uncertain"])

    hung = runs.select("rec", "group", "seg", "window_start", "core", hear("key", "start", "stop").alias("words")).groupBy("rec", "group").applyInPandas(fold, shape)
    fates = hung.groupBy("rec", "seg").agg(F.collect_list("fates").alias("_fates"), F.bool_or("conflict").alias("_conflict"), F.bool_or("uncertain").alias("_uncertain"))
    tied = marked.where("_loose OR _opens").join(fates, ["rec", "seg"])
    free = marked.where("NOT (_loose OR _opens OR _gone)")
    return _left(free, hear, tied=False).unionByName(_left(tied, hear, tied=True).where(F.size("words") > 0))
