"""Notes from timed syllables and a pitch track, and their text chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions.signals import pitch, ticks
from quaver.functions.text import clean
from quaver.operators.folds import Layout, ordered_fold

#: A voiced frame, a sung unit, the shortest run of one pitch, the reach of a boundary.
CONFIDENCE, ENERGY, VOICED, RUN, REACH = 0.35, 0.001, 0.3, 8, 0.06
UNIT = ("rec", "unit")


def voiced(confidence: Column, energy: Column, hz: Column) -> Column:
    return (confidence >= CONFIDENCE) & (energy > ENERGY) & (hz > 0)


def _quietest(edge: Column, band: Column) -> Column:
    """The quietest frame's time (the earliest of equals) less than ``band`` from ``edge``, else ``edge``."""
    near = F.filter("frames", lambda f: F.abs(f["time"] - edge) < band)
    return F.coalesce(F.array_min(F.transform(near, lambda f: F.struct(f["energy"], f["time"])))["time"], edge)


def _middle(values: Column) -> Column:
    """The median of an array, rounded half to even."""
    s, n = F.sort_array(values), F.size(values)
    return F.bround((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2).cast("int")


def make_notes(units: DataFrame, frames: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(rec, unit, i, start, stop, pitch, kind, text, phrase, and the units' columns ``keep``).

    ``units``: rec, unit, start, stop, text, phrase, estimated, duration.  ``frames``:
    rec, time, hz, confidence, energy.  Estimated edges move to the quietest frame
    near them, the end by the band that the moved start leaves.  A unit with too few
    voiced frames is one free note; else its smoothed pitch is cut into runs, short
    ones are dropped without joining their neighbours, and a run lasts until the next.

    Units meet the frames of their seconds once; all else is worked out within the unit's own
    row, which holds the frames of one syllable.
    """
    u = units.withColumn("start", F.greatest(F.lit(0.0), "start")).withColumn("stop", F.least("duration", "stop")).where("stop > start")
    held = [c for c in dict.fromkeys((*u.columns, *keep)) if c not in UNIT]
    second = F.explode(F.sequence(F.floor(F.col("start") - REACH), F.floor(F.col("stop") + REACH)))
    frame = F.struct(F.col("time").alias("time"), "energy", voiced(F.col("confidence"), F.col("energy"), F.col("hz")).alias("sung"), F.when(F.col("hz") > 0, pitch(F.col("hz"))).cast("int").alias("p"))
    f = frames.select("rec", F.floor("time").alias("second"), frame.alias("f"))
    u = u.withColumn("second", second).join(f, ["rec", "second"], "left").groupBy(*UNIT).agg(*[F.first(c).alias(c) for c in held], F.array_sort(F.collect_list("f")).alias("frames"))

    moved = lambda c, new: F.when(F.col("estimated"), new).otherwise(F.col(c))
    band = F.least(F.lit(REACH), (F.col("stop") - F.col("start")) / 4)
    u = u.withColumn("start", moved("start", F.greatest(F.lit(0.0), _quietest(F.col("start"), band))))
    u = u.withColumn("stop", moved("stop", F.least("duration", _quietest(F.col("stop"), band))))
    u = u.withColumn("inside", F.filter("frames", lambda x: (x["time"] >= F.col("start")) & (x["time"] < F.col("stop"))))
    u = u.withColumn("tone", F.filter("inside", lambda x: x["sung"])).withColumn("sings", (F.size("tone") / F.greatest(F.lit(1), F.size("inside")) >= VOICED) & (F.size("tone") > 0))
    u = u.withColumn("p", F.transform("tone", lambda x: x["p"]))
    # a frame's median over itself and two on both sides, fewer at the edges
    near = lambda i: F.slice("p", F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.size("p")) - F.greatest(i - 2, F.lit(0)))
    u = u.withColumn("smooth", F.transform("p", lambda x, i: _middle(near(i))))
    places = F.when(F.size("smooth") > 0, F.sequence(F.lit(0), F.size("smooth") - 1)).otherwise(F.array().cast("array<int>"))
    u = u.withColumn("begins", F.filter(places, lambda i: (i == 0) | (F.get("smooth", i) != F.get("smooth", i - 1))))
    long_ = F.filter(F.transform("begins", lambda b, k: F.struct(b.alias("at"), (F.coalesce(F.get("begins", k + 1), F.size("smooth")) - b).alias("n"))), lambda r: r["n"] >= RUN)
    u = u.withColumn("runs", F.transform(long_, lambda r: F.struct(F.get("tone", r["at"])["time"].alias("begin"), F.get("smooth", r["at"]).alias("pitch"))))
    u = u.withColumn("middle", _middle(F.col("p"))).withColumn("n", F.greatest(F.size("runs"), F.lit(1)))

    def note(i: Column) -> Column:
        run = F.get("runs", i)
        start = F.when(i == 0, F.col("start")).otherwise(run["begin"])
        text = F.concat(F.when(i == 0, F.rtrim("text")).otherwise("~"), F.when((i == F.col("n") - 1) & F.col("text").endswith(" "), " ").otherwise(""))
        return F.struct(i.alias("i"), start.alias("start"), F.coalesce(F.get("runs", i + 1)["begin"], F.col("stop")).alias("stop"), F.coalesce(run["pitch"], F.col("middle")).alias("pitch"), F.lit(":").alias("kind"), text.alias("text"))

    sung = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), note), lambda x: x["stop"] > x["start"])
    free = F.array(F.struct(F.lit(0).alias("i"), F.col("start").alias("start"), F.col("stop").alias("stop"), F.lit(0).alias("pitch"), F.lit("F").alias("kind"), F.col("text").alias("text")))
    return u.select(*UNIT, "phrase", *keep, F.inline(F.when(F.col("sings"), sung).otherwise(free))).select(*UNIT, "i", "start", "stop", "pitch", "kind", "text", "phrase", *keep)


def place(notes: DataFrame, duration: str = "duration", order: Sequence[str] = ("start", "unit", "i")) -> DataFrame:
    """Notes on the tick grid: (rec, kind, pitch, text, k, begin, length, cut): ``k`` numbers a recording's notes, ``cut`` is
    the tick of a line break before the note or null.  One pass over the notes of a recording in order."""
    tick = lambda c: ticks(F.col(c)).cast("long")
    rows = notes.withColumns({"_start": tick("start"), "_stop": tick("stop"), "_limit": tick(duration), "_chars": F.length("text")})
    return ordered_fold(rows, ["rec"], order, Layout, ["_start", "_stop", "_limit", "phrase", "_chars"], "k int, begin long, length long, cut long", ["kind", "pitch", "text"])


def render(placed: DataFrame, title: Column, artist: Column) -> DataFrame:
    """(rec, chart): headers, notes with line breaks before them, the end mark.  Recordings without a note have no chart."""
    line = F.concat_ws(" ", "kind", F.col("begin").cast("string"), F.col("length").cast("string"), F.col("pitch").cast("string"), F.regexp_replace("text", r"[\r\n]", " "))
    both = F.concat(F.when(F.col("cut").isNotNull(), F.concat(F.lit("- "), F.col("cut").cast("string"), F.lit("\n"))).otherwise(""), line)
    rows = placed.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("k", both.alias("line")))).alias("lines"))
    named = clean(title)
    named = F.when(named.endswith(" (AI)"), named).otherwise(F.concat(named, F.lit(" (AI)")))
    #: The header lines of the format.
    fixed = "#MP3:audio.mp3\n#VIDEO:video.mp4\n#COVER:cover.jpg\n#BPM:300\n#GAP:0\n#VIDEOGAP:0\n#ENCODING:UTF8\n"
    head = F.concat(F.lit("#TITLE:"), named, F.lit("\n#ARTIST:"), clean(artist), F.lit("\n" + fixed))
    return rows.select("rec", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nE\n")).alias("chart"))
