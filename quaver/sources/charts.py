"""Karaoke chart text: headers, notes, phrase ends, a final mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTE = r"^([:*F]) (-?\d+) (\d+) (-?\d+) (.*)$"


def lines(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, r"\r?\n|\r")).alias("pos", "raw"))


def headers(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, name, value): the last value of a header wins."""
    h = lines(df, key, text).where(F.col("raw").startswith("#")).select(key, "pos", F.upper(F.trim(F.regexp_extract("raw", r"^#([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract("raw", r"^#[^:]*:(.*)$", 1)).alias("value"))
    return h.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))


def notes(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, kind, beat, length, pitch, text) of note lines."""
    part = lambda i: F.regexp_extract("raw", NOTE, i)
    return lines(df, key, text).where(F.col("raw").rlike(NOTE)).select(key, "pos", part(1).alias("kind"), part(2).try_cast("int").alias("beat"), part(3).try_cast("int").alias("length"), part(4).try_cast("int").alias("pitch"), part(5).alias("text"))


def validate(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, valid, n_notes, n_phrases, end_seconds, problems) of every chart.

    Problems: lines after the end mark; a note that is cut short, empty, or begins
    before the one before it ends; a break before the end of its line's last note;
    another kind of line; no end, no note or a header missing; a timing grid other
    than the fixed one; a media header that is no plain file name.
    """
    rows = df.select(key, F.posexplode(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")).alias("pos", "raw"))
    end = rows.where("raw = 'E'").groupBy(key).agg(F.min("pos").alias("end_at"))
    rows = rows.join(end, key, "left")
    note, cut, head = F.col("raw").rlike("^(: |F )"), F.col("raw").startswith("- "), F.col("raw").startswith("#")
    part = lambda i: F.get(F.split("raw", " ", 5), F.lit(i))
    rows = rows.withColumn("begin", F.when(note, part(1).try_cast("long"))).withColumn("length", F.when(note, part(2).try_cast("long")))
    rows = rows.withColumn("stop", F.col("begin") + F.col("length"))
    before = F.coalesce(F.last("stop", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = F.coalesce((F.col("begin") >= before) & (F.col("length") > 0) & part(3).try_cast("long").isNotNull() & (F.trim(part(4)) != ""), F.lit(False))
    late = F.coalesce(F.substring("raw", 3, 20).try_cast("long") >= before, F.lit(False))
    rows = rows.withColumns({"fine": fine, "late": late})
    inside, known = F.col("end_at").isNull() | (F.col("pos") < F.col("end_at")), note | cut | (head & F.col("raw").contains(":"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    value = lambda name: F.max_by(F.when(F.col("raw").startswith(f"#{name}:"), F.substring("raw", len(name) + 3, 10_000)), F.when(F.col("raw").startswith(f"#{name}:"), F.col("pos"))).alias(name)
    g = rows.groupBy(key).agg(
        any_(F.col("pos") > F.col("end_at")).alias("after"), any_(inside & note & ~F.col("fine")).alias("bad_note"), any_(inside & cut & ~F.col("late")).alias("bad_cut"), any_(inside & ~known).alias("odd"), F.max("end_at").alias("end_at"),
        F.count_if(inside & note).cast("int").alias("n_notes"), F.count_if(inside & cut).cast("int").alias("n_cuts"), F.max(F.when(inside, F.col("stop"))).alias("stop"), *[value(n) for n in ("TITLE", "ARTIST", "MP3", "BPM", "GAP", "VIDEO", "COVER")],
    )
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unsafe = lambda c: empty(c) | F.col(c).rlike(r"[/\\]") | F.col(c).isin(".", "..")
    checks = [
        ("after end", F.col("after")), ("note", F.col("bad_note")), ("break", F.col("bad_cut")), ("line", F.col("odd")),
        ("incomplete", F.col("end_at").isNull() | (F.col("n_notes") == 0) | empty("TITLE") | empty("ARTIST") | empty("MP3") | empty("BPM")),
        ("grid", ~F.col("BPM").eqNullSafe(F.lit("300")) | ~F.col("GAP").eqNullSafe(F.lit("0"))), ("media", unsafe("MP3") | unsafe("VIDEO") | unsafe("COVER")),
    ]
    found = F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])), ";")
    g = df.select(key).join(g, key, "left").withColumn("problems", F.when(F.col("n_notes").isNull(), "incomplete").otherwise(found))
    phrases = F.when(F.col("n_notes") > 0, F.col("n_cuts") + 1).otherwise(0)
    return g.select(key, (F.col("problems") == "").alias("valid"), F.coalesce("n_notes", F.lit(0)).alias("n_notes"), phrases.alias("n_phrases"), (F.col("stop") / 20).alias("end_seconds"), "problems")
