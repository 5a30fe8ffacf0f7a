"""Timed lyric text: tags, an offset, one or more stamps a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.functions.text import stamp_seconds

STAMP = r"\[(\d+):([0-5]?\d(?:\.\d+)?)\]"


def parse(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, line, start, text) of every stamp, in time order; lines at one time are joined in order."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n|\r")).alias("pos", "raw"))
    found = F.regexp_extract_all(text, F.lit(r"(?mi)^\[offset:\s*([+-]?\d+)\s*\]"), F.lit(1))
    offset = df.select(key, F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("double"), F.lit(0.0)).alias("_off"))
    stamps = lines.select(key, "pos", F.regexp_replace("raw", r"\[[^\]]*\]", "").alias("text"), F.explode(F.regexp_extract_all("raw", F.lit(STAMP), F.lit(0))).alias("s"))
    at = stamp_seconds(F.regexp_extract("s", STAMP, 1), F.regexp_extract("s", STAMP, 2), F.col("_off"))
    timed = stamps.join(offset, key).select(key, "pos", F.trim("text").alias("text"), at.alias("start"))
    merged = timed.groupBy(key, "start").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    merged = merged.select(key, "start", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    return merged.withColumn("line", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)


def problems(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, problem) of texts that are no lyrics: impossible stamps, timed and untimed lines mixed, nothing at all."""
    lines = df.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n|\r")).alias("raw"))
    body = lines.where("trim(raw) <> ''").where(~F.col("raw").rlike(r"^\s*\[[a-zA-Z]+:.*\]\s*$"))
    timed = F.col("raw").rlike(r"^\s*" + STAMP)
    odd = F.col("raw").rlike(r"^\s*\[\d+:") & ~timed
    g = body.groupBy(key).agg(F.bool_or(odd).alias("odd"), F.bool_or(timed).alias("some"), F.bool_and(timed | odd).alias("all"))
    out = df.select(key).join(g, key, "left")
    return out.select(key, F.when(F.col("some").isNull(), "empty").when(F.col("odd"), "stamp").when(F.col("some") & ~F.col("all"), "mixed").alias("problem"))
