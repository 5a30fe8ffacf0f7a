"""Strict delimited ingest: all rows of a file or none, with the row and reason of what is wrong first."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.functions import rules as R

#: The headers, and the limits of a file, of its rows and of a link.
COLUMNS = ["url", "artist", "song_name", "language_code"]
HEADERS = (COLUMNS[:3], COLUMNS)
MAX_BYTES, MAX_ROWS, MAX_LINK = 1 << 20, 50, 2048


def _parse(text: str) -> Iterator[tuple]:
    """(row, values or Nones, problem) of a file's rows, up to the first that is no row."""
    none = (None,) * 4
    if len(text.encode()) > MAX_BYTES:
        yield (0, *none, "file too large")
        return
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=True)
    at, songs = 1, 0
    try:
        head = [x.strip().lower() for x in next(reader, [])]
        if head not in HEADERS:
            yield (1, *none, "header")
            return
        for at, row in enumerate(reader, 2):
            values = [x.strip() for x in row]
            if not any(values):
                continue
            problem = "columns" if len(row) != len(head) else "too many rows" if songs >= MAX_ROWS else None
            yield (at, *(values + [None] * 4)[:4], problem)
            if problem:
                return
            songs += 1
    except csv.Error:
        yield (at, *none, "quoting")
        return
    if not songs:
        yield (at, *none, "no songs")


def ingest(files: DataFrame) -> DataFrame:
    """(file, row, url, artist, song_name, language, bad_row, problem) of files (file, content).

    Every file's rows are kept or refused together: ``problem`` and ``bad_row`` are the
    file's first, null for a file that is taken; a refused file has one row, its bad one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(f, *x) for f, text in zip(part["file"], part["content"], strict=True) for x in _parse(text or "")]
            yield pd.DataFrame(out, columns=["file", "row", *COLUMNS, "problem"])

    rows = files.select("file", "content").mapInPandas(run, f"file {files.schema['file'].dataType.simpleString()}, row int, url string, artist string, song_name string, language_code string, problem string")
    language = F.lower(F.coalesce("language_code", F.lit("")))
    settings = R.settings_problems(F.col("song_name"), F.col("artist"), language, F.lit(None).cast("string"))
    link = R.video_url(F.col("url"))
    own = F.coalesce("problem", F.when(F.length("url") > MAX_LINK, "link too long"), F.when(link.isNull(), "link"), F.when(settings != "", settings))
    rows = rows.withColumn("problem", own)
    first = F.min(F.when(F.col("problem").isNotNull(), F.struct("row", "problem"))).over(Window.partitionBy("file"))
    rows = rows.withColumn("bad", first).where(F.col("bad").isNull() | (F.col("row") == F.col("bad.row")))
    good = F.col("bad").isNull()
    return rows.select("file", "row", F.when(good, link).alias("url"), F.when(good, F.col("artist")).alias("artist"), F.when(good, F.col("song_name")).alias("song_name"), F.when(good, language).alias("language"), F.col("bad.row").alias("bad_row"), F.col("bad.problem").alias("problem"))
