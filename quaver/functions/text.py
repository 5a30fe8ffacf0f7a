"""Text functions: four different normalisers (kept apart on purpose), units, parsing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalized(c: Column) -> Column:
    """Letters and digits, lower case (without NFKC)."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(StringType())
def normalized_exact(s: pd.Series) -> pd.Series:
    """NFKC, case folding, letters and digits."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKC", x).casefold() if ch.isalnum()))


def units(c: Column, lang: Column) -> Column:
    """Scoring units: characters for Japanese, else words with inner apostrophes."""
    low = F.regexp_replace(F.lower(c), "’", "'")
    chars = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]"), F.lit(0))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"), F.lit(0))
    return F.when(lang == "ja", chars).otherwise(words)


def excerpt_words(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores; one spelling is modernised."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), "auld", "old"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def comparison(c: Column) -> Column:
    """Lower case without separators and marks."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")


def clean(c: Column) -> Column:
    """Control characters become spaces; trimmed."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " "))


def script(c: Column) -> Column:
    """ja for kana, ko for hangul, else null."""
    return F.when(c.rlike(r"[぀-ヿ]"), "ja").when(c.rlike(r"[가-힯]"), "ko")


def join_words(words: Column, lang: Column) -> Column:
    """Trimmed words joined by a space, or by nothing in languages without them."""
    trimmed = F.transform(words, lambda w: F.trim(w))
    return F.trim(F.when(lang.isin("ja", "zh"), F.array_join(trimmed, "")).otherwise(F.array_join(trimmed, " ")))


def stamp_seconds(minutes: Column, seconds: Column, offset_ms: Column) -> Column:
    """A minute:second stamp with an offset, never below 0."""
    return F.greatest(F.lit(0.0), minutes.cast("double") * 60 + seconds.cast("double") + offset_ms.cast("double") / 1000)


def bytes_label(n: Column) -> Column:
    """1.5 GB, 20 MB, 3 kB."""
    return F.when(n >= 1e9, F.format_string("%.1f GB", n / 1e9)).when(n >= 1e6, F.format_string("%.0f MB", n / 1e6)).otherwise(F.format_string("%.0f kB", n / 1e3))


def clock_label(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)
