"""Fill-in-the-middle texts: a prefix, a middle and a suffix in a new order between sentinels.

A text is cut by units, which a pattern matches from left to right (code points by
default).  Two streaming passes find the cuts: the first counts the matches, the second
advances a fresh lazy match iterator to the two ranks drawn for the row.  No list of
units is ever stored, so beside the text and the output memory is constant.

Draws come from sha256 of ``<seed>:<id>``, so they do not hang on partitions or reruns.
``restore`` reads a text back from output and form alone: a text that holds a sentinel
stays plain, and no sentinel can arise across a seam, as sentinels that share a
beginning with another's end are refused.

Edge cases: a null text is the empty one; an empty text is plain; a text without a unit
is cut at 0; a null id draws as the empty id; repeated rows and rows of one id draw alike
(cuts hang on their own lengths), so there are no ties; what follows the last unit
belongs to the last part; texts may be very long; other columns are kept where they are
named in ``keep`` and may have any name but the results'; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.shared import map_arrow

CODE_POINT = r"(?s:.)"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, SPM = 90, 20
RESULTS = (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"))


def units(match: re.Pattern, text: str) -> int:
    """First pass: the number of matches, none of them kept."""
    ticks = count()
    deque(zip(match.finditer(text), ticks), maxlen=0)
    return next(ticks)


def ends(match: re.Pattern, text: str, ranks: Sequence[int]) -> list[int]:
    """Second pass: where the units of the given rising ranks end; 0 for rank 0."""
    found, at, end, out = match.finditer(text), 0, 0, []
    for rank in ranks:
        if rank > at:
            end = next(islice(found, rank - at - 1, None)).end()
            at = rank
        out.append(end)
    return out


def check_sentinels(sentinels: Sequence[str]) -> None:
    if len(sentinels) != 3 or not all(sentinels):
        raise ValueError("three sentinels are needed, none of them empty")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j))) or (i != j and b in a):
                raise ValueError(f"the sentinels {a!r} and {b!r} could be misread across a seam")


def arrange(match: re.Pattern, text: str, draws: Sequence[int], sentinels: Sequence[str], plain: int, spm: int) -> tuple:
    """(units, form, prefix and middle characters, output) of one text."""
    n = units(match, text)
    if not text or draws[2] % 100 >= plain or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    a, b = ends(match, text, sorted(d % (n + 1) for d in draws[:2]))
    p, s, m = sentinels
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def fill_in_middle(
    df: DataFrame, *, text: str = "text", id: str = "doc_id", keep: Sequence[str] = ("doc_id",), seed: int = 1, unit: str = CODE_POINT, sentinels: Sequence[str] = SENTINELS, plain: int = PLAIN, spm: int = SPM
) -> DataFrame:
    """``keep`` and n, form, prefix_chars, middle_chars, output.

    ``plain``: rows whose third draw is at least that, of 100, stay as they are; ``spm``:
    of the others, the share of 100 that puts the suffix first.
    """
    check_sentinels(sentinels)
    if taken := {n for n, _ in RESULTS} & set(keep):
        raise ValueError(f"kept columns have the results' names: {sorted(taken)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = re.compile(unit)
        for b in batches:
            rows = [arrange(match, t.as_py() or "", [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)], sentinels, plain, spm) for t, h in zip(b.column(width), b.column(width + 1).to_pylist(), strict=True)]
            made = list(zip(*rows, strict=True)) or [()] * len(RESULTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(x, pa.int64() if kind == "long" else pa.string()) for x, (_, kind) in zip(made, RESULTS, strict=True))], [*keep, *(n for n, _ in RESULTS)])

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, T.LongType() if kind == "long" else T.StringType()) for n, kind in RESULTS)])
    return map_arrow(df.select(*keep, F.col(text).alias("_text"), digest.alias("_draws")), run, schema)


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text behind an output; JVM-side."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows each sentinel, in the output's order."""
        x = F.locate(second, output)  # the parts hold none, so the first one is the seam
        y = F.call_function("locate", F.lit(m), output, x)
        return (
            F.substring(output, F.lit(len(first) + 1), x - len(first) - 1), F.substring(output, x + len(second), y - x - len(second)),
            F.substring(output, y + len(m), F.length(output)),
        )

    prefix, suffix, middle = parts(p, s)
    late, early, inner = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, inner, late)).otherwise(output)


def q_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, rearranged and read back."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
