"""Topics: clusters of hashed words, fitted over all texts.

A text becomes a vector of DIM signed hash counts of its words of LETTERS bytes or
more, scaled to length SCALE and rounded, so that all sums below are sums of
integers and depend on no order.  The mean vector of a text's language is taken off
first (a table of means, joined by language, however many there are), so that topics cut
across languages.  K centres start from sign patterns
of the first dimensions and move ROUNDS times to the mean direction of their texts.
Every round reads the small table of vectors, never the texts.

Edge cases: a text without such words (null and empty texts too) has the topic
``none``; a very long text is one vector like any other; repeated texts have one
topic; ties go to the lower centre; an empty table has no topics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm import textvec as T
from quaver.llm.shared import map_arrow
from quaver.llm.sketch import dense_sum

DIM, LETTERS, SCALE, K, ROUNDS = 64, 5, 100, 8, 4
#: Languages whose sums a task holds before it sends them.
HELD = 4096
NONE = "none"


def vector(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, DIM) int8: signed counts of hashed words, scaled to length SCALE."""
    st, en, h, wo = T.words(data, off)
    keep = (en - st) >= LETTERS
    h, doc = h[keep], T.by_text(wo)[keep]
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    n = len(off) - 1
    v = np.bincount(doc * DIM + (h % np.uint64(DIM)).astype(np.int64), sign, n * DIM).reshape(n, DIM)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.rint(v / np.maximum(norm, 1e-9) * SCALE).astype(np.int8)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.int8).reshape(-1, DIM).astype(np.int64)


def _sums(codes: np.ndarray, v: np.ndarray, groups: int) -> np.ndarray:
    """Per group: DIM sums, then the number of rows, padded to a multiple of the slices."""
    out = np.zeros((groups, DIM + 16), np.int64)
    np.add.at(out[:, :DIM], codes, v)
    np.add.at(out[:, DIM], codes, 1)
    return out.ravel()


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(v @ centres.T, axis=1)


def means(rows: DataFrame) -> DataFrame:
    """(lang, mean: DIM whole numbers) of rows (lang, vector), for any number of languages: tasks add up their own, Spark the tasks'."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            v = _rows(b.column(1))
            names, code = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True) if len(v) else ([], [])
            keep = v.any(axis=1)
            for name, x in zip(names, _sums(code[keep], v[keep], len(names)).reshape(-1, DIM + 16) if len(v) else [], strict=True):
                total[name] = total[name] + x if name in total else x
            if len(total) > HELD:
                yield out(total)
                total = {}
        yield out(total)

    def out(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        x = np.array(list(total.values()), np.int64).reshape(-1, DIM + 16)
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(DIM + 1))], ["lang", *names])

    names = [f"s{i}" for i in range(DIM + 1)]
    parts = map_arrow(rows.select("lang", "vector"), add, "lang string, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("lang").agg(*(F.sum(n).alias(n) for n in names))
    n = F.greatest(F.lit(1), F.col(names[-1]))
    return sums.select("lang", F.array(*(F.rint(F.col(c) / n).cast("int") for c in names[:-1])).alias("mean"))


def centred(rows: DataFrame, mean: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the language's mean taken off ``vector`` (its last column, int16 now); a vector of zeros becomes empty.

    ``few``: the means are known to be small enough for every task to have them all.
    """
    both = rows.join((F.broadcast(mean) if few else mean).withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).select(*rows.columns, "mean")
    n = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column(n))
            some, v = v.any(axis=1), (v - b.column(n + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)).astype("<i2")
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([x.tobytes() if y else b"" for x, y in zip(v, some, strict=True)], pa.binary())], b.schema.names[: n + 1])

    return map_arrow(both, run, rows.schema)


def _centred(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors that are not empty, where they are)."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i2").reshape(-1, DIM).astype(np.int64), np.flatnonzero([len(x) > 0 for x in raw])


def fit(rows: DataFrame) -> np.ndarray:
    """Centres of rows with ``vector`` as ``centred`` leaves it."""
    some = rows.select("vector")

    def total(of) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(K * (DIM + 16), np.int64)
            for b in batches:
                v, _ = _centred(b.column(0))
                out += _sums(of(v), v, K)
            return out

        return dense_sum(some, count, K * (DIM + 16)).reshape(K, DIM + 16)

    # first centres: the sign patterns of three directions that no word prefers
    signs = np.where(np.random.default_rng(1).integers(0, 2, (3, DIM)), 1, -1)
    sums = total(lambda v: (v @ signs.T > 0) @ np.array([1, 2, 4]))
    for _ in range(ROUNDS):
        centres = unit(sums)
        sums = total(lambda v, centres=centres: nearest(v, centres))
    return unit(sums)


def unit(sums: np.ndarray) -> np.ndarray:
    """Directions of the centres in whole numbers; a centre without texts is 0 and wins only ties."""
    v = sums[:, :DIM].astype(float)
    return np.rint(v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9) * 1000).astype(np.int64)


def assign(v: np.ndarray, mean: np.ndarray, centres: np.ndarray) -> list[str]:
    """Topics of vectors whose languages' means are ``mean``."""
    best = nearest(v.astype(np.int64) - mean, centres)
    return [f"t{i}" if some else NONE for i, some in zip(best.tolist(), v.any(axis=1).tolist(), strict=True)]


def name_topics(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``topic`` in place of the centred ``vector`` (its last column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, at = _centred(b.column(b.num_columns - 1))
            topics = np.full(b.num_rows, NONE, object)
            topics[at] = [f"t{i}" for i in nearest(v, centres).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(topics.tolist(), pa.string())], [*b.schema.names[:-1], "topic"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", topic string"
    return map_arrow(rows, run, schema)
