"""Canonical digests, resampled chunks and order statistics against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.operators import evaluation as E
from quaver.operators.digests import corpus_digest
from quaver.operators.resampling import channel_mean, low_pass, polyphase, ratio, resample

RECORD = "id long, text string, path string"


def digest(spark, rows, parts=3):
    df = spark.createDataFrame(rows, RECORD).repartition(parts)
    (one,) = corpus_digest(df, "id", drop=["path"]).collect()
    return one.digest


def test_digest_hangs_on_the_records_alone(spark):
    rows = [(i * 37, f"text {i}", f"/x/{i}") for i in range(300)] + [(5, "twice", "p"), (5, "twice", "q"), (5, "other", "p"), (None, "no id", "p"), (-4, None, "p")]
    base = digest(spark, rows)
    assert base == digest(spark, rows[::-1], 7)
    assert base == digest(spark, [(i, t, "/elsewhere") for i, t, _ in rows])  # a dropped column does not count
    assert base != digest(spark, rows[1:])
    assert base != digest(spark, [*rows, (5, "twice", "p")])  # repeated records are counted
    assert base != digest(spark, [(i, "changed" if i == 37 else t, p) for i, t, p in rows])
    swapped = [(rows[1][0], rows[0][1], ""), (rows[0][0], rows[1][1], ""), *rows[2:]]
    assert base != digest(spark, swapped)
    assert base != digest(spark, [(i, "" if t is None else t, p) for i, t, p in rows])  # null is not empty
    grouped = spark.createDataFrame(rows, RECORD).withColumn("g", F.when(F.col("id") < 1000, "low").otherwise("high"))
    assert {r.g for r in corpus_digest(grouped, "id", ["g"], ["path", "g"]).collect()} == {"low", "high"}
    assert corpus_digest(grouped.where("false"), "id", ["g"]).collect() == []


@pytest.mark.parametrize(("rate", "wanted"), [(48000, 16000), (44100, 16000), (16000, 24000), (8000, 8000)])
def test_resampling_is_one_convolution(spark, rate, wanted):
    """Chunks of any length, shorter than the filter's reach too, against the sum over the whole signal."""
    up, down = ratio(rate, wanted)
    taps = low_pass(up, down)
    rng = np.random.default_rng(rate)
    signals = {1: rng.standard_normal(500), 2: np.sin(np.arange(90) / 5), 3: np.zeros(0)}
    rows = []
    for rec, x in signals.items():
        at, chunk = 0, 0
        while at < len(x) or not chunk:
            n = int(rng.integers(0, 120)) if chunk else 3
            rows.append((rec, chunk * 2, [float(v) for v in x[at : at + n]]))
            at, chunk = at + n, chunk + 1
    got = resample(spark.createDataFrame(rows, "rec int, chunk int, x array<double>").repartition(4), ["rec"], "chunk", "x", up, down).collect()
    for rec, x in signals.items():
        made = np.concatenate([np.zeros(0), *(r.x for r in sorted((r for r in got if r.rec == rec), key=lambda r: r.chunk))])
        assert len(made) == -(-len(x) * up // down)
        stuffed = np.zeros(max(1, len(x) * up))
        stuffed[: len(x) * up : up] = x
        whole = np.convolve(stuffed, taps)[len(taps) // 2 :][: len(x) * up : down]
        assert np.allclose(made, whole[: len(made)], atol=1e-9)


def test_low_pass_keeps_a_constant():
    x = np.ones(4000)
    y = polyphase(x, 0, 200, 300, 160, 441, low_pass(160, 441))
    assert np.abs(y - 1).max() < 1e-3


def test_channels(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 6.0, 9.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(channel_mean(F.col("x"), 2)).collect()] == [[2.0, 4.0], []]


@pytest.mark.parametrize("held", [10, 10**6])
def test_order_statistics_by_either_way(spark, held):
    """Groups of one value, of many equal ones, null groups and large ones, in order at once or by parts."""
    rng = np.random.default_rng(3)
    groups = {"one": [5.0], "two": [1.0, 2.0], "same": [7.0] * 40, "many": rng.integers(0, 1000, 3000).astype(float).tolist(), None: [3.0, 1.0, 2.0] * 9}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    at = lambda n: F.array(F.floor(n / 2).cast("long"), (n - 1).cast("long"), F.lit(0).cast("long"))
    got = {r.g: r for r in E.values_at(df, ["g"], "v", at, held).collect()}
    for g, vs in groups.items():
        s = sorted(vs)
        assert (got[g].n, got[g].largest) == (len(s), s[-1])
        assert got[g].found == {len(s) // 2: s[len(s) // 2], len(s) - 1: s[-1], 0: s[0]}


def test_no_distinct_values_of_a_large_group_are_kept(spark, monkeypatch, tmp_path):
    """A large group leaves a row with its cuts, not a table of its values."""
    folders = []
    monkeypatch.setattr(E, "scratch", lambda _, name: folders.append(f"{tmp_path}/{name}{len(folders)}") or folders[-1])
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 0.5).alias("v"))
    got = {r.g: (r.n, r.largest, r.found) for r in E.values_at(df, ["g"], "v", lambda n: F.array(F.lit(0).cast("long"), n - 1), 100).collect()}
    assert got == {g: (10_000, (19_998 + g) * 0.5, {0: g * 0.5, 9_999: (19_998 + g) * 0.5}) for g in (0, 1)}
    assert sum(spark.read.parquet(f).count() for f in folders) == 2
