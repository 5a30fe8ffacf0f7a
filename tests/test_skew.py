"""Pairs within hot keys, closures of any depth, edit counts of whole texts: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.operators import compare as C
from quaver.operators import sequences as S


def test_pairs_in_tiles(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(400), i) for k, n in ((1, 150), (2, 3), (3, 1), (None, 5)) for i in range(n)]
    want = sorted((k, min(p, q)[1], max(p, q)[1]) for i, (k, *p) in enumerate(rows) for l, *q in rows[:i] if k is not None and k == l and p[0] != q[0])
    df = spark.createDataFrame(rows, "k long, o long, i long")
    for tile in (10, 1000):
        got = [(r.k, r.a.i, r.b.i) for r in C.pairs_within(df, ["k"], "o", tile).collect()]
        assert sorted(got) == want or sorted((k, min(a, b), max(a, b)) for k, a, b in got) == sorted((k, min(a, b), max(a, b)) for k, a, b in want)
        assert all(r.a.o < r.b.o for r in C.pairs_within(df, ["k"], "o", tile).collect())


def test_cross_in_tiles(spark):
    left = spark.range(130).select(F.when(F.col("id") < 100, 1).otherwise(2).alias("k"), F.col("id").alias("x"))
    right = spark.range(45).select(F.when(F.col("id") < 40, 1).otherwise(3).alias("k"), F.col("id").alias("y"))
    for tile in (7, 1000):
        got = [(r.k, r.a.x, r.b.y) for r in C.cross_within(left, right, ["k"], tile).collect()]
        assert len(got) == 4000 and set(got) == {(1, x, y) for x in range(100) for y in range(40)}


def test_a_hot_key_is_spread(spark):
    """One key with all rows: no task of the join gets more than its tiles' share of pairs."""
    df = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    pairs = C.pairs_within(df, ["k"], "o", 100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    total = sum(r["count"] for r in pairs)
    assert total == 3000 * 2999 // 2 and max(r["count"] for r in pairs) < total / 2


def reached(edges, invalid):
    out, size = set(invalid), -1
    while size != len(out):
        size = len(out)
        out |= {a for a, b in edges if b in out}
    return out


@pytest.mark.parametrize("case", range(4))
def test_downstream(spark, case):
    rng = random.Random(case)
    if case == 0:  # deep: log many rounds
        edges, invalid = [(i, i - 1) for i in range(1, 2000)], [5]
    elif case == 1:  # a cycle of odd length with no way in, and what stands on it
        edges, invalid = [(i, (i + 1) % 25) for i in range(25)] + [(100, 3), (101, 100), (101, 200), (7, 7)], [77]
    else:
        edges, invalid = list({(rng.randrange(40), rng.randrange(40)) for _ in range(30 * case)}), rng.sample(range(40), 2)
    e, i = spark.createDataFrame([*edges, (None, 1), (1, None)], "stage long, needs long"), spark.createDataFrame([(x,) for x in [*invalid, invalid[0]]], "stage long")
    got = [r.stage for r in C.downstream(e, i).collect()]
    assert len(got) == len(set(got)) and set(got) == reached(edges, invalid)


def by_table(ref, hyp):
    """(errors, substitutions, deletions, insertions), cell by cell."""
    rows = [[(j, 0, 0, j) for j in range(len(hyp) + 1)]]
    for i, a in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, b in enumerate(hyp, 1):
            corner, up, left = rows[-1][j - 1], rows[-1][j], row[-1]
            least = min(corner[0], up[0], left[0])
            if a == b:
                row.append(corner)
            elif corner[0] == least:
                row.append((least + 1, corner[1] + 1, *corner[2:]))
            elif up[0] == least:
                row.append((least + 1, up[1], up[2] + 1, up[3]))
            else:
                row.append((least + 1, *left[1:3], left[3] + 1))
        rows.append(row)
    return rows[-1][-1]


@pytest.mark.parametrize("stored", [3, 512])
def test_edit_counts(monkeypatch, stored):
    monkeypatch.setattr(S, "STORED", stored)
    rng = np.random.default_rng(stored)
    for _ in range(400):
        ref, hyp = (rng.integers(0, rng.integers(1, 6), rng.integers(0, 18)) for _ in range(2))
        want = by_table(ref.tolist(), hyp.tolist())
        assert S.edit_counts(ref, hyp) == want and S.edit_errors(ref, hyp) == want[0]
    ref, hyp = rng.integers(0, 40, 300), rng.integers(0, 40, 190)
    assert S.edit_counts(ref, hyp) == by_table(ref.tolist(), hyp.tolist())


def test_lookup_meets_each_question_once(spark):
    """Titles that ask the same, and records that answer the same, meet once, however often either is repeated."""
    wanted = spark.range(400).select("id", F.lit("A song").alias("title"), F.lit("Someone").alias("artist"), (F.col("id") % 4 * 2.0).alias("duration"))
    records = spark.range(600).select(
        F.col("id").alias("record_id"), F.lit("a Song").alias("title"), F.lit("someone!").alias("artist"), (F.col("id") % 3 * 5.0).alias("duration"), F.lit(None).cast("boolean").alias("instrumental"),
        F.when(F.col("id") % 3 == 0, "timed").alias("synced_text"), F.concat(F.lit("plain "), F.col("id") % 3).alias("plain_text"),
    )
    # more than one question of an id go together; a null id and rounding at the edge ask alone
    odd = spark.createDataFrame([(0, "A song", "Someone", 5.0), (None, "A song", "Someone", 0.0), (900, "A song", "Someone", 12.0), (901, None, "Someone", 1.0)], "id long, title string, artist string, duration double")
    out = C.lookup(wanted.union(odd), records)
    got = {(r.id, r.text, r.record_id, r.n_texts, r.needs_input) for r in out.collect()}
    # duration 0: timed; 2: timed; 4 and 6: plain 1 at 5; 12: plain 2 at 10; id 0 asks for 0 and 5
    want = {(i, "timed", 597, 1, False) if i % 4 < 2 else (i, "plain 1", 598, 1, True) for i in range(400)}
    assert got == want | {(None, None, None, 0, True), (900, "plain 2", 599, 1, True), (901, None, None, 0, True)}
    metrics = met_rows(out)
    assert metrics and max(metrics) <= 1000  # a pair of each title and record would be 400 x 600 / 3 at least


def met_rows(df):
    """Rows that each join of a query that ran gave."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return found
