"""The status machine: batch and stream against a plain loop, restarts, crashes."""

import random

import pytest
from pyspark.sql import functions as F

from quaver.operators.ranges import last_known, numbered, ranged
from quaver.streaming.machine import SONGS, follow, replay

HOUR = 3_600_000_000
FIGURES = ("status", "elapsed", "starts", "refused", "crashes", "updated")
SCHEMA = "job long, at long, id long, wish string"


def log(seed, n=1500):
    rng, at, rows = random.Random(seed), 10**15, []
    for i in range(n):
        at += rng.randint(0, HOUR // 3) if rng.random() > 0.02 else 13 * HOUR
        # one job has most of the entries, one none of an id
        rows.append((rng.choice([1] * 9 + [2, 3, None]), at, i, rng.choice([*SONGS.wishes, "progress", "claim", "no such wish", None])))
    return rows


def by_loop(rows):
    """The rules, entry by entry."""
    jobs = {}
    end = max(at for _, at, _, _ in rows)
    for job, at, _, wish in [*rows, *((j, end, 0, "the end") for j in {r[0] for r in rows})]:
        s = jobs.setdefault(job, {"status": "queued", "elapsed": 0, "starts": 0, "refused": 0, "crashes": 0, "updated": at})
        if s["status"] in ("running", "stopping"):
            if at - s["updated"] > 12 * HOUR:
                s["status"], s["crashes"] = ("queued" if s["status"] == "running" else "cancelled"), s["crashes"] + 1
            elif wish != "the end":
                s["elapsed"] += at - s["updated"]
        if wish == "the end":
            continue
        goal = SONGS.rules.get((s["status"], wish))
        s["refused"] += goal is None
        s["starts"] += goal == "running" and s["status"] == "queued"
        s["status"], s["updated"] = goal or s["status"], at
    return jobs


def figures(df):
    return {r.job: {c: r[c] for c in FIGURES} for r in df.collect()}


def test_replay_in_ranges(spark):
    for seed in range(3):
        rows = log(seed)
        df = spark.createDataFrame(rows, SCHEMA).withColumn("status", F.lit("x"))
        want = by_loop(rows)
        assert want[1]["crashes"] + want[2]["crashes"] > 0 and want[1]["starts"] > 10
        for size in (10**6, 100):  # in one range, and the large job over many
            assert figures(replay(df, rows=size)) == want
    assert replay(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranges_are_folded_in_tasks_of_their_own(spark):
    """However few bytes they have; times may be null where a job goes over an edge."""
    rows = [(job, 10**15 + i * HOUR // 9 if job or i > 40 else None, i, wish) for job in range(2) for i, wish in enumerate(["claim", "progress", "pause", "resolve"] * 300)]
    out = replay(spark.createDataFrame(rows, SCHEMA), rows=60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan and "REPARTITION_BY_NUM" in plan.split("hashpartitioning(_part", 1)[1].split("\n", 1)[0]
    got = figures(out)
    assert got == figures(replay(spark.createDataFrame(rows, SCHEMA), rows=10**6)) and got[1] == by_loop([r for r in rows if r[0]])[1]


def test_time_counts_while_running_only(spark):
    s = 1_000_000
    pauses = [(1, 200 * s, 1, "claim"), (1, 215 * s, 2, "fail"), (1, 300 * s, 3, "retry"), (1, 300 * s, 4, "claim"), (1, 320 * s, 5, "complete")]
    crash = [(2, 100 * s, 1, "claim"), (2, 110 * s, 2, "progress"), (2, 110 * s + 13 * HOUR, 3, "progress")]  # the downtime does not count
    got = figures(replay(spark.createDataFrame(pauses + crash, SCHEMA)))
    assert (got[1]["elapsed"], got[1]["status"]) == (35 * s, "completed")
    assert (got[2]["elapsed"], got[2]["status"], got[2]["crashes"], got[2]["refused"]) == (10 * s, "queued", 1, 1)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = log(5, 600)
    # the last entries of the others lie long before the end: only a timer can tell that they crashed
    rows += [(9, rows[-1][1] + 1, 600, "claim"), (1, rows[-1][1] + 20 * HOUR, 601, "progress")]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part, some in (("a", "id < 300"), ("b", "id >= 300")):
            df.where(some).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
            stream = follow(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
            write = lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")
            query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("job").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
    got = figures(last)
    assert got == by_loop(rows) == figures(replay(df, rows=50))
    assert got[9]["status"] == "queued" and got[9]["crashes"] == 1


@pytest.mark.parametrize("rows", [10, 10**6])
def test_last_known_over_range_edges(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, None, i])) for i in range(500)] + [(7, 1, None)]
    seen, want = {}, {}
    for k, i, v in data:
        seen[k] = v if v is not None else seen.get(k)
        want[k, i] = seen[k]
    df = spark.createDataFrame(data, "k long, at long, v long")
    got = last_known(ranged(df, ["k"], ["at"], rows), ["k"], ["at"], F.col("v"), "last")
    assert {(r.k, r.at): r.last for r in got.collect()} == want
    places = {}
    for k, at, _ in sorted(data, key=lambda x: x[1]):
        places.setdefault(k, []).append(at)
    got = numbered(ranged(df, ["k"], ["at"], rows), ["k"], ["at"], "place")
    assert {(r.k, r.place): r.at for r in got.collect()} == {(k, i): at for k, ats in places.items() for i, at in enumerate(ats)}
