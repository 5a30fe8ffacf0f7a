"""Stitched windows against the rules written out for one recording after the other."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quaver.operators.stitching import REACH, stitch
from quaver.plans.registry import ORACLES, QUERIES

WORDS = "array<struct<key:string,word:string,start:double,stop:double,chars:array<struct<char:string,start:double,stop:double>>>>"
SCHEMA = f"rec int, seg int, window_start double, core double, language string, words {WORDS}"


def word(text, start, stop):
    step = (stop - start) / len(text)
    return (text.lower(), text, start, stop, [(c, start + i * step, start + (i + 1) * step) for i, c in enumerate(text)])


def by_rules(segments):
    """{seg: (text, conflict, uncertain, words)}: everything from left to right."""
    kept = []
    for seg, _, core, language, words in sorted(segments, key=lambda s: (s[1], s[0])):
        new = [dict(zip(("key", "word", "start", "stop", "chars"), w, strict=True), estimated=False) for w in words]
        flags = {"conflict": False, "uncertain": False}
        if kept and new:
            old, old_flags = kept[-1][2], kept[-1][3]
            best = 0
            for k in range(1, min(len(old), len(new), REACH) + 1):
                if all(a["key"] == b["key"] and max(a["start"], b["start"]) < min(a["stop"], b["stop"]) for a, b in zip(old[-k:], new[:k], strict=True)):
                    best = k
            new = new[best:]
            if new and new[0]["start"] < old[-1]["stop"]:
                old = [w for w in old if w["start"] + w["stop"] < 2 * core]
                new = [w for w in new if w["start"] + w["stop"] >= 2 * core]
                if old and new and new[0]["start"] < old[-1]["stop"]:
                    old[-1] = {**old[-1], "stop": min(core, old[-1]["stop"]), "estimated": True}
                    new[0] = {**new[0], "start": max(core, new[0]["start"]), "estimated": True}
                    for side in (old, new):
                        w = side[-1] if side is old else side[0]
                        w["chars"] = [(c, max(a, w["start"]), min(z, w["stop"])) for c, a, z in w["chars"] if max(a, w["start"]) < min(z, w["stop"])]
                    old_flags["uncertain"] = flags["uncertain"] = flags["conflict"] = True
                kept[-1] = (*kept[-1][:2], old, old_flags)
                if not old:
                    kept.pop()
        if new:
            kept.append((seg, language, new, flags))
    return {seg: ("".join(w["word"].strip() for w in ws) if g == "ja" else " ".join(w["word"].strip() for w in ws), f["conflict"], f["uncertain"], [(w["word"], w["start"], w["stop"], w["estimated"], tuple(w["chars"])) for w in ws]) for seg, g, ws, f in kept}


def run(spark, recordings, **options):
    rows = [(rec, *s) for rec, segments in recordings.items() for s in segments]
    out = {rec: {} for rec in recordings}
    for r in sorted(stitch(spark.createDataFrame(rows, SCHEMA), **options).collect(), key=lambda r: (r.window_start, r.seg)):
        words = [(w.word, w.start, w.stop, w.estimated, tuple(tuple(c) for c in w.chars)) for w in r.words]
        assert (r.start, r.stop, r.estimated) == (words[0][1], words[-1][2], r.uncertain)
        out[r.rec][r.seg] = (r.text, r.conflict, r.uncertain, words)
    return out


def seg(n, start, core, *words, language="en"):
    return (n, float(start), float(core), language, [word(*w) for w in words])


def test_seams(spark):
    recordings = {
        1: [seg(0, 0, 0, ("one", 1.0, 2.0), ("two", 20.0, 21.0)), seg(1, 19, 20, ("Two", 20.2, 21.2), ("three", 22.0, 23.0))],  # said once
        2: [seg(0, 0, 0, ("two", 10.0, 11.0)), seg(1, 19, 20, ("two", 20.0, 21.0))],  # said twice, far apart
        3: [seg(0, 0, 0, ("two", 19.0, 20.0)), seg(1, 19, 20, ("two", 20.0, 21.0))],  # touching is not overlapping
        4: [seg(0, 0, 0, ("left", 19.0, 20.4)), seg(1, 19, 20, ("right", 19.8, 21.0))],  # cut at the core, characters too
        5: [seg(0, 0, 0, ("a", 18.0, 19.0), ("late", 20.1, 21.1)), seg(1, 19, 20, ("early", 19.2, 19.7), ("b", 20.5, 21.5))],  # owned by the middle
        6: [seg(0, 0, 0, ("xx", 1.0, 3.0), language="ja"), seg(1, 2, 2.5, ("yy", 4.0, 5.0), language="ja")],
        7: [],
    }
    got = run(spark, recordings)
    assert got == {rec: by_rules(s) for rec, s in recordings.items()}
    assert [x[0] for x in got[1].values()] == ["one two", "three"] and len(got[2]) == len(got[3]) == 2
    (_, no, yes, left), (_, conflict, _, right) = got[4][0], got[4][1]
    assert (no, yes, conflict) == (False, True, True) and left[0][2] == right[0][1] == 20.0 and left[0][3] and right[0][3]
    assert left[0][4][-1][2] == 20.0 and right[0][4][0][1] == 20.0
    assert [x[0] for x in got[5].values()] == ["a", "b"]


@pytest.mark.parametrize("seed", range(3))
def test_random_windows(spark, seed):
    """Regular windows, and short ones that hang on each other, empty ones and ties, in ranges of a few windows."""
    rng = random.Random(seed)
    recordings = {}
    for rec in range(30):
        said, at = [], 0.0
        for _ in range(rng.randint(1, 120)):
            length = rng.uniform(0.2, 0.9)
            said.append((rng.choice(["la", "Oh", "sun", "moon", "river", "stone"]), at, at + length))
            at += length + rng.choice([0, 0, 0.1])
        size, step = rng.choice([(20, 17), (10, 4), (5, 2), (3, 1), (40, 5)]), 0
        segments = []
        for n in range(0, max(1, len(said) // size[1])):
            part = said[n * size[1] : n * size[1] + size[0]]
            heard = [word(t if rng.random() > 0.1 else "mm", a + rng.uniform(-0.1, 0.1), z + rng.uniform(-0.05, 0.15)) for t, a, z in part if rng.random() > 0.05]
            begin = part[0][1] if part else at
            segments.append((n, round(begin, 0) if rng.random() < 0.2 else begin, begin + rng.uniform(0, 1.5), rng.choice(["en", "ja"]), heard))
        recordings[rec] = segments
    want = {rec: by_rules(s) for rec, s in recordings.items()}
    for rows in (7, 10_000):
        assert run(spark, recordings, rows=rows) == want


def test_one_long_recording_is_spread(spark):
    said = [(f"w{i}", i * 0.5, i * 0.5 + 0.5) for i in range(3400)]
    segments = [seg(n, n * 8.5, n * 8.5 + 0.75, *said[n * 17 : n * 17 + 20]) for n in range(200)]
    got = run(spark, {1: segments}, rows=20)
    assert got == {1: by_rules(segments)}
    assert " ".join(got[1][n][0] for n in range(200)) == " ".join(w for w, *_ in said)


def test_odd_windows(spark):
    assert run(spark, {}) == {}
    rows = [(7, 1, 0.0, 0.0, None, [word("a", 0.0, 1.0)]), (7, 2, 1.0, 1.0, None, None), (7, 3, 2.0, 2.0, None, []), (7, 4, 3.0, 3.0, None, [None, word("b", 4.0, 5.0)]), (None, 1, 0.0, 0.0, None, [word("a", 0.0, 1.0)])]
    got = stitch(spark.createDataFrame(rows, SCHEMA)).orderBy("seg").collect()
    assert [(r.rec, r.seg, r.text) for r in got] == [(7, 1, "a"), (7, 4, "b")]


def test_words_never_become_rows(spark):
    """A word that is a row of its own made the job's time and disk grow with the words, several times over."""
    said = [(f"w{i}", i * 0.5, i * 0.5 + 0.5) for i in range(100)]
    out = stitch(spark.createDataFrame([(1, *seg(n, n * 8.5, n * 8.5 + 0.75, *said[n * 17 : n * 17 + 20])) for n in range(6)], SCHEMA))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_windows_that_say_their_words_late(spark):
    """With ``hear``, only what the words are made from travels; the result is the same, over edges of ranges too."""
    rng = random.Random(5)
    segments = [(rec, n, n * 8.5, n * 8.5 + 0.75, "en", " ".join(rng.choice("abc") for _ in range(20))) for rec in range(3) for n in range(rng.randint(1, 40))]
    said = spark.createDataFrame(segments, "rec int, seg int, window_start double, core double, language string, said string")

    def hear(*fields):
        def of(w, i):
            start, stop = F.col("window_start") + i * 0.5 - 0.125 * (F.col("seg") % 2), F.col("window_start") + i * 0.5 + 0.5
            have = {"key": w, "word": w, "start": start, "stop": stop, "chars": F.array(F.struct(w.alias("char"), start.alias("start"), stop.alias("stop")))}
            return F.struct(*[have[f].alias(f) for f in fields])

        return F.transform(F.split("said", " "), of)

    whole = said.withColumn("words", hear("key", "word", "start", "stop", "chars")).drop("said")
    want = stitch(whole).orderBy("rec", "seg").collect()
    assert want and any(r.conflict for r in want)
    for rows in (4, 10_000):
        assert stitch(said, rows, hear).orderBy("rec", "seg").collect() == want


def test_query_on_odd_rows(spark, tmp_path):
    """No conversation's id, no turn, several rows of one turn, and one conversation in many ranges."""
    text = " ".join(f"w{i}" for i in range(45))
    rows = [(None, 0, text), (None, 1, "x y"), (1, None, "last words"), (1, 0, text), (1, 2, None), (2, 0, text), (2, 0, text), (2, 1, ""), (2, 1, " the end "), (3, 0, None)]
    rows += [(4, t, " ".join(f"t{t}w{i}" for i in range(t % 30))) for t in range(200)]
    rows = [(c, t, "user", x) for c, t, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(ORACLES["stitch"])
    got = QUERIES["stitch"](spark, str(tmp_path)).select(*want.columns).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
