"""The corpus operators against brute force, and on awkward tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quaver.llm import chatformat, decontam, kneserney, mixing, ngramjoin, quality, sharding, textvec, tokenfiles, toxicity, urlgraph
from quaver.llm.links import components
from quaver.llm.shared import new_folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim " * 3
ODD = [
    (1, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "de", "b", 3),
    (6, "one", "de", "b", 3), (7, "ONE", "de", "b", 3), (8, "word " * 60_000, "fr", "c", 1), (9, "é\u00a0x \u3000 y\n\nz", "fr", "c", 9), (10, LONG + "tail", "en", "a", 2), (None, "two words", "en", "a", 9), (12, "x" * 3_000_000, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t, fold=True):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER) if fold else t)


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns with the names that the operators use inside
    return spark.createDataFrame([(*r, "x", 5, 7.0) for r in ODD], SCHEMA + ", shard string, n int, h double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_word_kernel():
    sample = [t for *_, t in [(0, x[1]) for x in ODD]] + ["a" * 10 + " b" * 5]
    seen = {}
    for i, j, data, off in textvec.pieces(pa.array(sample)):
        st, en, h, wo = textvec.words(data, off)
        for d in range(i, j):
            w = words(sample[d])
            assert wo[d - i + 1] - wo[d - i] == len(w)
            for x, y in zip(w, h[wo[d - i] : wo[d - i + 1]].tolist(), strict=True):
                assert seen.setdefault(y, x) == x
    assert len(seen) == len({x for t in sample for x in words(t)})


# ---- sharding


def test_sharding(odd, empty):
    rows = sharding.shard_documents(odd, sharding.balanced(16)).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    size = {(r.doc_id, r["size"], r.text_crc32) for r in rows}
    assert size == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD}
    assert sharding.shard_documents(empty, sharding.balanced(4)).count() == 0


def test_sharding_descends_as_drawn(spark):
    """Every key by hand: the child with the least draw on each level, where a child weighs what its leaves do."""
    tree = [sharding.Leaf("a", "x", 0, 1.0), sharding.Leaf("a", "x", 1, 3.0), sharding.Leaf("a", "y", 2, 0.5), sharding.Leaf("b", "x", 3, 2.0), sharding.Leaf("b", "z", 4, 1.5)]

    def draw(key, path, weight):
        h = xxhash.xxh64(path.encode(), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def descend(key):
        at = tree
        for path in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
            weight = collections.Counter()
            for x in at:
                weight[path(x)] += x.weight
            best = min(weight, key=lambda c: draw(key, c, weight[c]))
            at = [x for x in at if path(x) == best]
        return at[0].shard

    got = {r.doc_id: r.shard for r in sharding.assign(spark.range(3000).withColumnRenamed("id", "doc_id"), tree).collect()}
    assert got == {i: descend(str(i)) for i in range(3000)} and set(got.values()) == set(range(5))


def test_sharding_confines_movement(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.balanced(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    a = {r.doc_id: r.shard for r in sharding.assign(ids, tree).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(ids, heavier).collect()}
    rack = {x.shard: (x.region, x.rack) for x in tree}
    region = rack[5][0]
    for k in a:  # keys move into the changed region, or within its changed rack or towards it
        if a[k] != b[k]:
            assert rack[b[k]][0] == region
    count = collections.Counter(b.values())
    assert count[5] > 2 * np.mean([count[s] for s in range(16) if s != 5])


# ---- n-gram join


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids, root = list(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "t", "percent"), [(3, "0.9", 90), (5, "0.8", 80)])
def test_ngram_join(docs, k, t, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_groups(docs, k, t).collect()}
    assert got == brute_groups(texts(docs), k, percent)


def test_ngram_join_odd(spark, odd, empty):
    got = {r.doc_id: r.component_id for r in ngramjoin.near_groups(odd, 3, "0.9").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 1, 12: 12, None: None}
    assert ngramjoin.near_groups(empty).count() == 0
    kept = ngramjoin.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 12]


def test_ngram_join_ids_need_not_be_unique(spark):
    """Rows are what links: the same rows in any order give the same groups, and one row of a group stays."""
    a, b = LONG.strip(), " ".join(f"v{i}" for i in range(60))
    rows = [(7, a), (7, b), (9, a + " tail"), (3, b + " tail"), (None, a + " end"), (None, a + " end"), (7, a), (5, "alone and short"), (None, None), (None, None)]
    seen = []
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(order)], "doc_id long, text string, _gone int, row_hash string").repartition(3)
        seen.append(sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngramjoin.near_groups(df, 3, "0.9").collect())))
        kept = ngramjoin.one_per_group(df, 3, "0.9")
        assert kept.columns == df.columns
        assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == {(7, a): 1, (3, b + " tail"): 1, (5, "alone and short"): 1, (None, None): 2}
    assert seen[0] == seen[1] == seen[2]
    assert {c for i, n, c in seen[0] if i == 7} == {3, 7}


def test_ngram_join_blocks(spark, monkeypatch):
    """Lists that are dealt into blocks find the same groups."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[p] = f"e{i}x{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngramjoin, "LONG", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_groups(df, 3, "0.9").collect()}
    assert got == brute_groups(rows, 3, 90)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


# ---- decontamination


def test_decontamination(spark, docs, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = set()
    for d, t in texts(docs):
        w = norm(t)
        own = set(bag(w))
        for i, x in items:
            b = bag(x)
            if not own & set(b):  # no shingle in common: no window reaches the bar
                continue
            for s in range(max(1, len(w) - len(x) + 1)):
                a = bag(w[s : s + len(x)])
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == want
    assert want
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert kept == {d for d, _ in texts(docs)} - {d for d, _ in want}


def test_decontamination_of_many_items_is_the_same(spark, docs, small, monkeypatch):
    """More shingles than a task should be sent: they are joined instead, with the same result."""
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = lambda: sorted(tuple(r) for r in decontam.leaks(docs, bench).collect())
    few = rows()
    monkeypatch.setattr(decontam, "SHINGLES", 0)
    assert few and rows() == few


def test_blocks_meet_within_the_radius(spark):
    """Every pair of fingerprints within RADIUS meets in a block; few others do."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a = int(rng.integers(0, 1 << 63))
        flips = rng.choice(63, int(rng.integers(0, decontam.RADIUS + 1)), replace=False)
        rows += [(i, a, a ^ sum(1 << int(f) for f in flips), True), (i, a, int(rng.integers(0, 1 << 63)), False)]
    df = spark.createDataFrame(rows, "i long, a long, b long, near boolean")
    meets = F.exists(F.zip_with("own", "other", lambda x, y: F.array_contains(decontam.near_values(x["value"], decontam.RADIUS), y["value"])), lambda x: x)
    df = df.select("near", decontam.blocks(F.col("a")).alias("own"), decontam.blocks(F.col("b")).alias("other")).select("near", meets.alias("m"))
    got = {r.near: r.m for r in df.groupBy("near").agg(F.avg(F.col("m").cast("double")).alias("m")).collect()}
    assert got[True] == 1.0
    assert got[False] < 0.3


def test_simhash_radius_keeps_near_copies(spark):
    """Windows with one word edited, of 45 to 90 words: all that reach 0.8 are found."""
    rng = np.random.default_rng(11)
    docs, items, want = [], [], set()
    for i in range(60):
        w = [f"w{int(x)}" for x in rng.integers(0, 5000, int(rng.integers(45, 90)))]
        items.append((i, " ".join(w)))
        for e in range(2):
            c = list(w)
            c[int(rng.integers(0, len(w)))] = "edited"
            docs.append((10 * i + e, "Before. " * 8 + " ".join(c) + " after" * 9))
            bag = lambda x: collections.Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
            if sum((bag(c) & bag(w)).values()) >= 0.8 * sum((bag(c) | bag(w)).values()):
                want.add((10 * i + e, i))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert len(want) > 80


def test_clean_goes_by_text(spark):
    rows = [(None, LONG, 1), (None, "other words stay here for good", 1), (5, LONG, 2), (5, "a second text of the same id", 2), (6, LONG, 3), (6, LONG, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leak int").withColumnsRenamed({"leak": "_leak"}).withColumn("leak", F.lit("x"))
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    kept = decontam.clean(df, items)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "a second text of the same id"), (True, "other words stay here for good")]


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (4, "two words"), (5, "one"), (6, LONG)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(odd, items).collect()}
    assert got == {(d, i) for d in (1, 2, 10) for i in (1, 6)} | {(None, 4), (6, 5), (7, 5)}
    assert decontam.leaks(empty, items).count() == 0
    assert decontam.leaks(odd, items.limit(0)).count() == 0


# ---- toxicity and quality


def test_toxicity(docs, labels, odd, empty):
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, labels).collect()]
    assert len(rows) == docs.count()
    right = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert np.mean(right) > 0.92
    assert len(toxicity.score(odd, labels).collect()) == len(ODD)
    assert toxicity.score(empty, labels).count() == 0
    assert max(r.score for r in toxicity.score(odd, labels.limit(0)).collect()) < 1e-9
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns
    assert kept.count() == len(ODD)


def test_toxicity_bounds_hold_for_one_id(spark, monkeypatch):
    """One id may have any number of rows: the sample is bounded by rows, and equal rows are one."""
    toxic = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.range(60_000).select(F.lit(toxic).cast("long").alias("doc_id"), F.concat(F.lit("word bad "), F.when(F.col("id") < 30_000, F.col("id")).otherwise(0)).alias("text"))
    labels = spark.createDataFrame([(toxic, 1, 0)], "doc_id long, toxic int, quality int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda pos, unl, prior: seen.update(p=len(pos), u=len(unl)) or (np.zeros(0, np.int64), np.zeros(0), 0.0))
    toxicity.train(docs, labels, positives=300, unlabelled=700)
    assert seen == {"p": 300, "u": 700}
    toxicity.train(docs.where("text = 'word bad 0'"), labels, positives=300, unlabelled=700)
    assert seen == {"p": 1, "u": 1}


def test_quality_scores_are_bounded_for_one_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 40)
    left_out = [r.id for r in spark.range(40).where("pmod(xxhash64('floor', id), 5) = 0").collect()]
    trusted = next(i for i in range(40) if i not in left_out)
    words = lambda i: [f"t{j}" if j < i // 2 else f"w{i}x{j}" for j in range(200)]
    docs = spark.createDataFrame([(trusted, " ".join(words(400))), *((left_out[i % 2], " ".join(words(i))) for i in range(400))], "doc_id long, text string")
    labels = spark.createDataFrame([(trusted, 0, 1), (left_out[0], 0, 1), (left_out[1], 0, 0)], "doc_id long, toxic int, quality int")
    seen = []
    monkeypatch.setattr(quality, "best_floor", lambda good, bad: seen.append((len(good), len(bad))) or 0.0)
    quality.judge(docs, labels)
    assert seen == [(40, 40)]


def test_risk_is_corrected_for_the_prior():
    """Positives hidden in the unlabelled sample are found, although the sample counts them as negative."""
    rng = np.random.default_rng(8)
    noise = lambda: rng.choice(np.arange(100, 400), 12, replace=False)
    text = lambda toxic: np.unique(np.concatenate([noise(), rng.choice(np.arange(10), 3, replace=False) if toxic else []]).astype(np.int64))
    hidden = rng.random(1500) < 0.3
    pos, unl = [text(True) for _ in range(300)], [text(bool(x)) for x in hidden]
    chosen, w, bias = toxicity.fit(pos, unl, 0.3)
    weight = dict(zip(chosen.tolist(), w.tolist(), strict=True))
    z = np.array([sum(weight.get(int(f), 0.0) for f in x) + bias for x in unl])
    assert np.mean((z > 0) == hidden) > 0.97
    loss = lambda z, y: np.logaddexp(0, -z if y else z).mean()
    zp = np.array([sum(weight.get(int(f), 0.0) for f in x) + bias for x in pos])
    risk = lambda zp, zu: 0.3 * loss(zp, True) + max(0.0, loss(zu, False) - 0.3 * loss(zp, False))
    assert risk(zp, z) < 0.2 < risk(np.zeros(300), np.zeros(1500))


def test_toxicity_scores_by_hand(docs, labels):
    """Scores from the model's weights, one text and one word at a time."""
    chosen, w, bias = toxicity.train(docs, labels)
    weight = dict(zip(chosen.tolist(), np.float32(w).tolist(), strict=True))
    one = lambda data: int(textvec.hash_spans(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for i, t in texts(docs):
        raw = [x.encode() for x in words(t)]
        found = {one(x) % toxicity.BUCKETS for x in raw} | {(one(x[: toxicity.STEM]) + 1) % toxicity.BUCKETS for x in raw}
        assert math.isclose(got[i], 1 / (1 + math.exp(-sum(weight.get(f, 0.0) for f in found) - bias)), rel_tol=1e-5, abs_tol=1e-12)


def brute_base(t):
    w = words(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(grams)
    mark = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)}
    lines, dup = set(), 0
    for x in (t or "").split("\n"):
        if words(x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, words(t, False))), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(mark)


def test_quality(docs, labels, odd, empty):
    for df in (docs, odd):
        want = {i: brute_base(t) for i, t in texts(df)}
        for r in quality.judge(df, labels).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality.judge(empty, labels).count() == 0
    good = {r.doc_id: r.quality for r in labels.collect()}
    got = [(r.kept, good[r.doc_id]) for r in quality.judge(docs, labels).collect() if r.doc_id in good and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in got]) > 0.95


def test_quality_ratio_against_plain_counts(docs, labels):
    """llr and kept from counters of words and pairs; a bucket is found for one word or pair at a time."""

    def bucket(x):
        data = np.frombuffer(" ".join(x).encode(), np.uint8)
        _, _, h, wo = textvec.words(data, np.array([0, len(data)]))
        return int((h if len(x) == 1 else textvec.shingles(h, wo, 2)[0])[0] & np.uint64(quality.BUCKETS - 1))

    def grams(t):
        w = words(t)
        return [(x,) for x in w] + ([*zip(w, w[1:])] if len(w) > 1 else [(w[0],)] if w else [])

    trusted = {r.doc_id for r in quality.labelled_ids(labels, True, False).collect()}
    left = {good: {r.doc_id for r in quality.labelled_ids(labels, good, True).collect()} for good in (True, False)}
    assert not trusted & left[True]
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert trusted | left[True] == {i for i, q in known.items() if q == 1}
    rows, at = texts(docs), {}
    raw, good = collections.Counter(), collections.Counter()
    own = {}
    for i, t in rows:
        if len(words(t)) == 1:  # a lone word's pair is a shingle of one word, hashed otherwise
            continue
        own[i] = [at.setdefault(g, bucket(g)) if g not in at else at[g] for g in grams(t)]
        raw.update(own[i])
        if i in trusted:
            good.update(own[i])
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    scale = sum(good.values()) / sum(raw.values())
    for i, g in own.items():
        want = sum(math.log(good[x] + 5) - math.log(raw[x] * scale + 5) for x in g) / max(1, len(g))
        assert abs(got[i].llr - want) < 2e-3, i  # the texts of one word are left out of the plain counts
    floor = quality.best_floor(*(np.array([got[i].llr for i in left[side] if i in got and not got[i].base_failed]) for side in (True, False)))
    assert all(r.kept == (not r.base_failed and r.llr >= floor) for r in got.values())


def test_best_floor():
    good, bad = np.array([0.1, 0.2, 0.3]), np.array([-0.5, -0.1])
    assert quality.best_floor(good, bad) == pytest.approx(0.0)
    assert quality.best_floor(good, bad[:0]) == -np.inf
    assert quality.best_floor(np.array([0.0, 1.0]), np.array([0.5])) < 0.0  # losing half of the good would weigh more


def test_quality_query_takes_words_as_they_are(spark, small, docs, labels):
    def brute(t):
        w = words(t, False)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(grams)
        return len({i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)})

    assert {r.doc_id: r.n_repeat_words for r in quality.q_quality(spark, small).collect()} == {i: brute(t) for i, t in texts(docs)}
    df = spark.createDataFrame([(1, " ".join(["one two three", "One two three"] + [f"w{i}" for i in range(50)])), (2, "a B c x a B c")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.judge(df, labels, fold=False).collect()} == {1: 0, 2: 6}


# ---- mixing


def plain_rake(cells, targets):
    """Independent raking in plain Python: scale every dimension in turn, 400 times."""
    w = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(400):
        for d, wanted in enumerate(targets):
            for v, share in wanted.items():
                now = sum(cells[c] * w[c] for c in cells if c[d] == v)
                for c in cells:
                    if c[d] == v:
                        w[c] *= share * total / now
    most = max(w.values())
    return {c: x / most for c, x in w.items()}


def test_raking_meets_all_marginals(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    total = sum(r.n_tokens * r.keep_p for r in rows)
    cells = collections.Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    whole = sum(cells.values())
    targets, moved = [], 0
    for i, d in enumerate(mixing.DIMS):
        have = collections.Counter()
        for c, n in cells.items():
            have[c[i]] += n
        asked = mixing.TARGETS[d]
        if isinstance(asked, dict):
            rest = sum(n for v, n in have.items() if v not in asked)
            wanted = {v: asked.get(v, (1 - sum(asked.values())) * n / rest if rest else 0) for v, n in have.items()}
        else:
            big = {v: n for v, n in have.items() if n >= asked.least * whole}
            wanted = {v: sum(big.values()) / whole * n**asked.alpha / sum(x**asked.alpha for x in big.values()) if v in big else n / whole for v, n in have.items()}
        moved = max(moved, max(abs(wanted[v] - n / whole) for v, n in have.items()))
        targets.append(wanted)
        for v, share in wanted.items():
            assert abs(sum(r.n_tokens * r.keep_p for r in rows if getattr(r, d) == v) / total - share) < 1e-6, (d, v)
    assert moved > 0.03  # the targets ask for something
    want = plain_rake(dict(cells), targets)
    for r in rows:
        assert math.isclose(r.keep_p, want[r.source, r.lang, r.topic], rel_tol=1e-5)
    assert max(r.keep_p for r in rows) == 1.0
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix_documents(empty).count() == 0
    kept = sorted(r.doc_id for r in rows if r.kept)
    assert sorted(r.doc_id for r in mixing.mix_documents(docs).collect()) == kept


def test_mixing_keeps_columns_of_any_name(spark, odd, monkeypatch):
    clashing = odd.withColumns({c: F.lit(c) for c in ("keep_p", "_s", "topic", "draw", "n_tokens", "vector", "id", "draw_of_row")})
    for cells in (mixing.CELLS, 1):  # beyond the bound, cells meet the rows by a join
        monkeypatch.setattr(mixing, "CELLS", cells)
        kept = mixing.mix_documents(clashing, {d: mixing.Tempered(0.95) for d in mixing.DIMS})
        assert kept.columns == clashing.columns
        assert 5 < kept.count() <= len(ODD)


def test_mixing_many_languages(spark, odd, monkeypatch):
    """Seventy languages, each with a mean of its own: sent to all tasks or joined, with the same result; groups of any type."""
    rng = np.random.default_rng(8)
    pool = [f"commonword{i}" for i in range(30)]
    rows = [(i, " ".join([*rng.choice(pool, 30), *[f"lang{i % 70}word{j}" for j in range(30)]]), f"l{i % 70}", bool(i % 3)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source boolean")
    by_lang = collections.defaultdict(list)
    for _, text, lang, _ in rows:
        data = text.encode()
        by_lang[lang].append(mixing.topics.vector(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].astype(int))
    got, kept = [], []
    for few in (mixing.LANGS, 64):
        monkeypatch.setattr(mixing, "LANGS", few)
        out, model = mixing._rows(docs, "doc_id", "text")
        assert model.few == (few > 70)
        assert {r.lang: list(r.mean) for r in model.means.collect()} == {g: np.rint(np.mean(v, axis=0)).astype(int).tolist() for g, v in by_lang.items()}
        got.append(sorted((r.id, r.topic) for r in out.collect()))
        kept.append(sorted(r.doc_id for r in mixing.mix_documents(docs, {"source": {"true": 0.5}}).collect()))
    assert got[0] == got[1] and len({t for _, t in got[0]}) > 3
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 700


def test_raking_scarce_values_lower_the_rate():
    cells = [((a, b), n) for a, b, n in (("x", "p", 900), ("x", "q", 50), ("y", "p", 30), ("y", "q", 20))]
    got = mixing.rake(cells, {"a": {"y": 0.5}, "b": {"q": 0.4}}, ("a", "b"))
    kept = sum(n * w for (_, n), w in zip(cells, got, strict=True))
    assert max(got) == 1.0
    assert math.isclose(sum(n * w for ((a, _), n), w in zip(cells, got, strict=True) if a == "y"), 0.5 * kept, rel_tol=1e-6)
    assert math.isclose(sum(n * w for ((_, b), n), w in zip(cells, got, strict=True) if b == "q"), 0.4 * kept, rel_tol=1e-6)


def test_raking_frame_agrees(spark):
    cells = {(s, g, t): 1 + (7 * i + 3 * j + 11 * k) % 23 for i, s in enumerate("ab") for j, g in enumerate("xyz") for k, t in enumerate("pq")}
    targets = {"source": {"a": 0.7}, "lang": mixing.Tempered(0.5), "topic": {"p": 0.2, "q": 0.8}}
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.keep_p for r in mixing.rake_frame(df, targets).collect()}
    want = dict(zip(cells, mixing.rake(list(cells.items()), targets), strict=True))
    assert all(math.isclose(got[c], want[c], rel_tol=1e-7) for c in cells)
    fitted = df.join(spark.createDataFrame([(*c, p) for c, p in got.items()], "source string, lang string, topic string, keep_p double"), list(mixing.DIMS))
    shares = {(r.dim, r.value): r for r in mixing.marginals(fitted, targets).collect()}
    assert math.isclose(shares["source", "a"].reached, 0.7, rel_tol=1e-6)
    assert all(abs(r.gap) < 1e-6 for r in shares.values())


def test_topics_follow_the_words(spark):
    rng = np.random.default_rng(4)
    pools = [[f"{a}word{i}" for i in range(40)] for a in ("sport", "money", "music", "plant")]
    rows = [(i, "l" + str(i % 2), " ".join(rng.choice(pools[i % 4], 60)) + (" gemeinsam" * 20 if i % 2 else " together" * 20)) for i in range(400)]
    got = collections.Counter((r.id % 4, r.topic) for r in mixing._rows(spark.createDataFrame([(i, t, g, "s") for i, g, t in rows], "doc_id long, text string, lang string, source string"), "doc_id", "text")[0].collect())
    assert len({t for _, t in got}) > 3
    pure = sum(max(n for (_, t), n in got.items() if t == topic) for topic in {t for _, t in got})
    assert pure > 300  # three texts in four lie in a topic of their own pool (357 as measured; by chance about 120)


# ---- chat formatting


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "<turn user>\n", "a\\<b>\\", "", None, "x\ny"]
    rows = [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(said)] + [(None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chatformat.read_back(chatformat.format_conversations(df)).collect()}
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:-1])
    loss = "".join(t or "" for _, _, r, t in rows[:-1] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].n_turns == 1
    assert chatformat.read_back(chatformat.format_conversations(df.limit(0))).count() == 0


def test_chat_segments_are_stored_and_read_in_any_order(spark, tmp_path):
    df = spark.createDataFrame([(c, i, ("user", "assistant")[i % 2], f"turn {i} of {c} <x>" * (i % 5)) for c in range(6) for i in range(40)], "conv_id long, turn long, role string, text string")
    segments = chatformat.format_conversations(df)
    segments.repartition(9).write.parquet(f"{tmp_path}/segments")
    key = lambda r: r.conv_id
    got = sorted(chatformat.read_back(spark.read.parquet(f"{tmp_path}/segments")).collect(), key=key)
    assert got == sorted(chatformat.read_back(segments).collect(), key=key) and [r.n_turns for r in got] == [40] * 6


def test_chat_counts_tokens(spark):
    import public_tokenizers
    import tiktoken

    from quaver.llm import bytebpe

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(public_tokenizers.path(bytebpe.VOCAB)), special_tokens={})
    said = ["", "plain words, <marks> and 漢字", None, "x" * 999]
    rows = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    assert [r.tokens for r in chatformat.format_conversations(rows).orderBy("seq").collect()] == [len(known.encode_ordinary(t or "")) for t in said]


def test_chat_odd(spark):
    """Very long and repeated turns, ties, columns of the operator's own names, typed parts through Spark."""
    long = "x<y> " * 400_000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", long), (2, None, None, None)]
    df = spark.createDataFrame([(*r, 9, "k", "f") for r in rows], "conv_id long, turn long, role string, text string, seq int, offset string, formatted string")
    for order in (df, df.orderBy(F.desc("text"))):
        got = {r.conv_id: r for r in chatformat.read_back(chatformat.format_conversations(order.repartition(3))).collect()}
        assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[2].loss_chars) == (4, len(long), 1, 0)
        assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    parts = [[("text", "see ", None, None, None, None, None), ("image", None, "a.png", 28, 28, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)], None]
    df = spark.createDataFrame([(5, i, "assistant", p) for i, p in enumerate(parts)], f"conv_id long, turn long, role string, parts array<{chatformat.PART}>")
    first, second = chatformat.format_conversations(df).orderBy("seq").collect()
    assert first.formatted == "<turn assistant>\nsee <image 0><audio 1><document 2></turn>\n"
    assert [(a.mark, a.ref, a.tokens) for a in first.attachments] == [(0, "a.png", 4), (1, "b.wav", 50), (2, "c.pdf", 900)]
    assert (second.formatted, second.attachments, second.offset) == ("<turn assistant>\n</turn>\n", [], len(first.formatted))


def test_chat_parts():
    v = chatformat.format_turn("assistant", [{"type": "text", "text": "see <image 0>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "document", "ref": "c", "pages": 2}, {"type": "text", "text": "end"}])
    text = "".join(v.out)
    assert chatformat.read_turn(text) == ("assistant", [("text", "see <image 0>"), ("image", "0"), ("audio", "1"), ("document", "2"), ("text", "end")])
    assert [(a["ref"], a["tokens"]) for a in v.attachments] == [("a.png", 4), ("b", 38), ("c", 600)]
    assert [chatformat.unescape(text[s["start"] : s["stop"]]) for s in v.loss] == ["see <image 0>", "end"]


# ---- URL graph


def test_url_rules(spark):
    rows = [(1, "HTTP://A.ORG/x", None), (2, "https://example.org/en/12?q", ""), (3, "x://b.com/de/y#z", ""), (4, "x://b.com/fr/", ""), (5, None, None), (6, "no scheme", ""), (7, "http://example.org", ""), (8, "http://notexample.org/es/", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("com/de/", "block")
    assert got[4][2:] == ("com/fr/", "allow")
    assert got[5] == ("", "", None, "allow")
    assert got[6] == ("", "", None, "allow")
    assert got[7] == ("example.org", "", None, "block")  # two of its ruled pages are blocked
    assert got[8][2] == "org/"
    assert urlgraph.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_spreads(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://casino-win.example.com/", ""), (2, "http://farm.net/", link("casino-win.example.com") * 2), (3, "http://good.org/", link("near.net")), (4, "http://near.net/", "")]
    got = {r.host: r for r in urlgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), bad=("casino-win.example.com",)).collect()}
    assert (got["farm.net"].verdict, got["near.net"].verdict, got["casino-win.example.com"].verdict) == ("block", "allow", "block")
    assert got["near.net"].trust > 0


def test_parents_answer_for_subdomains(spark):
    """A host without ruled pages is judged by the domain above it, and trust reaches that domain from below."""
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://new.bad.com/x", ""), (3, "http://deep.new.bad.com/x", ""), (4, "http://sub.plain.com/fr/2", ""), (5, "http://plain.com/x", ""), (6, "http://alone.com/x", "")]
    got = {r.page_id: r for r in urlgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "block", "allow", "allow", "allow"]
    assert got[2].rule is None and got[2].distrust > 0 and got[5].trust > 0 and got[6].trust == got[6].distrust == 0


def solved(n, edges, mass):
    """The walk's limit, from the linear system."""
    share = np.zeros((n, n))
    for (a, b), w in edges.items():
        share[a, b] = w
    out = share.sum(axis=1, keepdims=True)
    share = np.divide(share, out, out=np.zeros_like(share), where=out > 0)
    return np.linalg.solve(np.eye(n) - urlgraph.DAMPING * share.T, (1 - urlgraph.DAMPING) * mass)


def ranked(spark, edges, mass):
    e = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    m = spark.createDataFrame([(f"h{i}", float(x)) for i, x in enumerate(mass)], "host string, mass double")
    got = {r.host: r.score for r in urlgraph.rank(e, m).collect()}
    return np.array([got[f"h{i}"] for i in range(len(mass))])


def test_page_rank_is_settled(spark):
    """Against the solved system: random graphs with cycles, more mass than one seed's, and next to none."""
    rng = np.random.default_rng(2)
    n = 30
    edges = {(int(a), int(b)): float(rng.integers(1, 9)) for a, b in rng.integers(0, n, (140, 2)) if a != b}
    mass = rng.random(n) * (rng.random(n) < 0.3)
    for scale in (1.0, 1e-7):
        assert np.abs(ranked(spark, edges, mass * scale) - solved(n, edges, mass * scale)).max() < 1e-6 * min(1.0, mass.sum() * scale)
    assert ranked(spark, edges, mass * 0).max() == 0


def test_page_rank_along_a_chain(spark):
    """Fifty hosts in a row: every one is reached, and scores fall with the distance."""
    edges = {(i, i + 1): 1.0 for i in range(49)}
    mass = np.eye(50)[0]
    got = ranked(spark, edges, mass)
    assert np.allclose(got, solved(50, edges, mass), rtol=1e-7, atol=0)
    assert (np.diff(got) < 0).all() and got[49] > 0


def test_url_filter_odd(spark):
    long = "<p>" + "x" * 2_000_000 + '<a href="http://far.com/">y</a>'
    rows = [(1, "http://a.com/de/", None, "h", "r")] * 3 + [(None, "http://a.com/x", long, "h", "r"), (2, "http://far.com/", "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = urlgraph.filter_urls(df).collect()
    assert collections.Counter((r.page_id, r.host, r.verdict) for r in got) == {(1, "a.com", "block"): 3, (None, "a.com", "block"): 1, (2, "far.com", "allow"): 1}


def test_more_allowed_than_blocked_stays(spark):
    # far more is allowed than blocked over all hosts: that must not sway b.com
    paths = [("a.com", "/fr/")] * 40 + [("b.com", "/fr/")] * 3 + [("b.com", "/de/")] * 2 + [("c.com", "/fr/"), ("c.com", "/de/"), ("c.com", "/de/")]
    rows = [(i, f"http://{h}{p}", "") for i, (h, p) in enumerate(paths)] + [(100, "http://b.com/", ""), (101, "http://c.com/", "")]
    got = {r.page_id: r.verdict for r in urlgraph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[100], got[101]) == ("allow", "block")


def test_small_scores_are_not_lost(spark):
    # a chain behind one of 10^6 links: its scores are far below nine decimal places
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "z", 1e6), ("b", "c", 1.0), ("b", "z", 1e6)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 0.0), ("z", 0.0)], "host string, mass double")
    got = {r.host: r.score for r in urlgraph.rank(edges, seeds).collect()}
    small = spark.createDataFrame([("a", 1e-7), ("b", 0.0), ("c", 0.0), ("z", 0.0)], "host string, mass double")
    less = {r.host: r.score for r in urlgraph.rank(edges, small).collect()}
    share = 0.85 / (1e6 + 1)
    for scale, scores in ((1.0, got), (1e-7, less)):
        assert scores["b"] == pytest.approx(0.15 * share * scale, rel=1e-6)
        assert scores["c"] == pytest.approx(0.15 * share**2 * scale, rel=1e-6)


# ---- language model


def test_language_model(spark, docs, odd, empty):
    for df in (docs, odd):
        train = df.where(~kneserney.held_out_mark())
        model = kneserney.train(train.select("text"))
        got = kneserney.score(df, model, kneserney.held_out_mark()).collect()
        lines = [[*words(t), None] for _, t in texts(train)]
        c1 = collections.Counter(w for x in lines for w in x)
        pairs = collections.Counter(p for x in lines for p in zip([0, *x[:-1]], x, strict=True))
        n, v = sum(c1.values()), len(c1)
        before = collections.Counter(b for _, b in pairs)
        total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for (a, _), c in pairs.items():
            total[a] += c
            kinds[a][min(c, 3) - 1] += 1
        of = lambda d: [sum(x == i for x in d.values()) for i in (1, 2, 3, 4)]
        top, low = kneserney.discounts(of(pairs)), kneserney.discounts(of(before))
        off = lambda c, d: c - d[min(c, 3) - 1] if c else 0.0
        rest = min(1.0, sum(c - off(c, low) for c in before.values()) / len(pairs))

        def p(a, b):
            u = rest / (v + 1) + off(before[b], low) / len(pairs)
            return (off(pairs.get((a, b), 0), top) + sum(d * k for d, k in zip(top, kinds[a], strict=True)) * u) / total[a] if total[a] else u

        want = {}
        for i, t in texts(df):
            x = [*words(t), None]
            want[i] = (len(x), sum(c1[w] > 0 for w in x), n, sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), sum(math.log10(p(a, b)) for a, b in zip([0, *x[:-1]], x, strict=True)))
        assert len(got) == df.count()
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
            assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
            assert math.isclose(r.score, want[r.doc_id][4], rel_tol=1e-9)
    assert kneserney.score(empty, kneserney.train(empty.select("text"))).count() == 0


def test_model_maps_hold_no_files(tmp_path):
    import os

    before = len(os.listdir("/proc/self/fd"))
    for i in range(60):
        kneserney.save(f"file://{tmp_path}", f"a-{i}", np.arange(50, dtype=np.uint64))
        assert kneserney.mapped(f"file://{tmp_path}", f"a-{i}", np.uint64).sum() == 1225
    assert len(os.listdir("/proc/self/fd")) < before + 5


# ---- token files


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4097])
def test_feistel_is_a_bijection(n):
    slots = tokenfiles.permute(np.arange(n), n, 99)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert (slots != tokenfiles.permute(np.arange(n), n, 98)).any()


def test_token_files(spark, odd, empty, tmp_path):
    odd.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    folder = new_folder(spark, "tokens")
    rows = tokenfiles.write_training_order(df, folder, length=64, per_shard=100).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    ids = tokenfiles.read_slots(folder, 0, len(rows))
    assert (tokenfiles.read_slots(folder, 7, 150) == ids[7:157]).all()
    assert all(zlib.crc32(ids[r.slot].tobytes()) == r.ids_crc32 for r in rows)
    flat = np.concatenate([ids[r.slot] for r in sorted(rows, key=lambda r: r.sequence)])
    encoding = tokenfiles.encoder(tokenfiles.VOCAB).encoding
    parts = np.split(flat, np.flatnonzero(flat == tokenfiles.END) + 1)
    got = collections.Counter(encoding.decode(x[:-1].tolist()) for x in parts if len(x) > 1)
    want = collections.Counter(t for _, t in texts(df) if t)
    assert got == want
    assert tokenfiles.write_training_order(empty, new_folder(spark, "none")).count() == 0


def test_tokens_equal_the_tokenizers():
    enc = tokenfiles.encoder(tokenfiles.VOCAB)
    sample = ["", "  a  b\n\n c ", "x\u00a0 \u3000y", " \n", "don't  stop\t\tnow 12ab", "é  z", "\n\nq", "a\x1c b"]
    for i, j, data, off in textvec.pieces(pa.array(sample)):
        ids, cut = enc.encode(data, off)
        for d in range(i, j):
            assert ids[cut[d - i] : cut[d - i + 1]].tolist() == [*enc.encoding.encode_ordinary(sample[d]), tokenfiles.END]


# ---- pipeline


def test_pipeline(spark, small, docs):
    import corpus_pipeline as P

    df = docs
    for name, stage in P.STAGES:
        before = df
        df = stage(spark, df, small)
        assert df.count() <= before.count()
        if name != P.STAGES[-1][0]:
            assert df.columns == docs.columns
    whole = P.run(spark, small).collect()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, whole))
    assert 0.4 * docs.count() < len(whole) < docs.count()


def test_pipeline_on_odd_and_empty_tables(spark, small, odd, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    import corpus_pipeline as P

    for name, df in (("odd", odd), ("empty", empty)):
        folder = tmp_path / name
        df.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{small}/{table}.parquet").limit(1000 if name == "odd" else 0).write.parquet(f"{folder}/{table}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in P.STAGES[:-1]:
            after = stage(spark, now, str(folder))
            assert after.columns == df.columns, step
            rows, before = collections.Counter(map(tuple, after.collect())), collections.Counter(map(tuple, now.collect()))
            assert not rows - before, step
            if step == "ngram_jaccard_join":  # of equal texts one stays; texts without words are linked with nothing
                texts_ = [r[1] for r in rows.elements()]
                assert texts_.count(LONG) <= 1 and texts_.count("one") + texts_.count("ONE") <= 1
            now = spark.createDataFrame(list(rows.elements()), df.schema)
        slots = P.sharding(spark, now, str(folder)).collect()
        assert len(slots) == now.count()
        assert (P.run(spark, str(folder)).count() > 0) == (name == "odd")


def test_quality_counts_every_labelled_text(spark):
    labels = spark.range(120_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    sides = [quality.labelled_ids(labels, good, left_out).count() for good in (True, False) for left_out in (True, False)]
    assert sum(sides) == 120_000 and min(sides[1], sides[3]) > 40_000
    # 60,000 texts that are told apart only by one word, and all of them are counted
    few = labels.where("doc_id < 60000")
    words = " ".join(f"word{i}" for i in range(60))
    docs = few.select("doc_id", F.concat(F.lit(words), F.when(F.col("quality") == 1, " fine").otherwise(" awful")).alias("text"))
    out = quality.judge(docs, few).groupBy("kept", (F.col("doc_id") % 2).alias("side")).count().collect()
    assert sorted((r.kept, r.side, r["count"]) for r in out) == [(False, 0, 30_000), (True, 1, 30_000)]


@pytest.mark.parametrize("seed", range(3))
def test_floor_over_ranges(spark, seed):
    rng = np.random.default_rng(seed)
    good, bad = rng.normal(0.3, 1, 700).round(seed + 1), rng.normal(-0.3, 1, 400).round(seed + 1)
    want = quality.best_floor(good, bad)
    df = spark.createDataFrame([(float(x), True) for x in good] + [(float(x), False) for x in bad], "llr double, good boolean")
    assert quality.learnt_floor(df, scores=40) == quality.learnt_floor(df) == want
    assert quality.learnt_floor(df.where("good")) == quality.learnt_floor(df.where("NOT good")) == -np.inf
