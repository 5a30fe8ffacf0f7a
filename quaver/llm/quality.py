"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs of all texts are counted into BUCKETS hash buckets, once
over the raw corpus and once over trusted texts (labelled good).  The raw counts are
scaled to the trusted total and ALPHA is added to every bucket of both, which makes
two multinomials and keeps n-grams seen too rarely to tell near 0; a text's score is
the mean over its n-grams of log p_trusted - log p_raw.  A text is kept if it passes
the base rules and its score reaches the floor: one floor for every text, no sampling.

The floor is learnt from labelled texts that the trusted counts leave out (a fifth by
a hash of the id): of all cuts between their scores the one with the least
GOOD * (share of good texts lost) + (share of bad texts kept); the lowest of equally
good ones, in the middle of its gap.  Without good or without bad ones there is no
floor.  All labelled texts count; scores are put in order in ranges, and nothing but the
floor reaches the driver.

The counts are arrays of a fixed size, summed by slice (see ``sketch``) and sent
to the tasks; texts are shuffled only to meet more than SENT labels.

Edge cases: null and empty texts have no words and fail the base rules, score 0; a
very long text is counted whole, in pieces; without trusted texts the ratio is 0
everywhere and the base rules decide; a score that ties with the floor is kept;
repeated rows are judged alike; a null id is never labelled; conflicting labels of an
id count as bad; an empty table gives an empty result; only id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.llm import textvec as T
from quaver.llm.shared import broadcast_if_small, discard, map_arrow, materialise
from quaver.llm.sketch import dense_sum

BUCKETS, ALPHA, GOOD = 1 << 17, 5.0, 3.0
#: Labels up to which they are sent to all tasks, and distinct scores of a range, about.
SENT, SCORES = 1 << 20, 200_000
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE = 10
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def _grams(h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and word pair of a piece."""
    pair, po = T.shingles(h, wo, 2)
    b = np.concatenate([h, pair]) & np.uint64(BUCKETS - 1)
    return b.astype(np.int64), np.concatenate([T.by_text(wo), T.by_text(po)])


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    total = np.zeros(2 * BUCKETS, np.int64)
    for b in batches:
        good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, off in T.pieces(b.column(0)):
            _, _, h, wo = T.words(data, off)
            g, doc = _grams(h, wo)
            total[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
            total[BUCKETS:] += np.bincount(g[good[i:j][doc]], minlength=BUCKETS)
    return total


def ratios(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """log p_trusted - log p_raw by bucket; zeros without trusted text."""
    raw, good = counts[:BUCKETS].astype(float), counts[BUCKETS:].astype(float)
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log(good + alpha) - np.log(raw * (good.sum() / raw.sum()) + alpha)


def repeated_words(h: np.ndarray, wo: np.ndarray, k: int = 3) -> np.ndarray:
    """Words that lie in a k-word window found twice or more in its text, by text."""
    m = np.diff(wo)
    s, so = T.shingles(h, wo, k)
    doc = T.by_text(so)
    full = np.repeat(m >= k, np.diff(so))
    s, doc, at = s[full], doc[full], (np.arange(len(s)) - so[:-1][doc] + wo[:-1][doc])[full]
    order = np.lexsort((s, doc))
    same = (s[order][1:] == s[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(h) + 1, bool)
    for i in range(k):
        mark[at[twice] + i] = True
    return T.sums(mark[:-1].astype(np.int64), wo)


def repeated_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, by text."""
    n = len(data)
    if not n:
        return np.zeros(len(off) - 1, np.int64)
    owner = off[:-1][np.diff(off) > 0]
    newline = np.flatnonzero(data == LINE)
    st = np.union1d(owner, newline + 1)
    st = st[st < n]
    nxt = np.concatenate([st[1:], [n]])
    en = np.where(data[nxt - 1] == LINE, nxt - 1, nxt)
    solid = np.concatenate([[0], np.cumsum(~T.SPACE[data])])
    worded = solid[en] > solid[st]
    st, en = st[worded], en[worded]
    h = T.hash_spans(data, st, en)
    doc = np.searchsorted(off, st, "right") - 1
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order[1:][same]], minlength=len(off) - 1)


def _judge(ratio, floor: float, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = ratio.value
        for b in batches:
            for i, j, data, off in T.pieces(b.column(1)):
                _, _, h, wo = T.words(data, off)
                nw = np.diff(wo)
                solid = ~T.SPACE[data]
                chars = T.sums((solid & ((data & 0xC0) != 0x80)).astype(np.int64), off)
                symbols = T.sums(SYMBOL[data].astype(np.int64), off)
                own = h if fold else T.words(data, off, T.SAME)[2]
                lines, words = repeated_lines(data, off), repeated_words(own, wo)
                g, doc = _grams(h, wo)
                llr = np.bincount(doc, weights[g], j - i) / np.maximum(1, np.bincount(doc, minlength=j - i))
                failed = (nw < 50) | (100 * words > 50 * nw)
                cols = [b.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in (nw, chars, symbols, lines, words)), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= floor))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    return run


def labelled_ids(labels: DataFrame, good: bool, left_out: bool) -> DataFrame:
    """Ids of all texts labelled good or bad, of those left out of the counts or of the others."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = F.pmod(F.xxhash64(F.lit("floor"), "doc_id"), F.lit(5)) == 0
    some = known.where((F.col("quality") == 1 if good else F.col("quality") != 1) & (own if left_out else ~own))
    return some.select(F.col("doc_id").cast("long").alias("doc_id"))


def best_floor(good: np.ndarray, bad: np.ndarray, weight: float = GOOD) -> float:
    """``learnt_floor`` of two arrays of scores."""
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[at[0] - 1.0], (at[1:] + at[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmin(np.round(weight * lost + kept, 9))])


def learnt_floor(scored: DataFrame, weight: float = GOOD, scores: int = SCORES) -> float:
    """The cut between the scores (llr, good) that loses least; minus infinity without two sides.

    Equal scores are counted first; ranges of them are summed, so that a score knows what lies below it from its own
    range and the sums of those before.
    """
    c = materialise(scored.groupBy("llr").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")), "scores")
    all_ = c.agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("b").alias("b")).first()
    if not all_.g or not all_.b:
        discard(c)
        return -np.inf
    cut = materialise(c.repartitionByRange(math.ceil(all_.n / scores), "llr").withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = cut.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("llr").alias("last"))
    ends = ends.select("part", F.sum("g").over(earlier).alias("_g"), F.sum("b").over(earlier).alias("_b"), F.max("last").over(earlier).alias("_last"))
    own = Window.partitionBy("part").orderBy("llr")
    below = lambda n: F.coalesce(F.sum(n).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce(F.col("_" + n), F.lit(0))
    j = cut.join(F.broadcast(ends), "part").withColumns({"_prev": F.coalesce(F.lag("llr").over(own), F.col("_last")), "lost": below("g") / all_.g, "kept": 1 - below("b") / all_.b})
    middle = (F.col("llr") + F.col("_prev")) / 2
    at = F.when(F.col("_prev").isNull(), F.col("llr") - 1.0).when(middle > F.col("_prev"), middle).otherwise(F.col("llr"))
    best = j.select(F.struct(F.round(weight * F.col("lost") + F.col("kept"), 9).alias("cost"), at.alias("cut")).alias("x")).agg(F.min("x").alias("x")).first().x
    discard(c, cut)
    return float(best.cut)


def judge(docs: DataFrame, labels: DataFrame, floor: float | None = None, key: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """Every row's base figures, ``llr`` and ``kept``; ``floor`` is learnt where none is given.

    Without ``fold``, words that differ in case are different words in the base figures
    (the query has it so); the ratio's n-grams are lower-cased always.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = labels.count()
    side = lambda good, left_out: labelled_ids(labels, good, left_out).withColumn("good", F.lit(good))
    marked = texts.join(broadcast_if_small(side(True, False), sent, SENT), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = spark.sparkContext.broadcast(ratios(dense_sum(marked, _count, 2 * BUCKETS)))
    if floor is None:
        asked = broadcast_if_small(side(True, True).union(side(False, True)), sent, SENT)
        own = texts.join(asked.select("doc_id"), "doc_id", "left_semi")
        scored = map_arrow(own, _judge(ratio, 0.0, fold), SCHEMA).where("NOT base_failed").select("doc_id", "llr").distinct()
        floor = learnt_floor(scored.join(asked, "doc_id").select("llr", "good"))
    return map_arrow(texts, _judge(ratio, floor, fold), SCHEMA)


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
