"""Toxicity by non-negative positive-unlabelled learning (nnPU).

Positives are texts confirmed toxic; the other sample is unlabelled text, drawn
from the whole corpus by a hash of id and text.  With the class prior pi (the toxic
share among the labelled training rows) the risk

    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives))

is minimised for a linear model with logistic loss; where the second part turns
negative, its gradient is followed backwards, as the method asks.  Features are
the presence of hashed words and of hashed word beginnings, cut to those most
tied to the positives, so that a text's length adds little noise.

At most POSITIVES and UNLABELLED rows are used for fitting (their hashed
features only, by blobs), however many rows an id has; scoring covers every whole text.  Labels are read from
training rows only; label, language, source and id are no features.

Edge cases: null and empty texts score by the bias alone; a very long text is scored
whole, by the presence of its features; without positives the score is 0 but for
rounding; conflicting labels of an id count as toxic if any row says so; a null id is
no training row; rows equal in id and text are one in the samples; a score that ties with
the cut is toxic; repeated rows score alike; ``drop_toxic`` keeps all columns whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import textvec as T
from quaver.llm.shared import crc32_text, map_arrow

BUCKETS, POSITIVES, UNLABELLED, FEATURES, STEM = 1 << 20, 3_000, 9_000, 4_000, 5
#: Least significance of a feature: 3, or SURE for one in fewer than OFTEN texts, of which chance alone gives many.
SURE, OFTEN = 4.5, 30
EPOCHS, RATE, DECAY = 300, 0.05, 1e-4


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and word beginning of a piece."""
    st, en, h, wo = T.words(data, off)
    folded = T.ASCII_LOWER[data]
    stem = T.hash_spans(folded, st, np.minimum(en, st + STEM)) + np.uint64(1) if len(st) else h
    doc = T.by_text(wo)
    both = np.concatenate([h, stem]) & np.uint64(BUCKETS - 1)
    return both.astype(np.int64), np.concatenate([doc, doc])


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, blob of distinct features) of sample texts."""
    for b in batches:
        out = []
        for i, j, data, off in T.pieces(b.column(1)):
            f, doc = features(data, off)
            order = np.argsort(doc, kind="stable")
            f, cut = f[order], np.searchsorted(doc[order], np.arange(j - i + 1))
            out += [np.unique(f[cut[d] : cut[d + 1]]).astype(np.int32).tobytes() for d in range(j - i)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["positive", "blob"])


def _chunks(docs: list[np.ndarray], size: int = 256) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first, texts) of a few texts at a time, so that the driver needs no second copy of all."""
    for i in range(0, len(docs), size):
        yield i, docs[i : i + size]


def choose(pos: list[np.ndarray], unl: list[np.ndarray], limit: int = FEATURES) -> np.ndarray:
    """The features whose presence sets positives most apart (signed chi-square), ascending."""

    def count(docs: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(BUCKETS)
        for _, some in _chunks(docs):
            total += np.bincount(np.concatenate(some), minlength=BUCKETS)
        return total

    a, b, na, nb = count(pos), count(unl), len(pos), len(unl)
    pa_, pb = a / na, b / nb
    pool = (a + b + 1) / (na + nb + 2)
    z = (pa_ - pb) / np.sqrt(pool * (1 - pool) * (1 / na + 1 / nb) + 1e-9)
    z[(a + b < 3) | ((a + b < OFTEN) & (np.abs(z) < SURE))] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:limit]
    return np.sort(best[np.abs(z[best]) > 3])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the nnPU minimum, full batches with Adam."""
    pos, unl = [x for x in pos if len(x)], [x for x in unl if len(x)]
    if not pos or not unl:
        return np.zeros(0, np.int64), np.zeros(0), -1e3
    chosen = choose(pos, unl)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, some in _chunks(docs):
            at = place[np.concatenate(some)]
            hit = at >= 0
            found.append(at[hit].astype(np.int64))
            owners.append(first + np.repeat(np.arange(len(some)), [len(x) for x in some])[hit])
        return np.concatenate(found), np.concatenate(owners)

    (pf, po), (uf, uo) = rows(pos), rows(unl)
    n, p, u = len(chosen), len(pos), len(unl)
    w, bias = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, EPOCHS + 1):
        zp = np.bincount(po, w[pf], p) + bias
        zu = np.bincount(uo, w[uf], u) + bias
        sp, su = sigmoid(zp), sigmoid(zu)
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if minus >= 0:
            gp, gu = prior * (sp - 1) / p - prior * sp / p, su / u
        else:  # undo the over-fitted part only
            gp, gu = prior * sp / p, -su / u
        g = np.concatenate([np.bincount(pf, gp[po], n) + np.bincount(uf, gu[uo], n) + DECAY * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return chosen, w, float(bias)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, w, bias = model.value
        dense = np.zeros(BUCKETS, np.float32)
        dense[chosen] = w
        for b in batches:
            for i, j, data, off in T.pieces(b.column(1)):
                f, doc = features(data, off)
                hit = np.flatnonzero(dense[f])
                once = np.unique(doc[hit] * BUCKETS + f[hit])
                z = np.bincount(once // BUCKETS, dense[once % BUCKETS], j - i) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from at most ``positives`` confirmed rows and ``unlabelled`` training rows: those with the least hash of id and text, equal rows once."""
    training = F.coalesce(crc32_text(key) % 5 != 0, F.lit(False))
    known = labels.where(training & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return np.zeros(0, np.int64), np.zeros(0), -1e3
    texts = docs.where(training).select(F.col(key).alias("id"), F.xxhash64(F.lit("u"), F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    toxic = known.where("toxic = 1").select(F.col(key).alias("id"))
    least = lambda rows, n: F.broadcast(rows.select("h").distinct().orderBy("h").limit(n))
    of = lambda hashes, side: texts.join(hashes, "h", "left_semi").dropDuplicates(["h"]).select(F.lit(side).alias("positive"), "text")
    picked = least(texts.select("id", "h").join(toxic, "id", "left_semi"), positives), least(texts, unlabelled)
    rows = map_arrow(of(picked[0], True).union(of(picked[1], False)), _collect, "positive boolean, blob binary").collect()
    rows.sort(key=lambda r: (r.positive, r.blob))
    pick_ = lambda side: [np.frombuffer(r.blob, np.int32) for r in rows if r.positive == side]
    return fit(pick_(True), pick_(False), float(np.clip(share, 1e-3, 0.95)))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))
    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), _score(model), "doc_id long, score double")


def _keep(model, at: int, cut: float):
    scored = _score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], ["doc_id", "text"])
            got = np.concatenate([x.column(1).to_numpy() for x in scored(iter([two]))]) if b.num_rows else np.zeros(0)
            yield b.filter(pa.array(got < cut))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``cut``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))
    return map_arrow(docs, _keep(model, docs.columns.index(text), cut), docs.schema)


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, labels)
    return out.select("doc_id", (crc32_text("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
