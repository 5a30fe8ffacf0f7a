"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed by cell (source, language, topic); topics are clusters of the
texts' words (``topics``).  Cell weights are scaled in turn until all three
marginals of the weighted tokens meet their targets.  The weights are then divided
by the largest, so that every one is a probability and no target is cut short: what
a scarce value cannot give lowers the share of the corpus that stays instead.  A
hash of a document's id and text, uniform in [0, 1), keeps it with its cell's
probability, so a rerun keeps the same ones.  ``marginals`` reports target, reached
share and gap of every value.

Targets of a dimension are named shares (values not named share what is left in
proportion to what they have), or ``Tempered``: shares in proportion to
``have ** alpha`` among the values that hold at least ``least`` of the tokens, while
smaller ones keep what they have.  Values without rows are ignored and targets are
scaled to 1 over those that remain.  Targets that contradict each other over empty
cells cannot be met together; ``marginals`` then shows the gaps.

Cells are fitted on the driver while there are at most ``CELLS`` of them, and by
grouped DataFrame sums beyond that; both run the same rounds.

Edge cases: null source or language is a value of its own; a null text has one
token (its end) and the topic ``none``, an empty one too; a very long text counts
whole; rows equal in id and text share a draw, others with one id do not; a null id
draws by its text; ties do not occur, as every document has its own threshold; an
empty table gives an empty result; only id, text, source and language are read, and
``mix_documents`` keeps all other columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import textvec as T
from quaver.llm import topics
from quaver.llm.shared import discard, fresh, map_arrow, materialise

CELLS, ROUNDS, CLOSE = 200_000, 100, 1e-9
#: Languages up to which every task gets all their means; beyond, they are joined.
LANGS = 4096
DIMS = ("source", "lang", "topic")
NULL = "\0null"


@dataclass(frozen=True)
class Tempered:
    """Shares that lean towards scarce values by an exponent below 1."""

    alpha: float = 0.95
    least: float = 0.01


Targets = Mapping[str, Mapping[str, float] | Tempered]
#: The production marginals (shares of tokens): values not named share the rest by what they have.
TARGETS: Targets = {"source": Tempered(0.7), "lang": {"en": 0.5}, "topic": Tempered(0.8)}


def goals(have: Mapping[str, float], targets: Mapping[str, float] | Tempered) -> dict[str, float]:
    """Target share by value, 1 in all, over the values that have tokens."""
    total = sum(have.values())
    if not total:
        return dict.fromkeys(have, 0.0)
    if isinstance(targets, Tempered):
        large = {v: x for v, x in have.items() if x >= targets.least * total}
        room, own = sum(large.values()) / total, sum(x**targets.alpha for x in large.values())
        return {v: room * x**targets.alpha / own if v in large else x / total for v, x in have.items()}
    named = {v: targets[v] for v in have if v in targets}
    rest = {v: x for v, x in have.items() if v not in named}
    left, own = max(0.0, 1.0 - sum(named.values())), sum(rest.values())
    goal = dict(named) | ({v: left * x / own for v, x in rest.items()} if own else {})
    sum_ = sum(goal.values())
    return {v: x / sum_ for v, x in goal.items()} if sum_ else {v: x / total for v, x in have.items()}


def rake(cells: list[tuple[tuple[str, ...], float]], targets: Targets, dims: tuple[str, ...] = DIMS, rounds: int = ROUNDS) -> list[float]:
    """A probability for each (values, tokens) cell, on the driver."""
    if not cells:
        return []
    tokens = np.array([n for _, n in cells], float)
    weight = np.ones(len(cells))
    codes, wanted = [], []
    for i, d in enumerate(dims):
        names, code = np.unique([v[i] for v, _ in cells], return_inverse=True)
        goal = goals(dict(zip(names.tolist(), np.bincount(code, tokens).tolist(), strict=True)), targets.get(d, {}))
        codes.append(code)
        wanted.append(np.array([goal[v] for v in names.tolist()]) * tokens.sum())
    for _ in range(rounds):
        before = weight
        for code, goal in zip(codes, wanted, strict=True):
            now = np.bincount(code, tokens * weight, len(goal))
            weight = weight * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[code]
        if np.abs(weight - before).max() < CLOSE:
            break
    return (weight / max(weight.max(), 1e-300)).tolist()


def rake_frame(cells: DataFrame, targets: Targets, dims: tuple[str, ...] = DIMS, rounds: int = ROUNDS) -> DataFrame:
    """The same fit where there are too many cells for the driver: (dims, ..., keep_p)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {d: materialise(_goal_frame(cells, d, targets.get(d, {}), total), "goal") for d in dims}
    now = cells.withColumn("weight", F.lit(1.0))
    for i in range(rounds):
        before = now
        for d in dims:
            sums = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).join(wanted[d], d)
            factor = F.when(F.col("now") > 0, F.col("goal") / F.nullif("now", F.lit(0.0))).otherwise(0.0)
            now = now.join(sums.select(d, factor.alias("factor")), d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        now = materialise(now.withColumnRenamed("weight", "after").join(before.select(*dims, "weight"), list(dims)), "rake")
        moved = now.agg(F.max(F.abs(F.col("after") - F.col("weight")))).first()[0]
        now = now.drop("weight").withColumnRenamed("after", "weight")
        if moved is None or moved < CLOSE:
            break
    most = now.agg(F.max("weight")).first()[0] or 1.0
    return now.withColumn("keep_p", F.col("weight") / F.lit(most)).drop("weight")


def _goal_frame(cells: DataFrame, d: str, targets: Mapping[str, float] | Tempered, total: float) -> DataFrame:
    """(d, goal) in tokens: ``goals`` in DataFrame sums."""
    sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("have"))
    if isinstance(targets, Tempered):
        large = F.col("have") >= targets.least * total
        room, own = sums.agg(F.sum(F.when(large, F.col("have"))), F.sum(F.when(large, F.pow("have", F.lit(targets.alpha))))).first()
        return sums.select(d, F.when(large, F.pow("have", F.lit(targets.alpha)) * F.lit(float(room or 0) / float(own or 1))).otherwise(F.col("have")).alias("goal"))
    share = F.lit(None).cast("double")
    for v, x in targets.items():
        share = F.when(F.col(d) == v, x).otherwise(share)
    sums = sums.withColumn("share", share)
    said, own = sums.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("have")))).first()
    left = max(0.0, 1.0 - (said or 0.0)) if own else 0.0
    share = F.coalesce("share", F.lit(left / float(own or 1)) * F.col("have"))
    return sums.select(d, (share * F.lit(total / ((said or 0.0) + left or 1.0))).alias("goal"))


def fit_cells(cells: DataFrame, targets: Targets = TARGETS, limit: int = CELLS) -> DataFrame:
    """(source, lang, topic, tokens, docs, keep_p) of every cell (source, lang, topic, tokens, docs)."""
    if cells.count() <= limit:
        rows = sorted(((r.source, r.lang, r.topic), r.tokens, r.docs) for r in cells.collect())
        fit = rake([(v, n) for v, n, _ in rows], targets)
        return cells.sparkSession.createDataFrame([(*v, n, c, w) for (v, n, c), w in zip(rows, fit, strict=True)], "source string, lang string, topic string, tokens long, docs long, keep_p double")
    return rake_frame(cells, targets).select(*DIMS, "tokens", "docs", "keep_p")


def marginals(fitted: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """(dim, value, have, target, reached, gap) of every value: shares of the tokens before, asked for, and expected to stay."""
    out = None
    total, stays = fitted.agg(F.sum("tokens").cast("double"), F.sum(F.col("tokens") * F.col("keep_p"))).first()
    for d in DIMS:
        goal = _goal_frame(fitted, d, targets.get(d, {}), float(total or 0))
        have = fitted.groupBy(d).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("have"), (F.sum(F.col("tokens") * F.col("keep_p")) / F.lit(float(stays or 1))).alias("reached"))
        one = have.join(goal, d).select(F.lit(d).alias("dim"), F.nullif(F.col(d), F.lit(NULL)).alias("value"), "have", (F.col("goal") / F.lit(float(total or 1))).alias("target"), "reached")
        out = one if out is None else out.union(one)
    return out.withColumn("gap", F.col("reached") - F.col("target"))


def _named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL))


def draw(key: str, text: str) -> Column:
    """Uniform in [0, 1) by id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key).cast("string"), F.col(text)), 11).cast("double") / F.lit(float(1 << 53))


def _measured(at: int) -> Callable:
    """All columns but the text (number ``at``), then n_tokens and the word vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in T.pieces(b.column(at)):
                _, _, _, wo = T.words(data, off)
                blobs = [x.tobytes() for x in topics.vector(data, off)]
                rest = [c.slice(i, j - i) for n, c in enumerate(b.columns) if n != at]
                names = [c for n, c in enumerate(b.schema.names) if n != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(wo) + 1, pa.int64()), pa.array(blobs, pa.binary())], [*names, "n_tokens", "vector"])

    return run


@dataclass(frozen=True)
class Topics:
    """What names a text's topic: ``means`` (lang, mean), whether they are few, and the centres."""

    means: DataFrame
    few: bool
    centres: np.ndarray


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Topics]:
    """(rows with id, source, lang, draw, n_tokens, topic; topic model) of ``docs``."""
    some = docs.select(F.col(key).alias("id"), _named("source").alias("source"), _named("lang").alias("lang"), draw(key, text).alias("draw"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    raw = materialise(map_arrow(some, _measured(4), f"id {kind}, source string, lang string, draw double, n_tokens long, vector binary"), "mixraw")
    mean = materialise(topics.means(raw), "means")
    few = mean.limit(LANGS + 1).count() <= LANGS
    rows = materialise(topics.centred(raw, mean, few), "mixrows")
    discard(raw)
    centres = topics.fit(rows)
    return topics.name_topics(rows, centres), Topics(mean, few, centres)


def _cells(rows: DataFrame, targets: Targets) -> DataFrame:
    cells = materialise(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "cells")
    return fit_cells(cells, targets)


def _bounded(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.limit(CELLS + 1).count() <= CELLS else cells


def mix(docs: DataFrame, targets: Targets = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, source, lang, topic, keep_p, kept) of every document."""
    rows, _ = _rows(docs, key, text)
    cells = _cells(rows, targets).select(*DIMS, "keep_p")
    out = rows.join(_bounded(cells), list(DIMS), "left")
    back = lambda c: F.nullif(F.col(c), F.lit(NULL)).alias(c)
    return out.select(F.col("id").alias(key), "n_tokens", back("source"), back("lang"), "topic", "keep_p", (F.col("draw") < F.col("keep_p")).alias("kept"))


def _keep(model, odds, at: int) -> Callable:
    """Batches without the rows that the draw drops; their last columns are source, lang (as named in the cells) and the draw.

    ``model``: mean by language and centres; ``odds``: probability by cell; ``at``: the text's column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (means, centres), chance = model.value, odds.value
        for b in batches:
            keep, n = np.zeros(b.num_rows, bool), b.num_columns - 3
            source, lang, drawn = (b.column(n + i).to_pylist() for i in range(3))
            for i, j, data, off in T.pieces(b.column(at)):
                named = topics.assign(topics.vector(data, off), np.array([means[x] for x in lang[i:j]]), centres)
                keep[i:j] = [d < chance[cell] for d, cell in zip(drawn[i:j], zip(source[i:j], lang[i:j], named, strict=True), strict=True)]
            yield b.select(list(range(n))).filter(pa.array(keep))

    return run


def mix_documents(docs: DataFrame, targets: Targets = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the fitted probabilities keep, with all their columns."""
    rows, model = _rows(docs, key, text)
    cells = _cells(rows, targets)
    sc = docs.sparkSession.sparkContext
    names = [fresh(docs, f"{c}_of_row") for c in ("source", "lang", "draw")]
    both = docs.withColumns(dict(zip(names, (_named("source"), _named("lang"), draw(key, text)), strict=True)))
    if model.few and cells.limit(CELLS + 1).count() <= CELLS:  # bounded: every task gets all means and probabilities
        chance = {(r.source, r.lang, r.topic): r.keep_p for r in cells.collect()}
        means = {r.lang: np.array(r.mean) for r in model.means.collect()}
        return map_arrow(both, _keep(sc.broadcast((means, model.centres)), sc.broadcast(chance), docs.columns.index(text)), docs.schema)
    # more than a task should hold: the draws of what stays, through a join (a draw tells id and text apart)
    kept = rows.join(cells.select(*DIMS, "keep_p"), list(DIMS)).where("draw < keep_p").select("source", "lang", "draw").distinct()
    return both.join(kept.toDF(*names), names, "left_semi").select(*docs.columns)


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("keep_p", 6).alias("keep_p"), "kept")
