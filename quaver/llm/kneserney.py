"""Interpolated modified Kneser-Ney language model, counted in Spark.

The order is 2 (word pairs over ``<s> words </s>``).  Order 3 was sized and not
built; the README gives the figures.

* Words are hashed; each task sends its distinct words, in hash ranges, as two
  packed arrays.  A range's reducer writes a sorted hash array with counts; a
  word's rank over all ranges is its 32-bit id.
* Pairs are 64-bit keys (id, next id).  Each task sends its distinct pairs in key
  ranges of equal expected mass, as packed deltas; a frequent word's pairs spread
  over several ranges.  A range's reducer writes its sorted keys and counts, and
  for each context in it how many pairs occur once, twice, more often.
* Continuation counts (distinct words before a word) are summed by word range.
* Scoring tasks memory-map the arrays and look up sorted distinct keys, so a
  task sweeps each file once and no model is ever held in memory or collected.

Files lie in the shared folder; a worker maps them in place where that is a
local path, else it maps an unlinked local copy.  A map holds no file open, and only
ranges whose bounds hold an asked key are mapped at all.  A range has a reducer
partition of its own, sized by input bytes, so a task's work does not grow with the
corpus.  Every file is written under a
temporary name and renamed, so a task that runs again only repeats its work.

Edge cases: null and empty texts are one end token; a very long text is read in
pieces for counting and scored whole; a null id counts as training text and is kept
as it is; without training texts every token has probability 1/(V+1); repeated rows
count as often as they occur; keys have one order, so there are no ties; only id and
text are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
import mmap
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import textvec as T
from quaver.llm.shared import crc32_text, map_arrow, materialise, new_folder, text_bytes

#: Input bytes for one word range and one pair range; distinct keys that a task holds before it sends them.
WORD_RANGE, PAIR_RANGE, HELD = 64 << 20, 16 << 20, 3_000_000
BLOBS = "shard int, keys binary, counts binary"


def pack(x: np.ndarray) -> bytes:
    """Byte planes of the differences of a sorted array: high planes are zeros and compress away."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(blob: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    st = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[st], np.add.reduceat(c.astype(np.int64), st).astype(np.uint32) if len(k) else c


class Bag:
    """Distinct keys with counts, merged now and then."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.loose = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.uint32))
        self.loose += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merge(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        self.keys, self.counts, self.loose = [], [], 0
        return out


def save(folder: str, name: str, x: np.ndarray) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(x).tobytes())
    fs.move(part, f"{path}/{name}")


_maps: dict[tuple[str, str], np.ndarray] = {}


def _view(file, dtype: type) -> np.ndarray:
    """A map that keeps no descriptor: a worker may hold any number of them."""
    return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype)


def mapped(folder: str, name: str, dtype: type) -> np.ndarray:
    """A file of the model as a memory map; kept open while the worker uses this model."""
    at = (folder, name)
    if at not in _maps:
        for old in [k for k in _maps if k[0] != folder]:
            del _maps[old]
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
        if fs.get_file_info(path).size == 0:
            _maps[at] = np.zeros(0, dtype)
        elif isinstance(fs, pafs.LocalFileSystem):
            with open(path, "rb") as src:
                _maps[at] = _view(src, dtype)
        else:  # the copy has no name and goes with the map
            with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as src:
                while chunk := src.read(8 << 20):
                    copy.write(chunk)
                copy.flush()
                _maps[at] = _view(copy, dtype)
    return _maps[at]


@dataclass
class Model:
    """Where the arrays lie, and the corpus-wide figures."""

    folder: str
    offsets: np.ndarray  # first word id of each word range, and the number of words
    mass: np.ndarray  # training words before each word range, and their number
    docs: int
    pair_ranges: int
    #: First and last key of each pair range (first above last where it is empty).
    first: np.ndarray | None = None
    last: np.ndarray | None = None
    pairs: int = 0
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_gamma: float = 1.0
    end_before: int = 0

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    @property
    def tokens(self) -> int:
        return int(self.mass[-1]) + self.docs

    @property
    def kinds(self) -> int:
        return self.words + (self.docs > 0)

    def by_range(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(word range, positions in sorted ``ids``) of the words among them."""
        cut = np.searchsorted(ids, self.offsets)
        for s in range(len(self.offsets) - 1):
            if cut[s + 1] > cut[s]:
                yield s, np.arange(cut[s], cut[s + 1])

    def gather(self, name: str, ids: np.ndarray, dtype: type, extra: tuple[int, int]) -> np.ndarray:
        """Values of sorted ids; ``extra`` are those of </s> and <s>."""
        out = np.zeros(len(ids), np.int64)
        for s, at in self.by_range(ids):
            out[at] = mapped(self.folder, f"{name}-{s:05d}", dtype)[ids[at] - self.offsets[s]]
        out[ids == self.words] = extra[0]
        out[ids == self.words + 1] = extra[1]
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids of hashes; -1 where the word was not in training text."""
        u, back = np.unique(h, return_inverse=True)
        out = np.full(len(u), -1, np.int64)
        ranges = len(self.offsets) - 1
        shard = word_range(u, ranges)
        cut = np.searchsorted(shard, np.arange(ranges + 1))
        for s in range(ranges):
            if cut[s + 1] > cut[s]:
                have, ask = mapped(self.folder, f"hash-{s:05d}", np.uint64), u[cut[s] : cut[s + 1]]
                if len(have):
                    at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
                    out[cut[s] : cut[s + 1]] = np.where(have[at] == ask, at + self.offsets[s], -1)
        return out[back]

    def pair_range(self, keys: np.ndarray) -> np.ndarray:
        """The range of each sorted key (both words known): rising with the key, even in mass."""
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        u, back = np.unique(left, return_inverse=True)
        before = self.gather("before", u, np.int64, (0, 0)).astype(float)
        for s, at in self.by_range(u):
            before[at] += float(self.mass[s])
        before[u >= self.words] = float(self.mass[-1])
        own = self.gather("count", u, np.uint32, (0, self.docs)).astype(float)
        spot = before[back] + own[back] * (right / (self.words + 2.0))
        return np.minimum((spot * (self.pair_ranges / max(1.0, float(self.tokens)))).astype(np.int64), self.pair_ranges - 1)


def word_range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _send(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    cut = np.searchsorted(shard, np.arange(ranges + 1))
    for s in range(ranges):
        k, c = keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(k)], pa.binary()), pa.array([planes(c)], pa.binary())], ["shard", "keys", "counts"])


def _each_range(df: DataFrame, ranges: int, write, schema: str) -> DataFrame:
    """``write(shard, table)`` for the rows of each shard, every shard in a partition of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            table = pa.Table.from_batches(own)
            yield from write(table.column("shard")[0].as_py(), table).to_batches()

    return map_arrow(df.repartitionById(ranges, F.col("shard")), run, schema)


def _words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag, texts = Bag(), 0
        for b in batches:
            texts += b.num_rows
            for *_, data, off in T.pieces(b.column(0)):
                bag.add(T.words(data, off)[2])
                if bag.loose > HELD:
                    k, c = bag.take()
                    if len(k) > HELD // 2:
                        yield from _send(k, c, word_range(k, ranges), ranges)
                    else:
                        bag.keys, bag.counts, bag.loose = [k], [c], len(k)
        k, c = bag.take()
        yield from _send(k, c, word_range(k, ranges), ranges)
        # the texts of this task, as one row of a shard past the ranges
        yield pa.RecordBatch.from_arrays([pa.array([ranges], pa.int32()), pa.array([np.array([texts], np.int64).tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["shard", "keys", "counts"])

    return run


def _write_words(folder: str, ranges: int):
    def run(s: int, table: pa.Table) -> pa.Table:
        if s == ranges:
            n, t = 0, sum(int(np.frombuffer(x.as_py(), np.int64)[0]) for x in table.column("keys"))
        else:
            k, c = _merge([unpack(x.as_py(), np.uint64) for x in table.column("keys")], [unplanes(x.as_py(), np.uint32) for x in table.column("counts")])
            total = np.cumsum(c, dtype=np.int64)
            save(folder, f"hash-{s:05d}", k)
            save(folder, f"count-{s:05d}", c)
            save(folder, f"before-{s:05d}", total - c)
            n, t = len(k), int(total[-1])
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([n], pa.int64()), "total": pa.array([t], pa.int64())})

    return run


def token_ids(model: Model, h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left ids, right ids, offsets by text) of all word pairs; -1 is an unknown word."""
    ids = model.ids(h)
    left, right = np.insert(ids, wo[:-1], model.words + 1), np.insert(ids, wo[1:], model.words)
    return left, right, wo + np.arange(len(wo))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def _pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Bag()
        for b in batches:
            for *_, data, off in T.pieces(b.column(0)):
                _, _, h, wo = T.words(data, off)
                left, right, _ = token_ids(model, h, wo)
                bag.add(pair_keys(left, right))
                if bag.loose > HELD:
                    k, c = bag.take()
                    if len(k) > HELD // 2:
                        yield from _send(k, c, model.pair_range(k), model.pair_ranges)
                    else:
                        bag.keys, bag.counts, bag.loose = [k], [c], len(k)
        k, c = bag.take()
        if len(k):
            yield from _send(k, c, model.pair_range(k), model.pair_ranges)

    return run


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _write_pairs(model: Model):
    """Writes a range's arrays; gives its figures (shard -1) and continuation counts by word range."""

    def run(s: int, table: pa.Table) -> pa.Table:
        k, c = _merge([unpack(x.as_py(), np.uint64) for x in table.column("keys")], [unplanes(x.as_py(), np.uint32) for x in table.column("counts")])
        save(model.folder, f"pair-{s:05d}", k)
        save(model.folder, f"paircount-{s:05d}", c)
        left = (k >> np.uint64(32)).astype(np.uint32)
        st = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        kinds = [np.add.reduceat(x.astype(np.uint32), st) for x in (c == 1, c == 2, c >= 3)]
        save(model.folder, f"context-{s:05d}", np.stack([left[st], *kinds]).astype(np.uint32))
        w, n = np.unique((k & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
        shards, a, b = [-1], [np.array([s, len(k), *_counts_of_counts(c), *k[[0, -1]].view(np.int64)], np.int64).tobytes()], [b""]
        shard = np.minimum(np.searchsorted(model.offsets, w, "right") - 1, len(model.offsets) - 2)
        cut = np.searchsorted(shard, np.arange(len(model.offsets)))
        for i in range(len(model.offsets) - 1):
            if cut[i + 1] > cut[i]:
                shards.append(i)
                a.append(pack(w[cut[i] : cut[i + 1]]))
                b.append(planes(n[cut[i] : cut[i + 1]].astype(np.uint32)))
        return pa.table({"shard": pa.array(shards, pa.int32()), "keys": pa.array(a, pa.binary()), "counts": pa.array(b, pa.binary())})

    return run


def _write_continuations(model: Model):
    def run(s: int, table: pa.Table) -> pa.Table:
        size = int(model.offsets[s + 1] - model.offsets[s])
        total = np.zeros(size + 1, np.int64)  # the last is </s>
        for x, y in zip(table.column("keys"), table.column("counts"), strict=True):
            at = unpack(x.as_py(), np.uint32).astype(np.int64) - int(model.offsets[s])
            total[at] += unplanes(y.as_py(), np.uint32)
        save(model.folder, f"cont-{s:05d}", total[:size].astype(np.uint32))
        end = int(total[size]) if s == len(model.offsets) - 2 else 0
        return pa.table({"end": pa.array([end], pa.int64()), "c": pa.array([_counts_of_counts(total[:size])], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))  # type: ignore[return-value]


def train(texts: DataFrame) -> Model:
    """The model of the column ``text`` of ``texts``."""
    spark = texts.sparkSession
    size = max(1, text_bytes(texts))
    word_ranges, pair_ranges = max(4, math.ceil(size / WORD_RANGE)), max(8, math.ceil(size / PAIR_RANGE))
    folder = new_folder(spark, "lm")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    rows = _each_range(map_arrow(texts.select("text"), _words(word_ranges), BLOBS), word_ranges + 1, _write_words(folder, word_ranges), "shard int, n long, total long").collect()
    sizes, totals, docs = np.zeros(word_ranges, np.int64), np.zeros(word_ranges, np.int64), 0
    for r in rows:
        if r.shard == word_ranges:
            docs = r.total
        else:
            sizes[r.shard], totals[r.shard] = r.n, r.total
    for s in np.flatnonzero(sizes == 0):  # ranges without words
        for name in ("hash", "count", "before"):
            save(folder, f"{name}-{s:05d}", np.zeros(0, np.uint8))
    model = Model(folder, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(totals)]), docs, pair_ranges)
    if model.words + 2 > 1 << 32:
        raise OverflowError(f"{model.words} words; an id has 32 bits")
    if not docs:
        return model
    sent = map_arrow(texts.select("text"), _pairs(model), BLOBS)
    made = materialise(_each_range(sent, pair_ranges, _write_pairs(model), BLOBS), "continuations")
    figures = np.array([np.frombuffer(bytes(r.keys), np.int64) for r in made.where("shard < 0").collect()])
    model.first, model.last = np.full(pair_ranges, (1 << 64) - 1, np.uint64), np.zeros(pair_ranges, np.uint64)
    model.first[figures[:, 0]], model.last[figures[:, 0]] = figures[:, 6].view(np.uint64), figures[:, 7].view(np.uint64)
    model.pairs, model.discounts = int(figures[:, 1].sum()), discounts([int(x) for x in figures[:, 2:6].sum(axis=0)])
    low = _each_range(made.where("shard >= 0"), word_ranges, _write_continuations(model), "end long, c array<long>").collect()
    have = {int(r[0]) for r in made.where("shard >= 0").select("shard").distinct().collect()}
    for s in set(range(word_ranges)) - have:
        save(folder, f"cont-{s:05d}", np.zeros(int(sizes[s]), np.uint32))
    model.end_before = sum(r.end for r in low)
    of = np.sum([r.c for r in low], axis=0) + np.array(_counts_of_counts(np.array([model.end_before])))
    model.low = discounts([int(x) for x in of])
    more = model.kinds - int(of[:2].sum())
    model.low_gamma = min(1.0, (model.low[0] * of[0] + model.low[1] * of[1] + model.low[2] * more) / max(1, model.pairs))
    return model


def _take_off(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0.0, c - np.array([0.0, *d])[np.minimum(c, 3)])


def log10_probabilities(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the base, log10 of the model) of every pair; -1 is an unknown word."""
    lw, lback = np.unique(left, return_inverse=True)
    rw, rback = np.unique(right, return_inverse=True)
    known = rw >= 0
    count = np.zeros(len(rw), np.int64)
    cont = np.zeros(len(rw), np.int64)
    if model.docs:
        count[known] = model.gather("count", rw[known], np.uint32, (model.docs, 0))
        cont[known] = model.gather("cont", rw[known], np.uint32, (model.end_before, 0))
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.kinds + 1)))
    uni = model.low_gamma / (model.kinds + 1) + _take_off(cont, model.low) / max(1, model.pairs)
    if not model.docs:
        uni = np.full(len(rw), 1.0 / (model.kinds + 1))
    p = uni[rback]
    own = np.zeros(len(lw), np.int64)
    own[lw >= 0] = model.gather("count", lw[lw >= 0], np.uint32, (0, model.docs))
    seen = np.zeros((3, len(lw)), np.int64)
    both = (left >= 0) & (right >= 0)
    keys, kback = np.unique(pair_keys(left[both], right[both]), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    if model.docs:
        lo, hi = np.searchsorted(keys, model.first), np.searchsorted(keys, model.last, "right")
        for s in np.flatnonzero(hi > lo):
            have, numbers = mapped(model.folder, f"pair-{s:05d}", np.uint64), mapped(model.folder, f"paircount-{s:05d}", np.uint32)
            ask = keys[lo[s] : hi[s]]
            at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
            times[lo[s] : hi[s]] = np.where(have[at] == ask, numbers[at], 0)
        known_left = lw.clip(0).astype(np.uint64)
        lo, hi = np.searchsorted(known_left, model.first >> np.uint64(32)), np.searchsorted(known_left, model.last >> np.uint64(32), "right")
        for s in np.flatnonzero(hi > lo):
            context = mapped(model.folder, f"context-{s:05d}", np.uint32).reshape(4, -1)
            ask = lw[lo[s] : hi[s]]
            at = np.minimum(np.searchsorted(context[0], known_left[lo[s] : hi[s]].astype(np.uint32)), context.shape[1] - 1)
            hit = context[0][at] == ask
            for i in range(3):
                seen[i, lo[s] : hi[s]] += np.where(hit, context[i + 1][at], 0)
    gamma = np.where(own > 0, (np.array(model.discounts) @ seen) / np.maximum(1, own), 1.0)
    p = p * gamma[lback]
    top = np.zeros(len(left))
    top[both] = _take_off(times, model.discounts)[kback] / np.maximum(1, own[lback[both]])
    return base[rback], np.log10(p + top)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in T.pieces(b.column(1), 16 * T.PIECE):
                _, _, h, wo = T.words(data, off)
                left, right, to = token_ids(model, h, wo)
                base, p = log10_probabilities(model, left, right)
                known = (right >= 0) & ((right < model.words) | (model.docs > 0))
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(to)), pa.array(T.sums(known.astype(np.int64), to)), pa.array(np.full(j - i, model.tokens, np.int64)), pa.array(T.sums(base, to)), pa.array(T.sums(p, to))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, held_out=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's tokens, base score and log10 probability under ``model``."""
    held = F.lit(False) if held_out is None else held_out
    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out")), _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_mark(key: str = "doc_id"):
    return F.coalesce(crc32_text(key) % 5 == 1, F.lit(False))


def q_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out_mark()).select("text"))
    out = score(docs, model, held_out_mark())
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
