"""Token ids in training order, as binary shards of fixed stride.

Texts become token ids, each followed by an end token; a task's stream is cut
into sequences of LENGTH ids (the last one filled up with end tokens).  Sequences
are numbered 0..n-1 over all tasks, and a keyed Feistel network over the next
even power of two, walked along its cycle until it is back under n, permutes the
numbers: a bijection, so every sequence has one global slot and every slot a
sequence.  Slots are cut into shards of PER_SHARD; each is one file of
``slot % PER_SHARD * stride`` offsets, so a reader resumes anywhere with a seek.
Slots are dealt to tasks by ranges of whole shards, about PART bytes each, so a
task's work does not grow with the corpus.

The cut sequences are written once to the shared folder, so that texts are encoded
once and the numbers rest on a table that no lost executor can change.  Each is
packed on its own: ids become their ranks in an alphabet, the ranks' byte planes
are compressed.  The alphabet is ordered by a look at a few texts; any order gives
the same ids back, only less tightly.  A shard file is written under a temporary name and
renamed, so a task that runs again replaces equal bytes.

Words repeat, so each distinct (white space, word) chunk is encoded once a
worker and its ids are gathered; texts with other Unicode spaces, where such
chunks would not be the tokenizer's own, are encoded whole.  Both ways give the
tokenizer's ids.

Edge cases: null and empty texts are one end token; a very long text runs on over
as many sequences as it needs; repeated rows are written as often as they occur,
ties need no order, as the numbers follow the rows' places in the table that is
read; null ids are null in ``doc_ids``; columns other than id and text are not
read, whatever their names; an empty table gives no sequences and no shard files.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import textvec as T
from quaver.llm.shared import discard, map_arrow, materialise, new_folder

VOCAB, END, LENGTH, PER_SHARD, KEY = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 2048, 2048, 0x5EED
#: Fixed value: the vocabulary's splitting pattern, from its description.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHE = 600_000
#: Bytes of shards that one writing task gets; texts and characters of each that the alphabet's order looks at; zstd level.
PART, LOOK, LOOK_CHARS, LEVEL = 32 << 20, 200, 20_000, 5
#: The ids are compressed already: the writer's own buffers and codecs would only hold memory.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20)}

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of pieces of texts, with a cache of chunks in sorted arrays."""

    def __init__(self, vocab: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocab).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        #: Sorted (hashes, entries), each level at least twice as long as the next.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def learn(self, hashes: np.ndarray, spans: list[bytes]) -> None:
        if len(self.start) > CACHE:
            self.clear()
        encode = self.encoding.encode_ordinary
        ids = [encode(s.decode("utf-8", "replace")) for s in spans]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at, entry = len(self.flat), np.arange(len(self.start), len(self.start) + len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint16, int(size.sum()))])
        self.start, self.size = np.concatenate([self.start, at + np.cumsum(size) - size]), np.concatenate([self.size, size])
        h = np.asarray(hashes)
        while self.levels and len(self.levels[-1][0]) < 2 * len(h):  # merged like this, an entry is sorted a few times only
            more, its = self.levels.pop()
            h, entry = np.concatenate([more, h]), np.concatenate([its, entry])
        order = np.argsort(h, kind="stable")
        self.levels.append((h[order], entry[order]))

    def find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, whether there is one) of every hash."""
        out = np.full(len(u), -1, np.int64)
        for h, entry in self.levels:
            left = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(h, u[left]), len(h) - 1)
            same = h[at] == u[left]
            out[left[same]] = entry[at[same]]
        return out, out >= 0

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of a piece, an end token after every text."""
        st, en, _, wo = T.words(data, off, T.SAME)
        # chunks: from the end of the word before (or the text's start) to a word's end; and what follows the last word
        first = np.zeros(len(st), bool)
        m = np.diff(wo)
        first[wo[:-1][m > 0]] = True
        begin = np.concatenate([[0], en[:-1]]) if len(en) else en
        begin = np.where(first, off[:-1][T.by_text(wo)], begin)
        tail = np.where(m > 0, en[np.maximum(wo[1:] - 1, 0)] if len(en) else off[:-1], off[:-1])
        doc = np.concatenate([T.by_text(wo), np.arange(len(m))])
        cs, ce = np.concatenate([begin, tail]), np.concatenate([en, off[1:]])
        order = np.argsort(doc, kind="stable")
        doc, cs, ce = doc[order], cs[order], ce[order]
        h = T.hash_spans(data, cs, ce) if len(data) else np.zeros(len(cs), np.uint64)
        u, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, have = self.find(u)
        if not have.all():
            new = np.flatnonzero(~have)
            raw = data.tobytes()
            self.learn(u[new], [raw[cs[i] : ce[i]] for i in where[new]])
            at, have = self.find(u)
            if not have.all():  # the cache was emptied: learn this piece whole
                self.clear()
                self.learn(u, [raw[cs[i] : ce[i]] for i in where])
                at, _ = self.find(u)
        size, start = self.size[at][back], self.start[at][back]
        last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
        room = size + last
        to = np.cumsum(room) - room
        out = np.full(int(room.sum()), END, np.uint16)
        total = int(size.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + inner] = self.flat[np.repeat(start, size) + inner]
        ends = (to + room)[last]
        offsets = np.concatenate([[0], ends])
        odd = self.odd(data, off)
        if len(odd):
            parts = [out[offsets[d] : offsets[d + 1]] for d in range(len(m))]
            for d in odd:
                parts[d] = np.array([*self.encoding.encode_ordinary(data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")), END], np.uint16)
            out, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return out, offsets

    @staticmethod
    def odd(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts with white space beyond ASCII's six."""
        lead = ((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        some = np.unique(np.searchsorted(off, np.flatnonzero(lead), "right") - 1)
        return np.array([d for d in some if OTHER_SPACE.search(data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))], np.int64)


def encoder(vocab: str) -> Encoder:
    if vocab not in _encoders:
        _encoders[vocab] = Encoder(vocab)
    return _encoders[vocab]


def permute(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of the numbers ``x`` < n: a keyed bijection of 0..n-1."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for r in range(rounds):
            salt = np.uint64(((key << 8 | r) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (T.mix(right + salt) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x, np.uint64))
    while (out >= n).any():
        far = out >= n
        out[far] = once(out[far])
    return out.astype(np.int64)


def _stream(batches: Iterator[pa.RecordBatch], vocab: str, length: int) -> Iterator[tuple[np.ndarray, list]]:
    """(ids, doc_ids) of each sequence of a task, in order."""
    enc = encoder(vocab)
    held, owners = np.zeros(0, np.uint16), []  # owners: (doc_id, ids still to come)
    for b in batches:
        for i, j, data, off in T.pieces(b.column(1), 4 * T.PIECE):
            ids, cut = enc.encode(data, off)
            held = np.concatenate([held, ids])
            owners += zip(b.column(0).slice(i, j - i).to_pylist(), np.diff(cut).tolist(), strict=True)
            at = mine = 0
            while len(held) - at >= length:
                left, docs = length, []
                while left:
                    doc, n = owners[mine]
                    docs.append(doc)
                    use = min(left, n)
                    left -= use
                    if use == n:
                        mine += 1
                    else:
                        owners[mine] = (doc, n - use)
                yield held[at : at + length], docs
                at += length
            held, owners = held[at:], owners[mine:]
    if len(held):
        yield np.concatenate([held, np.full(length - len(held), END, np.uint16)]), [d for d, _ in owners]


def alphabet(docs: DataFrame, vocab: str) -> np.ndarray:
    """All ids, those of a few of the texts first, by their number there."""
    looked = [r[0] or "" for r in docs.select(F.substring("text", 1, LOOK_CHARS)).limit(LOOK).collect()]
    ids = [i for x in looked for i in encoder(vocab).encoding.encode_ordinary(x)]
    return np.argsort(-np.bincount(np.array(ids, np.int64), minlength=1 << 16), kind="stable").astype(np.uint16)


def squeeze(ids: np.ndarray, ranks: np.ndarray, codec: pa.Codec) -> bytes:
    """A sequence as compressed byte planes of its ids' ranks."""
    return codec.compress(np.ascontiguousarray(ranks[ids].view(np.uint8).reshape(-1, 2).T).tobytes(), asbytes=True)


def expand(blob: pa.Buffer, letters: np.ndarray, length: int, codec: pa.Codec) -> np.ndarray:
    planes = np.frombuffer(codec.decompress(blob, 2 * length), np.uint8).reshape(2, -1)
    return letters[np.ascontiguousarray(planes.T).view(np.uint16).ravel()]


def _sequences(vocab: str, length: int, letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codec = TaskContext.get().partitionId(), pa.Codec("zstd", compression_level=LEVEL)
        ranks = np.empty(1 << 16, np.uint16)
        ranks[letters.value] = np.arange(1 << 16)
        at, rows = 0, []

        def batch() -> pa.RecordBatch:
            place = np.arange(at - len(rows), at)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(place), pa.array([squeeze(x, ranks, codec) for x, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.list_(pa.int64()))], ["part", "place", "ids", "doc_ids"])

        for x in _stream(batches, vocab, length):
            rows.append(x)
            at += 1
            if len(rows) == 256:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return run


def _number(starts, n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.array([starts.value[p] for p in b.column("part").to_pylist()], np.int64)
            number = first + b.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(permute(number, n, key)), pa.array(number), b.column("ids"), b.column("doc_ids")], ["slot", "sequence", "ids", "doc_ids"])

    return run


def _write(folder: str, length: int, per_shard: int, letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        codec = pa.Codec("zstd")
        shard, out, part = -1, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(part, f"{path}/shard-{shard:06d}.bin")

        for b in batches:
            crc = []
            for slot, blob in zip(b.column("slot").to_pylist(), b.column("ids"), strict=True):
                raw = expand(blob.as_buffer(), letters.value, length, codec).tobytes()
                if slot // per_shard != shard:
                    close()
                    shard, part = slot // per_shard, f"{path}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                out.write(raw)
                crc.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("sequence"), pa.array(crc, pa.int64()), b.column("doc_ids")], ["slot", "sequence", "ids_crc32", "doc_ids"])
        close()

    return run


def write_training_order(docs: DataFrame, folder: str, vocab: str = VOCAB, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, sequence, ids_crc32, doc_ids) of every sequence, once the shards and then the manifest are written to ``folder``."""
    spark = docs.sparkSession
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    rows = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    letters = spark.sparkContext.broadcast(alphabet(rows, vocab))
    made = materialise(map_arrow(rows, _sequences(vocab, length, letters), "part int, place long, ids binary, doc_ids array<long>"), "sequences", **PLAIN)
    counts = sorted((r.part, r.n) for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task of the first read
    starts, n = {}, 0
    for part, c in counts:
        starts[part] = n
        n += c
    emitted = map_arrow(made, _number(spark.sparkContext.broadcast(starts), n, key), "slot long, sequence long, ids binary, doc_ids array<long>")
    each = per_shard * max(1, PART // (2 * length * per_shard))
    dealt = emitted.repartitionById(max(1, -(-n // each)), F.floor(F.col("slot") / each).cast("int")).sortWithinPartitions("slot")
    written = materialise(map_arrow(dealt, _write(folder, length, per_shard, letters), "slot long, sequence long, ids_crc32 long, doc_ids array<long>"), "written")
    discard(made)
    # the manifest comes last: where it is, all shards are
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"sequences": n, "length": length, "per_shard": per_shard, "dtype": "uint16", "stride": 2 * length, "end": END, "key": key}).encode())
    return written


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """Ids of ``count`` sequences from slot ``first`` on, by seeks: (count, length)."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    out, slot = [], first
    while slot < min(first + count, m["sequences"]):
        take = min(first + count, m["sequences"], (slot // m["per_shard"] + 1) * m["per_shard"]) - slot
        with fs.open_input_file(f"{path}/shard-{slot // m['per_shard']:06d}.bin") as f:
            f.seek(slot % m["per_shard"] * m["stride"])
            out.append(np.frombuffer(f.read(take * m["stride"]), m["dtype"]).reshape(-1, m["length"]))
        slot += take
    return np.concatenate(out) if out else np.zeros((0, m["length"]), np.uint16)


def q_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_training_order(docs, new_folder(spark, "tokens")).withColumn("shard", F.floor(F.col("slot") / PER_SHARD))
