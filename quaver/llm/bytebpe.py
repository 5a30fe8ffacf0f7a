"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

No training: each token's bytes become a piece, byte b as the character U+0100 + b,
with the score -rank; normalisation is identity, with no prefix and no white space
treatment.  Sentencepiece merges the neighbours whose joined piece scores best, the
leftmost first, which is the merge rule of ranks.  A text is cut by the vocabulary's
pattern and every match is encoded on its own; ids map back to pieces, and pieces to
bytes.

The model (about a MB) is built once on the driver and broadcast; a worker keeps the
ids of at most CACHE short pre-tokens.  Texts of over LONG characters are matched
lazily, in runs of pre-tokens.

Edge cases: null and empty texts have no ids and decode to no bytes; a text or
pre-token may be of any length; ids that are no whole 32-bit numbers or not in the
vocabulary decode to null, as null ids do; repeated rows are encoded as often as they
occur; equal ranks, gaps and missing bytes in a vocabulary are refused with a
ValueError, so there are no ties; null keys are kept; other columns are kept where
they are named in ``keep`` and may have any name but the result's; an empty table
gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator, Sequence
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.shared import map_arrow

VOCAB = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers, the longest of them, and the characters from which a text is matched in runs of RUN.
CACHE, SHORT, LONG, RUN = 300_000, 40, 1 << 19, 1 << 16
#: Byte b is the character U+0100 + b in pieces: never white space, never special.
UP = {b: 0x100 + b for b in range(256)}
DOWN = {0x100 + b: b for b in range(256)}

# fixed values: field numbers and enumerators of sentencepiece's public model format
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE = 3, 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file (base64, space, rank by line) on the driver."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(PIECES, _block(PIECE, text.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", score) + _number(KIND, kind))


def to_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(UP)


def to_bytes(piece: str) -> bytes:
    return piece.translate(DOWN).encode("latin-1")


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose ids are the ranks; one unknown piece follows them, which no text needs."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and hold every single byte")
    pieces = b"".join(_piece(to_chars(t), -float(i), NORMAL) for i, t in enumerate(tokens))
    as_it_is = _block(NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(EXTRA_SPACES, 0) + _number(ESCAPE_SPACES, 0)
    return pieces + _piece("<unk>", 0.0, UNKNOWN) + _block(TRAINER, _number(MODEL_TYPE, BPE)) + _block(NORMALIZER, as_it_is)


class Codec(dict):
    """Packed ids by pre-token, filled as they are met, and the tokens' bytes by id."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = [to_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size() - 1)]
        #: A pre-token that is a token is that token, even where no merges lead to it.
        self.known = {t: i for i, t in enumerate(self.tokens)}
        self.match = regex.compile(pattern)

    def __missing__(self, part: str) -> bytes:
        raw = part.encode()
        whole = self.known.get(raw)
        out = np.array(self.pieces.encode(to_chars(raw)) if whole is None else [whole], "<u4").tobytes()
        if len(part) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[part] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, self.match.findall(text)))
        found, out = self.match.finditer(text), []
        while run := b"".join(self[m[0]] for m in islice(found, RUN)):
            out.append(run)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes | None:
        if ids is None or len(ids) % 4:
            return None
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except IndexError:
            return None


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    if (model, pattern) not in _codecs:
        _codecs.clear()
        _codecs[model, pattern] = Codec(model, pattern)
    return _codecs[model, pattern]


def _add(df: DataFrame, model: bytes, pattern: str, source: str, keep: Sequence[str], out: str, how: str) -> DataFrame:
    if out in keep:
        raise ValueError(f"the result's name {out} is taken by a kept column")
    shared, n = df.sparkSession.sparkContext.broadcast(model), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = getattr(codec(shared.value, pattern), how)
            made = pa.array([one(x.as_py()) for x in b.column(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], made], [*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())])
    return map_arrow(df.select(*keep, F.col(source).alias(f"_{out}")), run, schema)


def encode(df: DataFrame, model: bytes, *, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: str = "ids", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns ``keep`` and ``ids``: each text's ids, packed as little-endian unsigned 32-bit numbers."""
    return _add(df, model, pattern, text, keep, ids, "encode")


def decode(df: DataFrame, model: bytes, *, ids: str = "ids", keep: Sequence[str] = ("doc_id",), decoded: str = "decoded", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns ``keep`` and ``decoded``: the bytes behind packed ids."""
    return _add(df, model, pattern, ids, keep, decoded, "decode")


def q_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded, and its ids decoded."""
    model = serialise(read_ranks(public_tokenizers.path(VOCAB)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs, model), model, keep=("doc_id", "ids"))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
