"""Chat formatting with typed content parts.

A turn's content is a list of typed parts (text, image, audio, document).  A
visitor writes them in order: text with the template's control marks escaped,
every other part as a placeholder, noting the attachment's reference and how
many tokens it expands to.  A turn is

    <turn ROLE>\\n BODY </turn>\\n

In roles and texts ``\\``, ``<`` and ``>`` get a backslash before them, so no text
can form a mark and unescaping gives the text back exactly.  The loss mask spans
the text parts of assistant turns and nothing else.

A conversation is its turns' segments in order.  Segments keep their place
(``seq``, ``offset``), so a conversation of any length is written and read back
as a stream; no task holds a whole one.

Edge cases: null texts, roles and contents are empty; a very long text is one
segment, read and hashed as a whole; turns with equal numbers follow by role, then
by a hash of the content; a null conversation id is a conversation of its own;
repeated rows are turns of their own; columns that are not named above are not
read, whatever their names; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm import bytebpe
from quaver.llm.shared import map_arrow, materialise

#: An image patch's side, tokens of a second of audio, of a page.
PATCH, AUDIO_RATE, PAGE = 14, 25, 300
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = "conv_id long, seq long, offset long, formatted string, loss array<struct<start:int,stop:int>>, attachments array<struct<mark:int,type:string,ref:string,tokens:long>>, tokens long"
LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
ATTACHED = pa.list_(pa.struct([("mark", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.|<(?:image|audio|document) \d+>)*)</turn>\n", re.S)
_MARK = re.compile(r"((?:[^\\<>]|\\.)+)|<(image|audio|document) (\d+)>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits parts in order and keeps what the output needs."""

    role: str
    count: Callable[[str], int]
    out: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def write(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit(self, part: dict) -> None:
        visitor = getattr(self, "visit_" + (part.get("type") or "text"), None)
        if visitor is None:
            raise ValueError(f"unknown part type {part['type']!r}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        start = self.size
        self.write(escape(text))
        self.tokens += self.count(text)
        if self.role == "assistant" and self.size > start:
            self.loss.append({"start": start, "stop": self.size})

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        mark = len(self.attachments)
        self.write(f"<{kind} {mark}>")
        self.attachments.append({"mark": mark, "type": kind, "ref": part.get("ref") or "", "tokens": tokens})
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE)


def words(text: str) -> int:
    return len(text.split())


def format_turn(role: str | None, parts: list[dict], count: Callable[[str], int] = words) -> Flattener:
    """``count`` gives the tokens of a text."""
    v = Flattener(role or "", count)
    v.write(f"<turn {escape(role or '')}>\n")
    for p in parts:
        v.visit(p)
    v.write("</turn>\n")
    return v


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """(role, parts) of a formatted turn: ("text", text) or (type, mark number)."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    parts = [("text", unescape(x[1])) if x[1] is not None else (x[2], x[3]) for x in _MARK.finditer(m[2])]
    return unescape(m[1]), parts


def _format(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer = bytebpe.codec(model.value, public_tokenizers.PATTERN)
    count = lambda text: len(tokenizer.encode(text)) // 4
    conv, seq, offset, begun = None, 0, 0, False
    for b in batches:
        rows: dict[str, list] = {c: [] for c in ("conv_id", "seq", "offset", "formatted", "loss", "attachments", "tokens")}
        for c, role, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not begun or c != conv:
                conv, seq, offset, begun = c, 0, 0, True
            v = format_turn(role, parts or [], count)
            for k, x in zip(rows, (c, seq, offset, "".join(v.out), v.loss, v.attachments, v.tokens), strict=True):
                rows[k].append(x)
            seq, offset = seq + 1, offset + v.size
        types = {"conv_id": pa.int64(), "seq": pa.int64(), "offset": pa.int64(), "formatted": pa.string(), "loss": LOSS, "attachments": ATTACHED, "tokens": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(rows[k], types[k]) for k in rows], list(rows))


def format_conversations(turns: DataFrame, vocab: str | None = None) -> DataFrame:
    """Segments (SEGMENT) of all conversations, each conversation's in order within one partition.

    ``turns``: conv_id, turn, role and either ``parts`` (array of PART) or ``text``.  Texts count
    the tokens of the byte-level BPE vocabulary in ``vocab`` (the public one unless given).
    """
    ranks = bytebpe.read_ranks(vocab or public_tokenizers.path(bytebpe.VOCAB))
    model = turns.sparkSession.sparkContext.broadcast(bytebpe.serialise(ranks))
    if "parts" in turns.columns:
        parts = F.col("parts").cast(f"array<{PART}>")
    else:
        none = lambda t: F.lit(None).cast(t)
        parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("parts"))
    return map_arrow(rows.select("conv_id", "role", "parts"), partial(_format, model), SEGMENT)


DIGEST_ROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("tokens", pa.int64())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, tokens long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict | None = None
    done: list[dict] = []

    def close() -> None:
        if state is not None:
            done.append({k: (x.hexdigest() if k.endswith("sha256") else x) for k, x in state.items()})

    for b in batches:
        for c, seq, text, loss, tokens in zip(b.column("conv_id").to_pylist(), b.column("seq").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            if seq == 0:
                close()
                state = {"conv_id": c, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "tokens": 0}
            assert state is not None and state["n_turns"] == seq
            role, parts = read_turn(text)
            state["turns_sha256"].update((role + "\n" + "".join(x for kind, x in parts if kind == "text") + "\n").encode())
            for span in loss:
                said = unescape(text[span["start"] : span["stop"]])
                state["loss_sha256"].update(said.encode())
                state["loss_chars"] += len(said)
            state["n_turns"] += 1
            state["formatted_chars"] += len(text)
            state["tokens"] += tokens
        if done:
            yield pa.RecordBatch.from_pylist(done, DIGEST_ROW)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, DIGEST_ROW)


def read_back(segments: DataFrame) -> DataFrame:
    """Figures of every conversation (DIGEST), from its segments in whatever order and files they lie."""
    return map_arrow(segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq"), _digest, DIGEST)


#: The conversation that the contract adds.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def q_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    segments = format_conversations(turns.union(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")))
    return read_back(materialise(segments, "segments"))
