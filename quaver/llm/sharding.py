"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A topology is a tree region -> rack -> shard whose leaves carry weights.  A key
descends level by level: at each node every child draws a hash of (key, child's
path) and the child with the least ``-ln(u) / weight`` wins, where a child's
weight is the sum of the leaves below it.  A child's draw depends on nothing but
the key, the child's path and its weight, so a changed weight moves keys only
into or out of the subtrees on that leaf's path; siblings elsewhere keep theirs.
``grown`` hangs each new shard under a region of its own, so that a key either
keeps its shard or goes to the new one.

Law: ``key`` (the key and the topology decide; not sizes, not row order).

Slots follow a hash of the row (key, size, text crc32), ties the values themselves.
Equal rows are counted before they are numbered and written out again from their
count, so neither ids far apart nor one row that holds a third of the table ends
up in one task.

Edge cases: a null key hashes as the empty string; a null text has size 1 and
crc32 0, an empty one the same; a very long text is only measured and hashed where
it lies; repeated rows share a shard and get neighbouring slots; an empty table
gives an empty result; only key and text are read, so other columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.llm.shared import materialise

#: Kinds of rows in one numbering block of all groups, blocks in one super-block, and equal rows written out by one task.
BLOCK, SUPER, COPIES = 4096, 1024, 10_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """``shards`` equal leaves spread over ``regions`` x ``racks``."""
    out = []
    for s in range(shards):
        cell = s * regions * racks // shards
        out.append(Leaf(f"r{cell // racks}", f"k{cell % racks}", s))
    return out


def grown(topology: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a new region: only keys that go into it move."""
    s = max(x.shard for x in topology) + 1
    return [*topology, Leaf(f"r+{s}", "k0", s, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u)/weight for u in (0, 1) from 53 bits of a hash of key and path."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the least draw; the first wins a tie."""
    if len(options) == 1:
        return options[0][2]
    return F.array_min(F.array(*[F.struct(_draw(key, p, w).alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (p, w, v) in enumerate(options)]))["v"]


def shard_of(key: Column, topology: Sequence[Leaf], names: tuple[str, str] = ("_region", "_rack")) -> list[tuple[str, Column]]:
    """Column steps (name, expression) that end in ``shard``; each level is a
    column of its own so that it is computed once a row."""
    regions = list(dict.fromkeys(x.region for x in topology))
    total = lambda keep: sum(x.weight for x in topology if keep(x))
    region = _pick(key, [(r, total(lambda x, r=r: x.region == r), F.lit(r)) for r in regions])
    steps = [(names[0], region)]
    rack = shard = None
    for r in regions:
        racks = list(dict.fromkeys(x.rack for x in topology if x.region == r))
        at = F.col(names[0]) == r
        pick = _pick(key, [(f"{r}/{k}", total(lambda x, r=r, k=k: (x.region, x.rack) == (r, k)), F.lit(f"{r}/{k}")) for k in racks])
        rack = F.when(at, pick) if rack is None else rack.when(at, pick)
        for k in racks:
            here = F.col(names[1]) == f"{r}/{k}"
            leaf = _pick(key, [(f"{r}/{k}/{x.shard}", x.weight, F.lit(x.shard)) for x in topology if (x.region, x.rack) == (r, k)])
            shard = F.when(here, leaf) if shard is None else shard.when(here, leaf)
    return [*steps, (names[1], rack), ("shard", shard)]


def assign(df: DataFrame, topology: Sequence[Leaf], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``df`` with the shard of every row; no shuffle, no state."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    names = (f"_{out}_region", f"_{out}_rack")
    for name, expr in shard_of(k, topology, names):
        df = df.withColumn(out if name == "shard" else name, expr)
    return df.drop(*names)


def number(df: DataFrame, group: str = "shard") -> DataFrame:
    """``df`` with ``slot``: each row's place in its group by a hash of the row, gapless from 0.

    Kinds of rows are numbered inside (group, block of hashes) by running sums of
    their counts, and two levels of block counts give the place where a block
    starts; the number of blocks follows the number of kinds.
    """
    cols = df.columns
    kinds = materialise(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_m")).withColumn("_h", F.xxhash64(*cols)), "kinds")
    total = kinds.count()
    bits = max(1, -(-total // BLOCK) - 1).bit_length()
    base = kinds.withColumn("_block", F.shiftrightunsigned("_h", 64 - bits)).withColumn("_super", F.floor(F.col("_block") / F.lit(SUPER)).cast("long"))
    counts = materialise(base.groupBy(group, "_super", "_block").agg(F.sum("_m").alias("_n")), "slots")
    tops = counts.groupBy(group, "_super").agg(F.sum("_n").alias("_n"))
    before = lambda part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(group, "_super", F.coalesce(F.sum("_n").over(before([group]).orderBy("_super")), F.lit(0)).alias("_from_super"))
    starts = counts.select(group, "_super", "_block", F.coalesce(F.sum("_n").over(before([group, "_super"]).orderBy("_block")), F.lit(0)).alias("_from_block"))
    starts = starts.join(tops, [group, "_super"]).select(group, "_block", (F.col("_from_block") + F.col("_from_super")).alias("_from"))
    inner = F.coalesce(F.sum("_m").over(before([group, "_block"]).orderBy("_h", *cols)), F.lit(0))
    placed = base.withColumn("_inner", inner).join(starts, [group, "_block"])
    placed = placed.select(*cols, "_m", (F.col("_from") + F.col("_inner")).alias("_from"))
    if not kinds.where(F.col("_m") > 1).limit(1).count():
        return placed.select(*cols, F.col("_from").alias("slot"))
    runs = placed.select(*cols, "_m", "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(COPIES).cast("long"))).alias("_at"))
    if kinds.where(F.col("_m") > COPIES).limit(1).count():  # runs of large groups go to tasks of their own
        runs = runs.where(F.col("_m") <= COPIES).union(runs.where(F.col("_m") > COPIES).repartition("_from", "_at"))
    each = F.sequence(F.col("_from") + F.col("_at"), F.col("_from") + F.least(F.col("_at") + COPIES, F.col("_m")) - 1)
    return runs.select(*cols, F.explode(each).alias("slot"))


def shard_documents(df: DataFrame, topology: Sequence[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, topology, key), grown(topology), key, "grown_shard")
    return number(rows, "shard")


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), balanced(16))
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
