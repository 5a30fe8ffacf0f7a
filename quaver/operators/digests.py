"""A canonical digest of an ordered set of records, as a tree of hashes over ranges of ids.

A record is the text of its columns in order of their names, without the dropped ones, each with its
length, so no two records have one text.  Its hash is a leaf.  Leaves go by id, equal ids by hash: a
node's hash is that of its children's, each with its place, in order.  Ids of a node differ in their
last bits only, so the tree hangs on nothing but the records: neither on rows' order nor on partitions.
A node has at most 2^BITS children, an id's own records are told apart by digits of their hashes first,
and equal records are one leaf with a count; so no task gets a whole group, whatever ids repeat.

Edge cases: null values differ from empty ones; null ids come first; ids may be negative; a group's
digest hangs on the group's records alone; an empty table has no digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an id that one level of the tree takes; digits of a record's hash that tell an id's records apart, level by level.
BITS, DIGITS = 10, (6, 3, 0)


def record_text(columns: Sequence[str]) -> Column:
    """``name=length:value`` of the columns in order of their names; ``name=-`` for a null."""
    one = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")))
    return F.concat_ws(";", *[one(c) for c in sorted(columns)])


def _node(rows: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """(keys, h): one hash of the rows' places and hashes in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("h").alias("h"))))
    text = F.transform(parts, lambda x: F.concat_ws(":", F.coalesce(x["p"].cast("string"), F.lit("-")), x["h"]))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(text, ","), 256).alias("h"))


def corpus_digest(records: DataFrame, id: str, groups: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """(groups, digest) of the records; ``id`` is a whole number, ``drop`` are columns that do not count."""
    own = [f"_g{i}" for i in range(len(groups))]
    leaf = records.select(*[F.col(g).alias(n) for g, n in zip(groups, own, strict=True)], F.col(id).cast("long").alias("id"), F.sha2(record_text([c for c in records.columns if c not in drop]), 256).alias("r"))
    rows = leaf.groupBy(*own, "id", "r").agg(F.count(F.lit(1)).alias("n")).select(*own, "id", F.col("r").alias("place"), F.col("n").cast("string").alias("h"))
    for digits in DIGITS:
        rows = rows.withColumn("up", F.substring("place", 1, digits)) if digits else rows.withColumn("up", F.lit(""))
        rows = _node(rows, [*own, "id", "up"], "place").withColumnRenamed("up", "place")
    rows = rows.select(*own, F.col("id").alias("place"), "h")
    for _ in range(-(-64 // BITS)):
        rows = _node(rows.withColumn("up", F.shiftright("place", BITS)), [*own, "up"], "place").withColumnRenamed("up", "place")
    return _node(rows, own, "place").select(*[F.col(n).alias(g) for g, n in zip(groups, own, strict=True)], F.col("h").alias("digest"))
