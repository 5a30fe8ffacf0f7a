"""Shared storage, lineage cuts and small helpers for the corpus operators.

Nothing here writes to a machine-local folder on a cluster: every intermediate
table or model file goes under ``spark.checkpoint.dir``.  Only where that
setting is absent and Spark runs in one process (tests, a laptop) is a temporary
folder made and set; a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: ASCII white space only.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Most bytes of an Arrow batch (Spark's own: 64 MB), which the executor and its
#: Python worker both hold for every task.  A longer row is a batch of its own.
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quaver-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quaver-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) in the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quaver_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._quaver_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the session's batches held to ``BATCH``; lower settings stay."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH:
        conf.set(name, str(BATCH))
    return df.mapInArrow(function, schema)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes behind ``df``: the planner's file sizes, or the texts' lengths where it knows none."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 55 else int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def broadcast_if_small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hint a broadcast only where the counted rows stay under ``bound``."""
    return F.broadcast(df) if rows <= bound else df


def crc32_text(col: Column | str) -> Column:
    """crc32 of a value's decimal text, as unsigned long (null stays null)."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))
