"""Exports that leave each row once, however often a batch is killed and run again.

Rows go to ``rows/batch=<n>/try=<token>``; a batch counts once its journal entry is there, which names
the try and the fingerprint of the batch's input and is written last, as one file job.  What a killed try
left behind is never read.  A batch that has its entry is not written again; one that comes with another
input is an error.  ``exporter`` is the function for ``foreachBatch``.

A row has a name and a fingerprint of its content.  The same content under its name is skipped; a name that
is taken is asked about (``ask``), replaced, or kept beside the new one under the first free number; several
contents of one name in a batch meet each other in the same way, in the order of their fingerprints.

Edge cases: null names or fingerprints are left out; repeated rows are one; an empty batch has an entry and no
rows; other columns are kept; before the first batch there is nothing to read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.sources.storage import export_plan

ENTRY = "batch long, attempt string, fingerprint string, n long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, attempt, fingerprint, n): the batches that count."""
    if not _exists(spark, f"{folder}/journal"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", True).json(f"{folder}/journal")


def exported(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every row of the batches that count, with batch, seq, action and target; ``schema``: of what was published."""
    if not _exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], f"{schema}, seq int, action string, target string, batch long")
    rows = spark.read.schema(f"{schema}, seq int, action string, target string, batch long, attempt string").parquet(f"{folder}/rows")
    return rows.join(F.broadcast(journal(spark, folder).select("batch", "attempt")), ["batch", "attempt"], "left_semi").drop("attempt")


def current(rows: DataFrame) -> DataFrame:
    """(target, fingerprint, batch): what stands under each name, of ``exported`` rows."""
    done = rows.where("action IN ('add', 'replace')")
    return done.groupBy("target").agg(F.max_by(F.struct("fingerprint", "batch"), F.struct("batch", "seq")).alias("_r")).select("target", "_r.*")


def fingerprint(rows: DataFrame) -> str:
    """Of a batch's input, whatever its order."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(rows.columns)]).cast("decimal(38,0)")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def write_try(rows: DataFrame, batch: int, folder: str, mode: str, schema: str) -> str:
    """Writes a batch's rows and gives the name of the try; nothing counts yet."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    new = rows.where("name IS NOT NULL AND fingerprint IS NOT NULL").dropDuplicates(["name", "fingerprint"])
    there = current(exported(spark, folder, schema)).select(F.col("target").alias("name"), "fingerprint")
    plan = export_plan(new.select("name", "fingerprint"), there, mode)
    out = new.join(plan, ["name", "fingerprint"]).select(*rows.columns, "seq", "action", "target")
    out.write.parquet(f"{folder}/rows/batch={batch}/attempt={attempt}")
    return attempt


def publish(rows: DataFrame, batch: int, folder: str, mode: str = "keep_both") -> bool:
    """Whether the batch was written now; False if it counts already."""
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    mark = fingerprint(rows)
    before = journal(spark, folder).where(F.col("batch") == batch).first()
    if before:
        if before.fingerprint != mark:
            raise ValueError(f"batch {batch} was published with another input")
        return False
    attempt = write_try(rows, batch, folder, mode, schema)
    n = spark.read.parquet(f"{folder}/rows/batch={batch}/attempt={attempt}").count()
    spark.createDataFrame([(batch, attempt, mark, n)], ENTRY).coalesce(1).write.json(f"{folder}/journal/batch={batch}")
    return True


def exporter(folder: str, mode: str = "keep_both") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: a batch that is given again after a failure leaves its rows once."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()  # the fingerprint and the rows come from one reading
        try:
            publish(rows, batch, folder, mode)
        finally:
            rows.unpersist()

    return write
