"""Files: documents, lines, key and value texts, column archives, listings; writes that leave either all or nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; on one machine without that setting, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quaver-")
    return f"{base.rstrip('/')}/quaver-{name}-{uuid.uuid4().hex}"


def refuse_nan(df: DataFrame) -> DataFrame:
    """The same rows; a NaN or an infinite number stops the job."""

    def checked(f) -> Column:
        c = F.col(f.name)
        if not isinstance(f.dataType, (DoubleType, FloatType)):
            return c
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(odd, F.raise_error(F.lit(f"{f.name} is not a number")).cast(f.dataType)).otherwise(c).alias(f.name)

    return df.select(*[checked(f) for f in df.schema.fields])


def write_json(df: DataFrame, folder: str) -> None:
    """JSON Lines in place of what ``folder`` holds; the commit of the job makes them visible all at once."""
    refuse_nan(df).write.mode("overwrite").json(folder)


def read_lines(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """JSON Lines, of a known schema; a line that does not fit stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)


def read_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Whole JSON documents, one a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(folder)


def read_keyed_text(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value): the first two words of every line but each file's first; shorter lines are left out."""
    # a file is one row: its first line is known without an order of rows
    lines = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where("n > 0")
    parts = lines.select(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0)).alias("p")).where(F.size("p") >= 2)
    return parts.select(F.col("p")[0].alias("key"), F.col("p")[1].alias("value"))


def write_tracks(df: DataFrame, folder: str) -> None:
    """Recordings as compressed columns, one array each."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_tracks(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(key, frame, one column an array) of recordings whose arrays have one length; other recordings are left out."""
    df = spark.read.parquet(folder)
    names = [c for c in df.columns if c != key]
    same = F.lit(True)
    for c in names[1:]:
        same = same & (F.size(c) == F.size(names[0]))
    return df.where(same).select(key, F.posexplode(F.arrays_zip(*names)).alias("frame", "z")).select(key, "frame", *[F.col(f"z.{c}").alias(c) for c in names])


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of every file below ``folder``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))


def log_tail(text: Column, prefix: Column, size: int = 2048) -> Column:
    """The newest line with a prefix (a pattern at a line's start) within the last ``size`` bytes, or null."""
    raw = F.encode(text, "utf-8")
    tail = F.when(F.octet_length(text) <= size, raw).otherwise(F.substring(raw, -size, size))
    cut = F.length(F.regexp_extract(F.hex(F.substring(tail, 1, 3)), "^((?:[89AB][0-9A-F])*)", 1)) / 2  # the rest of a character cut in two
    kept = F.decode(F.substring(tail, cut.cast("int") + 1, F.lit(size)), "utf-8")
    found = F.filter(F.split(kept, "\n"), lambda x: F.regexp_like(x, F.concat(F.lit("^(?:"), prefix, F.lit(")"))))
    return F.try_element_at(found, F.lit(-1))


def export_plan(new: DataFrame, there: DataFrame, mode: str) -> DataFrame:
    """(name, fingerprint, seq, action, target) of every new (name, fingerprint) against what is there: the same content is not
    written again; a name that is taken is asked about, replaced, or given the first free number.  Several contents of one
    name come one after the other, by fingerprint (``seq``)."""
    assert mode in ("ask", "replace", "keep_both")
    base = F.regexp_replace("name", r" \((\d+)\)$", "")
    number = F.regexp_extract("name", r" \((\d+)\)$", 1).try_cast("int")
    taken = there.withColumn("base", base).groupBy("base").agg(F.collect_set(number).alias("numbers"))
    same = there.select("name", "fingerprint").distinct().withColumn("same", F.lit(True))
    names = there.select("name").distinct().withColumn("taken", F.lit(True))
    j = new.join(same, ["name", "fingerprint"], "left").join(names, "name", "left").join(taken, new["name"] == taken["base"], "left")
    place = F.row_number().over(Window.partitionBy("name", F.col("same").isNull()).orderBy("fingerprint")) - 1
    j = j.withColumn("seq", F.when(F.col("same"), 0).otherwise(place))
    met = F.coalesce("taken", F.lit(False)) | (F.col("seq") > 0)
    rank = F.col("seq") - F.when(F.col("taken"), 0).otherwise(1)
    used = F.coalesce("numbers", F.array().cast("array<int>"))
    free = F.get(F.array_except(F.sequence(F.lit(2), F.size(used) + 2 + F.col("seq")), used), rank)
    other = {"ask": ("ask", F.lit(None).cast("string")), "replace": ("replace", F.col("name")), "keep_both": ("add", F.concat("name", F.lit(" ("), free.cast("string"), F.lit(")")))}[mode]
    action = F.when(F.col("same"), "skip").when(met, other[0]).otherwise("add")
    target = F.when(F.col("same"), F.col("name")).when(met, other[1]).otherwise(F.col("name"))
    return j.select("name", "fingerprint", "seq", action.alias("action"), target.alias("target"))


def window(signal: Column, rate: int, start: Column, stop: Column, channels: int = 1) -> Column:
    """Samples of [start, stop) seconds of an interleaved signal, the channels' mean; a span outside of it is empty."""
    n = F.floor(F.size(signal) / channels)
    first, last = F.greatest(F.lit(0), F.bround(start * rate)).cast("int"), F.least(n, F.bround(stop * rate)).cast("int")
    mean = lambda i: F.aggregate(F.slice(signal, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels
    return F.when(last > first, F.transform(F.sequence(first, F.greatest(first, last - 1)), mean)).otherwise(F.array().cast("array<double>"))
