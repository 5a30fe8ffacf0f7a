"""Exports leave each row once, whatever fails on the way."""

import pytest
from pyspark.sql import functions as F

from quaver.streaming import export

SCHEMA = "name string, fingerprint string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def standing(spark, folder):
    return {r.target: r.fingerprint for r in export.current(export.exported(spark, folder, SCHEMA)).collect()}


def test_names_and_contents(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert standing(spark, folder) == {} and export.journal(spark, folder).count() == 0
    # repeated rows are one, null names none, several contents of a name stand beside each other
    assert export.publish(rows(spark, ("a", "1"), ("a", "1"), ("b", "2"), ("b", "3"), (None, "4"), ("c", None)), 0, folder)
    assert standing(spark, folder) == {"a": "1", "b": "2", "b (2)": "3"}
    assert export.publish(rows(spark, ("a", "1"), ("b", "9"), ("c", "7")), 1, folder)
    assert standing(spark, folder) == {"a": "1", "b": "2", "b (2)": "3", "b (3)": "9", "c": "7"}
    assert export.publish(rows(spark, ("a", "5"), ("d", "8")), 2, folder, "replace")
    assert export.publish(rows(spark, ("a", "6"), ("e", "8")), 3, folder, "ask")
    assert standing(spark, folder)["a"] == "5" and standing(spark, folder)["e"] == "8"
    asked = export.exported(spark, folder, SCHEMA).where("action = 'ask'").collect()
    assert [(r.name, r.fingerprint) for r in asked] == [("a", "6")]
    assert export.publish(rows(spark), 4, folder) and export.journal(spark, folder).count() == 5


def test_a_killed_try_is_never_read(spark, tmp_path):
    folder = str(tmp_path / "out")
    batch = rows(spark, ("a", "1"), ("b", "2"))
    export.write_try(batch, 0, folder, "keep_both", SCHEMA)
    assert standing(spark, folder) == {}
    assert export.publish(batch, 0, folder) and not export.publish(batch, 0, folder)
    assert standing(spark, folder) == {"a": "1", "b": "2"}
    assert export.exported(spark, folder, SCHEMA).count() == 2
    with pytest.raises(ValueError):
        export.publish(rows(spark, ("z", "1")), 0, folder)


def test_a_stream_that_dies_half_way(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 15).select(F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("f"), "id").alias("fingerprint")).coalesce(1).write.mode("append").parquet(source)

    def run(write):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    def dies(batch, n):
        if n == 1:
            export.write_try(batch, n, folder, "keep_both", SCHEMA)
            raise RuntimeError("killed after the rows, before the journal")
        export.exporter(folder)(batch, n)

    with pytest.raises(Exception, match="killed"):
        run(dies)
    assert export.journal(spark, folder).count() == 1
    run(export.exporter(folder))
    assert standing(spark, folder) == {f"n{i}": f"f{i}" for i in range(35)}
    done = export.exported(spark, folder, SCHEMA)
    assert done.where("action = 'add'").count() == 35 and done.where("action = 'skip'").count() == 10
