"""Readers and writers over files that the queries make from the supplied tables, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.plans.base import query
from quaver.sources import delimited, lyrics
from quaver.sources import storage as S


@query(r"""
WITH f AS (SELECT *, s_nationkey + 25 * (s_suppkey // 1250) AS file FROM supplier),
s AS (SELECT file, s_suppkey, row_number() OVER (PARTITION BY file ORDER BY s_suppkey) * 2 AS row, s_name, s_nationkey % 5 = 1 AND s_suppkey % 3 = 0 AS no_link, s_nationkey % 5 = 2 AND s_suppkey % 2 = 0 AS no_language FROM f),
b AS (SELECT file, min(row) AS bad_row, arg_min(CASE WHEN row = 102 THEN 'too many rows' WHEN no_link THEN 'link' ELSE 'language' END, row) AS problem FROM s WHERE no_link OR no_language OR row = 102 GROUP BY 1)
SELECT file, row::int AS row, 'https://www.youtube.com/watch?v=' || lpad(s_suppkey::varchar, 11, '0') AS url, s_name || ', "the" one' AS artist, 'Song ' || s_suppkey AS song_name, CASE WHEN s_suppkey % 2 = 0 THEN 'en' ELSE '' END AS language, NULL::int AS bad_row, NULL::varchar AS problem FROM s WHERE file NOT IN (SELECT file FROM b)
UNION ALL SELECT file, bad_row::int, NULL, NULL, NULL, NULL, bad_row::int, problem FROM b
""")
def csv_ingest(t):
    """Files by nation, a song for each supplier: quoted commas and quotes, blank rows, CRLF, a BOM; some links and languages are
    wrong, and a file of more than fifty songs is refused at its fifty-first."""
    k = F.col("s_suppkey")
    id_ = F.lpad(k.cast("string"), 11, "0")
    link = F.when((F.col("s_nationkey") % 5 == 1) & (k % 3 == 0), "http://youtu.be/x").otherwise(F.concat(F.lit(" https://youtu.be/"), id_))
    language = F.when((F.col("s_nationkey") % 5 == 2) & (k % 2 == 0), "Klingon").when(k % 2 == 0, " EN ").otherwise("")
    line = F.concat(link, F.lit(',"'), "s_name", F.lit(', ""the"" one",Song '), k.cast("string"), F.lit(","), language, F.lit("\r\n\r\n"))
    rows = t.supplier.groupBy((F.col("s_nationkey") + 25 * F.floor(k / 1250)).alias("file")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("x"))
    text = F.concat(F.lit("﻿URL, Artist ,song_name,Language_Code\r\n"), F.array_join(F.transform("x", lambda v: v["line"]), ""))
    return delimited.ingest(rows.select("file", text.alias("content")))


@query("""
WITH w AS (SELECT conv_id, turn, greatest(0, turn * 7.25 - 0.5) AS start, 'said ' || role AS text FROM conversations), d AS (SELECT conv_id, start, string_agg(text, chr(10) ORDER BY turn) AS text FROM w GROUP BY ALL)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY start) - 1)::int AS line, start::double AS start, text FROM d
""")
def lrc_parse(t):
    """A lyric for each conversation, a stamp for each turn, half a second early by its offset tag (an earlier tag does not count)."""
    at = F.col("turn") * 7.25
    stamp = F.concat(F.lit("["), F.floor(at / 60).cast("string"), F.lit(":"), F.format_string("%05.2f", (at - F.floor(at / 60) * 60).cast("double")), F.lit("]"), F.lit(" said "), "role")
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", stamp.alias("s")))).alias("x"))
    text = F.concat(F.lit("[ar:Someone]\r\n[offset:900]\n[offset: -500]\n"), F.array_join(F.transform("x", lambda v: v["s"]), "\n"))
    return lyrics.parse(c.select("conv_id", text.alias("text")), "conv_id").select("conv_id", F.col("line").cast("int").alias("line"), "start", "text")


@query("SELECT n_name AS name, n_nationkey AS n, n_regionkey + 0.5::double AS half FROM nation")
def json_lines(t):
    folder = S.scratch(t.spark, "lines")
    S.write_json(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"), (F.col("n_regionkey") + F.lit(0.5)).alias("half")), folder)
    return S.read_lines(t.spark, folder, "name string, n int, half double")


@query("SELECT r_name AS region, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def json_documents(t):
    """A document for each region with its nations inside, written over several lines."""
    folder = S.scratch(t.spark, "documents")
    inner = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    g = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(inner.alias("nations"))
    text = F.replace(F.to_json(F.struct(F.col("r_name").alias("region"), "nations")), F.lit(","), F.lit(",\n  "))
    g.select("r_name", text.alias("value")).repartition("r_name").write.partitionBy("r_name").text(folder)
    d = t.spark.read.schema("region string, nations array<struct<n_nationkey:int,n_name:string>>").option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return d.select("region", F.size("nations").cast("long").alias("n"), F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT 'k' || c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 7 > 0")
def keyed_text(t):
    """A text for each nation: a heading, then key, value and a rest; lines of one word do not count."""
    folder = S.scratch(t.spark, "keyed")
    line = F.when(F.col("c_custkey") % 7 == 0, "alone").otherwise(F.concat(F.lit("  k"), F.col("c_custkey").cast("string"), F.lit("\t "), "c_mktsegment", F.lit(" and more")))
    g = t.customer.groupBy("c_nationkey").agg(F.array_join(F.collect_list(line), "\n").alias("x"))
    g.select("c_nationkey", F.concat(F.lit("key value heading\n"), "x").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    return S.read_keyed_text(t.spark, folder)


@query("SELECT vec_id, i::int AS frame, i * 0.01::double AS time, embedding[i + 1]::double AS hz FROM (SELECT *, unnest(range(0, len(embedding))) i FROM embeddings) WHERE vec_id % 10 > 0")
def track_archive(t):
    """Recordings written as arrays and read as frames; those whose arrays differ in length are left out."""
    folder = S.scratch(t.spark, "tracks")
    hz = F.transform("embedding", lambda x: x.cast("double"))
    time = F.transform(F.sequence(F.lit(0), F.size("embedding") - F.when(F.col("vec_id") % 10 == 0, 2).otherwise(1)), lambda i: i * F.lit(0.01))
    S.write_tracks(t.embeddings.select("vec_id", time.alias("time"), hz.alias("hz")), folder)
    return S.read_tracks(t.spark, folder, "vec_id")


@query("SELECT c_nationkey, sum(strlen(c_name || c_mktsegment) + 1)::bigint AS size FROM customer GROUP BY 1")
def cleanup_size(t):
    """Bytes of the files below each nation's folder."""
    folder = S.scratch(t.spark, "sizes")
    t.customer.select("c_nationkey", F.concat("c_name", "c_mktsegment").alias("value")).write.partitionBy("c_nationkey").text(folder)
    f = S.file_sizes(t.spark, folder).where(F.col("path").rlike(r"/part-[^/]*$"))
    return f.groupBy(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey")).agg(F.sum("size").alias("size"))


@query(r"""
WITH d AS (SELECT doc_id, text, list_max(list_filter(range(0, 2049), lambda k: strlen(right(text, k)) <= 2048)) AS k FROM documents)
SELECT doc_id, list_filter(string_split(right(text, k), chr(10)), lambda x: regexp_matches(x, '^[A-M]'))[-1] AS line FROM d
""")
def log_tail(t):
    return t.documents.select("doc_id", S.log_tail(F.col("text"), F.lit("[A-M]")).alias("line"))


@query("""
WITH n AS (SELECT c_name AS name, md5(c_mktsegment) AS f, c_custkey % 3 AS mode FROM customer), t AS (SELECT c_name AS name, md5(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'x' END) AS f FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_name || ' (2)', 'y' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_name || ' (3)', 'z' FROM customer WHERE c_custkey % 10 = 0),
j AS (SELECT name, mode, EXISTS (SELECT 1 FROM t WHERE t.name = n.name AND t.f = n.f) AS same, EXISTS (SELECT 1 FROM t WHERE t.name = n.name) AS taken, EXISTS (SELECT 1 FROM t WHERE t.name = n.name || ' (2)') AS two, EXISTS (SELECT 1 FROM t WHERE t.name = n.name || ' (3)') AS three FROM n)
SELECT name, CASE WHEN same THEN 'skip' WHEN taken THEN ['ask', 'replace', 'add'][mode + 1] ELSE 'add' END AS action, CASE WHEN same OR NOT taken OR mode = 1 THEN name WHEN mode = 2 THEN name || CASE WHEN NOT two THEN ' (2)' WHEN NOT three THEN ' (3)' ELSE ' (4)' END END AS target FROM j
""")
def export_plan(t):
    """Customers to write, against files that are there, under each of the three ways to meet a name that is taken."""
    c = t.customer
    k = F.col("c_custkey")
    there = c.where(k % 2 == 0).select(F.col("c_name").alias("name"), F.md5(F.when(k % 4 == 0, F.col("c_mktsegment")).otherwise("x").cast("binary")).alias("fingerprint"))
    there = there.union(c.where(k % 5 == 0).select(F.concat("c_name", F.lit(" (2)")), F.lit("y"))).union(c.where(k % 10 == 0).select(F.concat("c_name", F.lit(" (3)")), F.lit("z")))
    new = lambda m: c.where(k % 3 == m).select(F.col("c_name").alias("name"), F.md5(F.col("c_mktsegment").cast("binary")).alias("fingerprint"))
    plans = [S.export_plan(new(i), there, mode) for i, mode in enumerate(("ask", "replace", "keep_both"))]
    return plans[0].union(plans[1]).union(plans[2]).select("name", "action", "target")


@query("SELECT l_linenumber % 3 AS batch, count(*) AS n, sum(l_partkey)::bigint AS parts FROM lineitem GROUP BY 1")
def appended_results(t):
    """Results written batch by batch, each appended instead of writing all of them anew, and read as one."""
    folder = S.scratch(t.spark, "batches")
    for i in range(3):
        t.lineitem.where(F.col("l_linenumber") % 3 == i).select((F.col("l_linenumber") % 3).alias("batch"), "l_partkey").write.mode("append").parquet(folder)
    return t.spark.read.schema("batch int, l_partkey long").parquet(folder).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


#: What is pinned, in order; the first that serves a purpose is taken.
MANIFEST = [("large", "r1", "transcribe"), ("small", "r2", "align"), ("base", "r7", "transcribe"), ("tone", "r4", "pitch")]


@query(f"""
WITH m(name, revision, purpose, i) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}', {i})" for i, (a, b, c) in enumerate(MANIFEST))}), f AS (SELECT purpose, arg_min(name, i) AS name, arg_min(revision, i) AS revision FROM m GROUP BY 1)
SELECT event_id, purpose, name, revision FROM (SELECT event_id, ['transcribe', 'align', 'pitch', 'other'][event_id % 4 + 1] AS purpose FROM events) LEFT JOIN f USING (purpose)
""")
def pinned_models(t):
    """What serves each event's purpose by the pinned list, null where nothing does."""
    from quaver.operators.compare import first_match

    purpose = F.get(F.array(*[F.lit(x) for x in ("transcribe", "align", "pitch", "other")]), (F.col("event_id") % 4).cast("int"))
    pinned = t.spark.createDataFrame([(*m, i) for i, m in enumerate(MANIFEST)], "name string, revision string, purpose string, i int")
    j = first_match(t.events.select("event_id", purpose.alias("purpose")), F.broadcast(pinned), ["purpose"], ["i"])
    return j.select("event_id", "purpose", "match.name", "match.revision")


@query("""
WITH s AS (SELECT n_nationkey, i::int AS i, i / 100.0 AS t, 440 * pow(2, (60 + n_nationkey - 69) / 12.0) AS hz FROM nation, range(0, 150) r(i))
SELECT n_nationkey, i, round(0.15 * least(1, t / 0.08) * least(1, (1.5 - t) / 0.08) * (sin(2 * pi() * hz * t) + sin(4 * pi() * hz * t) / 2 + sin(6 * pi() * hz * t) / 3 + sin(8 * pi() * hz * t) / 4 + sin(10 * pi() * hz * t) / 5 + sin(12 * pi() * hz * t) / 6), 6) AS x FROM s
""")
def harmonic_tones(t):
    """A tone of six partials with soft edges for each nation."""
    from quaver.functions.signals import tone

    hz = 440 * F.pow(F.lit(2.0), (60 + F.col("n_nationkey") - 69) / F.lit(12.0))
    s = t.nation.select("n_nationkey", F.posexplode(tone(hz, F.lit(1.5), 100)).alias("i", "x"))
    return s.select("n_nationkey", "i", F.round("x", 6).alias("x"))


@query("""
SELECT vec_id, len(x) AS n, round(coalesce(list_sum(x), 0), 6) AS total FROM (SELECT vec_id, list_transform(range(least(32, (vec_id % 5) * 8), least(32, (vec_id % 5) * 8 + 12)), lambda i: (embedding[i * 2 + 1]::double + embedding[i * 2 + 2]::double) / 2) AS x FROM embeddings)
""")
def signal_window(t):
    """Twelve samples of a two-channel signal at 16 samples a second, from a start that may lie past its end."""
    start = (F.col("vec_id") % 5) * 0.5
    x = S.window(F.col("embedding"), 16, start, start + 0.75, 2)
    return t.embeddings.select("vec_id", F.size(x).cast("long").alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders)")
def job_by_id(t):
    """One row by its key; the predicate reaches the scan."""
    key = t.orders.agg(F.max("o_orderkey")).first()[0]
    return t.orders.where(F.col("o_orderkey").eqNullSafe(F.lit(key).cast("long"))).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


@query("""
SELECT c_nationkey, coalesce(max(c_mktsegment) FILTER (c_custkey % 3 = 0), 'none') AS folder, coalesce(max(c_name) FILTER (c_custkey % 3 = 1), 'en') AS language, count(DISTINCT c_custkey % 3) AS known FROM customer GROUP BY 1
""")
def settings_pivot(t):
    """Key and value rows as one row of settings, with defaults."""
    from quaver.operators.history import settings

    k = F.col("c_custkey") % 3
    rows = t.customer.select("c_nationkey", F.when(k == 0, "folder").when(k == 1, "language").otherwise("other").alias("key"), F.when(k == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("value"))
    return settings(rows, "c_nationkey", {"folder": "none", "language": "en"})


@query("""
SELECT o_orderkey, o_orderstatus AS status, w AS wanted, CASE WHEN (o_orderstatus = 'O' AND w IN ('run', 'cancel')) OR (o_orderstatus = 'P' AND w IN ('finish', 'fail', 'cancel')) OR (o_orderstatus = 'F' AND w = 'retry') THEN ['P', 'X', 'F', 'E', 'O'][list_position(['run', 'cancel', 'finish', 'fail', 'retry'], w)] ELSE o_orderstatus END AS now,
  (o_orderstatus = 'O' AND w IN ('run', 'cancel')) OR (o_orderstatus = 'P' AND w IN ('finish', 'fail', 'cancel')) OR (o_orderstatus = 'F' AND w = 'retry') AS done FROM (SELECT *, ['run', 'cancel', 'finish', 'fail', 'retry'][o_orderkey % 5 + 1] AS w FROM orders)
""")
def transitions(t):
    """A wished-for change of every order: done where its status allows it, else left as it is, row by row."""
    from quaver.operators.history import transition

    wanted = F.get(F.array(*[F.lit(x) for x in ("run", "cancel", "finish", "fail", "retry")]), (F.col("o_orderkey") % 5).cast("int"))
    rules = {("O", "run"): "P", ("O", "cancel"): "X", ("P", "finish"): "F", ("P", "fail"): "E", ("P", "cancel"): "X", ("F", "retry"): "O"}
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), wanted.alias("wanted"))
    return transition(rows, "status", "wanted", rules)
