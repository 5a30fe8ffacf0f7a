"""Evaluation, median and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions.text import units
from quaver.operators import evaluation as E
from quaver.operators.sequences import long_edit_distance, token_errors
from quaver.plans.base import micros, query

TOKENS = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


@query("SELECT l_returnflag, round(median(l_extendedprice), 6) AS med, count(*) AS n FROM lineitem GROUP BY 1")
def median_by_group(t):
    return E.medians(t.lineitem, ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("median", 6).alias("med"), "n")


@query("""
SELECT user_id, round(median(value) FILTER (event_type = 'click'), 6) AS click, round(median(value) FILTER (event_type = 'view'), 6) AS view,
       round(median(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY user_id
""")
def stage_pivot_median(t):
    stages = ("click", "view", "purchase")
    m = E.medians(t.events.where(F.col("event_type").isin(*stages)), ["user_id", "event_type"], "value")
    p = m.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == c, F.round("median", 6))).alias(c) for c in stages])
    return t.events.select("user_id").distinct().join(p, "user_id", "left")


@query("""
WITH m AS (SELECT l_shipmode_, l_linestatus, median(l_extendedprice) s, median(l_quantity) f FROM (SELECT *, l_returnflag l_shipmode_ FROM lineitem) GROUP BY 1, 2)
SELECT l_shipmode_ AS l_returnflag, CASE WHEN count(*) = 2 THEN round(sum(s) / nullif(sum(f), 0), 6) END AS ratio, count(*) AS n_parts FROM m GROUP BY 1
""")
def ratio_of_sums(t):
    return E.complete_ratio(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", 2)


@query("""
SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING count(*) >= 2
""")
def upper_median(t):
    return E.upper_median(t.events, "user_id", "value")


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(ceil(95 * count(*) / 100) AS BIGINT)] AS p95, count(*) AS n FROM lineitem GROUP BY 1")
def p95_disc(t):
    return E.p95_disc(t.lineitem, "l_returnflag", "l_extendedprice")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS med, max(value) AS largest FROM events GROUP BY 1")
def interpolated_p95(t):
    q = E.interpolated(t.events, ["event_type"], "value", [0.95, 0.5])
    return q.select("event_type", F.round(F.col("q")[0], 6).alias("p95"), F.round(F.col("q")[1], 6).alias("med"), "largest")


@query("""
WITH g AS (SELECT lang, sum(toxic) e, count(*) u FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT round(avg(e / greatest(1, u)), 6) AS macro_rate, count(*) AS n_groups FROM g
""")
def macro_error_rate(t):
    j = t.labels.select("doc_id", "toxic").join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("one", F.lit(1))
    return E.macro(E.rates(j, "lang", "toxic", "one"))


@query("""
WITH j AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END side, lang, toxic, quality, doc_id FROM labels JOIN documents USING (doc_id)),
g AS (SELECT side, lang, sum(toxic) / greatest(1, count(*)) r, sum(1 - quality) / greatest(1, count(*)) q, count(*) n FROM j GROUP BY ALL),
s AS (SELECT avg(r) FILTER (side = 'a') ra, avg(r) FILTER (side = 'b') rb, avg(q) FILTER (side = 'a') qa, avg(q) FILTER (side = 'b') qb,
      count(*) FILTER (side = 'a') na, count(*) FILTER (side = 'b') nb FROM g),
d AS (SELECT count(*) c, count(DISTINCT doc_id) k FROM labels)
SELECT round(1 - rb / nullif(ra, 0), 6) AS improvement, concat_ws(';', CASE WHEN na <> nb THEN 'languages' END, CASE WHEN c <> k THEN 'duplicates' END,
  CASE WHEN NOT coalesce(1 - rb / nullif(ra, 0) >= 0.1, false) THEN 'improvement' END, CASE WHEN NOT coalesce(qb <= qa, false) THEN 'quality' END) AS reasons,
  concat_ws(';', CASE WHEN na <> nb THEN 'languages' END, CASE WHEN c <> k THEN 'duplicates' END,
  CASE WHEN NOT coalesce(1 - rb / nullif(ra, 0) >= 0.1, false) THEN 'improvement' END, CASE WHEN NOT coalesce(qb <= qa, false) THEN 'quality' END) = '' AS passed FROM s, d
""")
def promotion_gate(t):
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("side", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    g = j.groupBy("side", "lang").agg((F.sum("toxic") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("r"), (F.sum(1 - F.col("quality")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("q"))
    of = lambda c, s: F.avg(F.when(F.col("side") == s, F.col(c)))
    n = lambda s: F.count_if(F.col("side") == s)
    unique = t.labels.agg((F.count("doc_id") == F.count_distinct("doc_id")).alias("u")).first()[0]
    s = g.agg(of("r", "a").alias("ra"), of("r", "b").alias("rb"), of("q", "a").alias("qa"), of("q", "b").alias("qb"), n("a").alias("na"), n("b").alias("nb"))
    s = s.withColumn("improvement", 1 - F.try_divide("rb", "ra"))
    rules = [("languages", F.col("na") == F.col("nb")), ("duplicates", F.lit(unique)), ("improvement", F.col("improvement") >= 0.1), ("quality", F.col("qb") <= F.col("qa"))]
    return E.gate(s, rules).select(F.round("improvement", 6).alias("improvement"), "reasons", "passed")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) n, min((ts, event_id)) f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) r FROM c) WHERE r = 1
""")
def mode_first_seen(t):
    # the order is by (ts, event_id): one number keeps it
    e = t.events.withColumn("seen", micros("ts").cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("event_id"))
    return E.mode_first_seen(e, "user_id", "event_type", F.col("seen"))


@query("""
WITH c AS (SELECT user_id, event_type, round(sum(value), 4) w, min(event_id) f FROM events GROUP BY ALL)
SELECT user_id, event_type, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, f) r FROM c) WHERE r = 1
""")
def weighted_vote(t):
    return E.weighted_vote(t.events, "user_id", "event_type", "value", F.col("event_id"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_quantity DESC, l_discount DESC, l_linenumber, l_partkey DESC) r FROM lineitem) WHERE r = 1
""")
def argmax_composite(t):
    best = F.max_by(F.struct("l_linenumber", "l_partkey"), F.struct("l_returnflag", "l_quantity", "l_discount", -F.col("l_linenumber"), "l_partkey")).alias("b")
    return t.lineitem.groupBy("l_orderkey").agg(best).select("l_orderkey", "b.l_linenumber", "b.l_partkey")


@query("SELECT md5(text) AS text_md5, arg_max(source, doc_id) AS source, max(doc_id) AS doc_id, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text")
def dedupe_last_wins(t):
    d = t.documents.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id", "source")
    return d.groupBy("text_md5").agg(F.max_by("source", "doc_id").alias("source"), F.max("doc_id").alias("doc_id"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT md5(text) k, count(*) n, count(DISTINCT source) fam, count(DISTINCT lang) langs, min(doc_id) f FROM documents GROUP BY text)
SELECT k AS text_md5, n, fam AS families, fam < 2 OR n < 2 AS needs_recovery FROM g
""")
def candidate_choice(t):
    d = t.documents.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", "lang")
    g = d.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("families"))
    return g.withColumn("needs_recovery", (F.col("families") < 2) | (F.col("n") < 2))


@query("""
SELECT epoch_us(date_trunc('minute', ts)) AS minute, string_agg(event_type, ' ' ORDER BY ts, event_id) AS texts FROM events GROUP BY 1
""")
def merge_equal_ts(t):
    e = t.events.select(F.expr("date_trunc('minute', ts)").cast("timestamp_ntz").alias("m"), "ts", "event_id", "event_type")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return e.groupBy("m").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), " ").alias("texts")).select(micros("m").alias("minute"), "texts")


@query(f"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{TOKENS.replace("'", "''")}') h FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{TOKENS.replace("'", "''")}') r FROM benchmark),
p AS (SELECT doc_id, lang, r, h, list_distinct(r) v FROM d JOIN b ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
e AS (SELECT doc_id, lang, len(r) u, levenshtein(list_aggregate(list_transform(r, lambda x: chr((33 + list_position(v, x))::int)), 'string_agg', ''),
      coalesce(list_aggregate(list_transform(h, lambda x: chr((33 + coalesce(list_position(v, x), 0))::int)), 'string_agg', ''), '')) e FROM p)
SELECT lang, sum(e)::bigint AS errors, sum(u)::bigint AS units, round(sum(e) / greatest(1, sum(u)), 6) AS rate FROM e GROUP BY lang
""")
def token_edit_distance(t):
    d = _pairs(t).select("lang", F.size("ref").alias("units"), token_errors(F.col("ref"), F.col("hyp")).alias("errors"))
    g = E.rates(d, "lang", "errors", "units")
    return g.select("lang", F.col("errors").cast("long").alias("errors"), F.col("units").cast("long").alias("units"), F.round("rate", 6).alias("rate"))


def _pairs(t):
    """Each text against one item, both whole: (lang, ref, hyp)."""
    n = max(1, t.benchmark.count())
    part = lambda c: units(F.col(c), F.lit("en"))
    ref = t.benchmark.select("item_id", part("text").alias("ref"))
    hyp = t.documents.select("lang", (F.col("doc_id") % n).alias("item_id"), part("text").alias("hyp"))
    return hyp.join(F.broadcast(ref) if n <= 100_000 else ref, "item_id").select("lang", "ref", "hyp")


@query(None)
def flagship_error_rates(t):
    """Substitutions, deletions and insertions of whole texts by language, with the macro average over languages."""
    d = _pairs(t).select("lang", F.size("ref").alias("units"), long_edit_distance(F.col("ref"), F.col("hyp")).alias("d"))
    g = d.select("lang", "units", "d.errors", "d.substitutions", "d.deletions", "d.insertions").groupBy("lang").agg(*[F.sum(c).cast("long").alias(c) for c in ("errors", "substitutions", "deletions", "insertions", "units")])
    g = g.withColumn("rate", F.col("errors") / F.greatest(F.lit(1), F.col("units")))
    whole = g.agg(F.lit("all").alias("lang"), *[F.sum(c).alias(c) for c in ("errors", "substitutions", "deletions", "insertions", "units")], F.avg("rate").alias("rate"))
    return g.union(whole).withColumn("rate", F.round("rate", 6))
