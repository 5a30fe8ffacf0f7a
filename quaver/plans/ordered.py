"""Window, fold and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.operators import intervals as I
from quaver.operators import sequences as S
from quaver.operators.folds import Pack, ordered_fold
from quaver.plans.base import days, micros, query

USER = ["user_id"]
ORDER = ["ts", "event_id"]
RUNS = """e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::bigint run FROM e)"""


@query(f"""
WITH {RUNS}, g AS (SELECT user_id, run, min(event_type) event_type, count(*) n, min(epoch_us(ts)) began FROM r GROUP BY ALL)
SELECT user_id, run, event_type, n, began, coalesce(lead(began) OVER (PARTITION BY user_id ORDER BY run), 1706745600000000) AS finish FROM g
""")
def islands(t):
    r = S.runs(t.events, USER, ORDER, "event_type")
    g = r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min(micros("ts")).alias("began"))
    return g.withColumn("finish", F.coalesce(F.lead("began").over(Window.partitionBy("user_id").orderBy("run")), F.lit(1706745600000000)))


@query(f"WITH {RUNS} SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) n FROM r WHERE event_type = 'click' GROUP BY ALL) GROUP BY user_id")
def longest_event_run(t):
    r = S.runs(t.events, USER, ORDER, "event_type").where("event_type = 'click'")
    return r.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query(f"WITH {RUNS} SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3")
def long_runs_only(t):
    return S.runs(t.events, USER, ORDER, "event_type").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS frame_median FROM events")
def frame_median_5(t):
    return S.frame_median(t.events, USER, ORDER, "value", 2).select("event_id", F.round("frame_median", 4).alias("frame_median"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_id % 7 > 2 THEN value END AS v FROM events),
f AS (SELECT event_id, list_sort(list(v) FILTER (v IS NOT NULL) OVER a) AS three, list_sort(list(v) FILTER (v IS NOT NULL) OVER b) AS five FROM e WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, coalesce(three[(len(three) + 1) // 2], -1) AS three, coalesce(five[(len(five) + 1) // 2], -1) AS five FROM f
""")
def track_filters(t):
    """A track with gaps under filters of three and of five frames; -1 where a filter sees gaps only."""
    e = t.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 7 > 2, F.col("value")).otherwise(float("nan")).alias("v"))
    three = S.frame_lower_median(e, USER, ORDER, "v", 1).withColumnRenamed("frame_median", "three")
    both = S.frame_lower_median(three, USER, ORDER, "v", 2).withColumnRenamed("frame_median", "five")
    return both.select("event_id", *[F.nanvl(c, F.lit(-1.0)).alias(c) for c in ("three", "five")])


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS frame_median FROM events")
def frame_median_3(t):
    return S.frame_median(t.events, USER, ORDER, "value", 1).select("event_id", F.round("frame_median", 4).alias("frame_median"))


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) s, epoch_us(ts) + (value * 1000000)::bigint f FROM events),
n AS (SELECT *, lag(f) OVER w pf, lead(s) OVER w ns FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, greatest(s - 2000000, coalesce((pf + s) // 2, s - 2000000)) AS opens, least(f + 2000000, coalesce((f + ns) // 2, f + 2000000)) AS closes,
       coalesce(pf > s, false) AS overlaps FROM n
""")
def window_clamp(t):
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t.events.select("event_id", "user_id", micros("ts").alias("s"), "value").withColumn("f", F.col("s") + F.round(F.col("value") * 1000000).cast("long"))
    pf, ns = F.lag("f").over(w), F.lead("s").over(w)
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    return e.select("event_id", F.greatest(F.col("s") - 2000000, F.coalesce(half(pf, F.col("s")), F.col("s") - 2000000)).alias("opens"), F.least(F.col("f") + 2000000, F.coalesce(half(F.col("f"), ns), F.col("f") + 2000000)).alias("closes"), F.coalesce(pf > F.col("s"), F.lit(False)).alias("overlaps"))


@query("""
WITH c AS (SELECT conv_id, turn, length(coalesce(text, ''))::bigint n FROM conversations),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) u, sum(n) OVER (PARTITION BY conv_id) w FROM c)
SELECT conv_id, turn, round((u - n) / greatest(1, w), 6) AS begin, round(u / greatest(1, w), 6) AS finish FROM r
""")
def running_allocation(t):
    c = t.conversations.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return S.running_total(c, ["conv_id"], ["turn"], "n").select("conv_id", "turn", F.round("begin", 6).alias("begin"), F.round("finish", 6).alias("finish"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END v FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM e),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) l,
  first_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) r FROM i)
SELECT event_id, round(coalesce(v, CASE WHEN l IS NULL AND r IS NULL THEN 500.0 * (i - 1) / n WHEN l IS NULL THEN r.v * (i - 1) / (r.i - 1) WHEN r IS NULL THEN l.v + (500 - l.v) * (i - l.i) / (n + 1 - l.i) ELSE l.v + (r.v - l.v) * ((i - l.i) / (r.i - l.i)) END), 9) AS filled
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM k)
""")
def interpolate_nulls(t):
    e = t.events.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return S.interpolate(e, USER, ORDER, "v", F.lit(500.0)).select("event_id", F.round("filled", 9).alias("filled"))


@query("""
WITH a AS (SELECT event_id, (epoch_us(ts) // 1000000) s, (epoch_us(ts) // 1000000) + 60 f FROM events WHERE event_type = 'click'),
b AS (SELECT (epoch_us(ts) // 1000000) s, (epoch_us(ts) // 1000000) + round(value)::bigint f FROM events WHERE event_type = 'purchase')
SELECT event_id, s, f FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.s < b.f AND b.s < a.f)
""")
def overlap_anti(t):
    at = F.floor(micros("ts") / 1000000)
    a = t.events.where("event_type = 'click'").select("event_id", at.alias("s"), (at + 60).alias("f"))
    b = t.events.where("event_type = 'purchase'").select(at.alias("s"), (at + F.round("value").cast("long")).alias("f"))
    return I.not_overlapping(a, b, "s", "f", 600)


@query("""
WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::date)::bigint s FROM orders),
l AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', l_shipdate::date)::bigint d FROM lineitem)
SELECT o_orderkey, count(*) AS n, sum(d - s)::bigint AS total_days FROM o JOIN l ON l_orderkey = o_orderkey AND d >= s + 10 AND d < s + 60 GROUP BY 1
""")
def midpoint_contain(t):
    o = t.orders.select("o_orderkey", days("o_orderdate").cast("long").alias("s")).withColumns({"lo": F.col("s") + 10, "hi": F.col("s") + 60})
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), days("l_shipdate").cast("long").alias("d"))
    return I.points_in(l, "d", o, "lo", "hi", 60, ["o_orderkey"]).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d") - F.col("s")).alias("total_days"))


@query("""
WITH a AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000) s FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, (epoch_us(ts) // 1000000) o, value, event_id e FROM events WHERE event_type <> 'purchase')
SELECT event_id, arg_min(e, (value, o, e)) AS nearest, count(*) AS n_in_band FROM a JOIN b USING (user_id) WHERE abs(s - o) <= 36000 GROUP BY event_id
""")
def nearest_min_energy(t):
    at = F.floor(micros("ts") / 1000000)
    a = t.events.where("event_type = 'purchase'").select("event_id", "user_id", at.alias("s"))
    b = t.events.where("event_type <> 'purchase'").select("user_id", at.alias("o"), "value", F.col("event_id").alias("e"))
    return I.least_in_band(a, b, ["user_id"], "s", "o", 36000, "value", "e", "event_id")


@query("""
SELECT a.o_custkey, count(*) AS pairs, round(max(abs(a.o_totalprice - b.o_totalprice)), 4) AS widest
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY 1
""")
def pair_triangular(t):
    """All pairs within a key: their number and widest gap, from one pass over the key's rows."""
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    return g.where("n > 1").select("o_custkey", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.round(F.col("hi") - F.col("lo"), 4).alias("widest"))


@query("""
SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE abs(date_diff('day', o_orderdate::date, l_shipdate::date)) <= 20
""")
def band_match(t):
    o = t.orders.select("o_orderkey", days("o_orderdate").alias("a"))
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", days("l_shipdate").alias("b"))
    return I.band_match(o, l, ["o_orderkey"], "a", "b", 20).select("o_orderkey", "l_linenumber")


@query("""
WITH RECURSIVE n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, ((epoch_us(ts) // 1000000) - 1704067200) // 60 s, ((epoch_us(ts) // 1000000) - 1704067200) // 60 + round_even(value, 0)::bigint f FROM events),
p AS (SELECT user_id, 0::bigint i, 0::bigint last, 0::bigint begin, 0::bigint length FROM (SELECT DISTINCT user_id FROM n)
  UNION ALL SELECT n.user_id, n.i, greatest(n.f, greatest(p.last, n.s) + 1), greatest(p.last, n.s), greatest(n.f, greatest(p.last, n.s) + 1) - greatest(p.last, n.s) FROM p JOIN n ON n.user_id = p.user_id AND n.i = p.i + 1)
SELECT user_id, count(*) AS n_notes, sum(begin)::bigint AS begins, sum(length)::bigint AS lengths, max(begin + length) AS finish FROM p WHERE i > 0 GROUP BY user_id
""")
def pack_notes(t):
    minute = F.floor((micros("ts") - 1704067200000000) / 60000000)
    n = t.events.select("user_id", "ts", "event_id", minute.alias("start"), (minute + F.bround("value").cast("long")).alias("stop"))
    p = ordered_fold(n, ["user_id"], ["ts", "event_id"], Pack, ["start", "stop"], "i int, begin long, length long")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_notes"), F.sum("begin").alias("begins"), F.sum("length").alias("lengths"), F.max(F.col("begin") + F.col("length")).alias("finish"))
