"""History, queue and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.operators import history as H
from quaver.plans.base import micros, query


@query("""
WITH cur AS (SELECT max(o_orderdate) d, max(o_orderkey) k FROM orders WHERE o_orderstatus <> 'F'),
c AS (SELECT o_orderdate d, o_orderkey k FROM orders WHERE o_orderkey % 10 = 0 ORDER BY 1 DESC, 2 DESC LIMIT 1),
p AS (SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders, c
      WHERE o_orderstatus <> 'O' AND (o_orderdate < c.d OR (o_orderdate = c.d AND o_orderkey < c.k))
      ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21)
SELECT o_orderkey, o_orderstatus, epoch_us(o_orderdate) AS created, place, has_next FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER () > 20 AS has_next FROM p) WHERE place <= 20
""")
def feed_page(t):
    cur = t.orders.where("o_orderkey % 10 = 0").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderdate", "o_orderkey").limit(1).first()
    rows = t.orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", "o_orderdate")
    if cur is not None:  # an unknown cursor gives the first page
        rows = H.after_cursor(rows, "o_orderdate", "o_orderkey", F.lit(cur[0]).cast("timestamp_ntz"), F.lit(cur[1]))
    out = H.page(rows, "o_orderdate", "o_orderkey", 20)
    return out.select("o_orderkey", "o_orderstatus", micros("o_orderdate").alias("created"), F.col("place").cast("long").alias("place"), "has_next")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus,
  CASE WHEN o_orderstatus = 'O' THEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey) ELSE 0 END AS queue_position
FROM orders WHERE o_orderstatus IN ('O', 'P')
""")
def active_fifo(t):
    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P")).withColumn("waiting", F.col("o_orderstatus") == "O")
    out = H.queue_positions(rows, ["o_custkey"], F.col("waiting"), ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("queue_position").cast("long").alias("queue_position"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_status(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return H.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'cancelled' ELSE o_orderstatus END AS status,
       o_orderstatus = 'P' AS cancel_requested, greatest(0, coalesce(round(o_totalprice, 2), 0) - 1000) AS over
FROM orders
""")
def cancel_case(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s.isin("O", "P"), "cancelled").otherwise(s).alias("status"), (s == "P").alias("cancel_requested"), F.greatest(F.lit(0.0), F.coalesce(F.round("o_totalprice", 2), F.lit(0.0)) - 1000).alias("over"))


@query("""
WITH e AS (SELECT user_id, event_type, epoch_us(ts) u, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events)
SELECT user_id, round(coalesce(sum(CASE WHEN event_type IN ('click', 'view') THEN (n - u) / 1e6 END), 0), 3) AS elapsed_seconds,
       count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS runs FROM e GROUP BY user_id
""")
def elapsed_running(t):
    e = t.events.select("user_id", "event_id", "event_type", micros("ts").alias("u"))
    return H.elapsed_in_state(e, "user_id", "u", "event_id", F.col("event_type").isin("click", "view"))


@query("""
SELECT event_id FROM events, (SELECT max(epoch_us(ts)) m FROM events)
WHERE (m - epoch_us(ts)) / 1e6 < CASE WHEN value < 100 THEN 86400 ELSE 604800 END
""")
def ttl_filter(t):
    now = t.events.agg(F.max(micros("ts"))).first()[0]
    age = (F.lit(now) - micros("ts")) / 1e6
    return H.unexpired(t.events, age, F.when(F.col("value") >= 100, F.col("value")), 604_800, 86_400).select("event_id")


@query("""
WITH ch AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 14 = 0 THEN '**' ELSE '*' END AS c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0
            UNION ALL SELECT -n_nationkey, n_name, NULL FROM nation WHERE n_nationkey > 0)
SELECT c_custkey::bigint AS c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch)
UNION ALL SELECT c_custkey::bigint, c_name, c_acctbal FROM ch
""")
def upsert_rows(t):
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = base.where("c_custkey % 7 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    extra = t.nation.where("n_nationkey > 0").select((-F.col("n_nationkey")).cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    later = base.where("c_custkey % 14 = 0").withColumn("c_name", F.concat("c_name", F.lit("**"))).withColumn("version", F.lit(2))
    return H.upsert(base, new.unionByName(extra).withColumn("version", F.lit(1)).unionByName(later), "c_custkey", ["version"])


@query("""
SELECT c.c_custkey, coalesce(n.s, c.c_mktsegment) AS c_mktsegment, c.c_acctbal FROM customer c
LEFT JOIN (SELECT s_suppkey, 'UPDATED' AS s FROM supplier WHERE s_acctbal > 0) n ON c.c_custkey = n.s_suppkey
WHERE NOT (c.c_acctbal < 0 AND c.c_nationkey < 5)
""")
def update_delete(t):
    ch = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("c_custkey"), F.lit("UPDATED").alias("c_mktsegment"))
    kept = H.guarded_delete(t.customer, (F.col("c_acctbal") < 0) & (F.col("c_nationkey") < 5))
    return H.partial_update(kept, ch, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O'),
u AS (SELECT o_custkey FROM r UNION SELECT s_suppkey FROM supplier)
SELECT 'with_open' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM r)
UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'union', count(*) FROM u
UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM r INTERSECT SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'left_only', count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT o_custkey FROM r)
""")
def semi_anti_set(t):
    r = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    c, s, o = t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(c.join(r, "k", "left_semi"), "with_open").union(n(c.join(o, "k", "left_anti"), "without")).union(n(r.union(s).distinct(), "union")).union(n(r.intersect(s), "both")).union(n(s.subtract(r), "left_only"))


@query("""
SELECT event_id, CASE WHEN regexp_matches(event_type, 'err|fail') THEN 'application' WHEN value > 400 THEN 'memory' WHEN event_type IN ('purchase', 'signup') THEN 'backend' ELSE 'none' END AS class,
       CASE WHEN value > 400 THEN 1 WHEN value > 200 THEN 4 ELSE 8 END AS batch FROM events
""")
def error_class(t):
    e, v = F.col("event_type"), F.col("value")
    kind = F.when(e.rlike("err|fail"), "application").when(v > 400, "memory").when(e.isin("purchase", "signup"), "backend").otherwise("none")
    return t.events.select("event_id", kind.alias("class"), F.when(v > 400, 1).when(v > 200, 4).otherwise(8).alias("batch"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_props(t):
    p = F.from_json("props", "k long")
    return t.events.select("event_id", p["k"].alias("k"), p["k"].isNotNull().alias("has_k"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) u, event_id FROM events),
g AS (SELECT *, CASE WHEN lag(u) OVER (PARTITION BY user_id ORDER BY u, event_id) IS NULL OR u - lag(u) OVER (PARTITION BY user_id ORDER BY u, event_id) >= 1800000000 THEN 1 ELSE 0 END f FROM e),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY u, event_id ROWS UNBOUNDED PRECEDING) n FROM g)
SELECT user_id, min(u) AS began, max(u) AS last, count(*) AS n_events FROM s GROUP BY user_id, n
""")
def activity_sessions(t):
    from quaver.streaming.events import sessions

    return sessions(t.events).select("user_id", micros("began").alias("began"), micros("last").alias("last"), "n_events")


@query("""
SELECT count(*) AS n_rows, count_if(o_orderstatus = 'F') AS finished, avg((o_totalprice > 200000)::int::double) AS share_large,
       count(DISTINCT o_custkey) AS customers, bool_and(o_totalprice > 0) AS all_positive, bool_or(o_orderstatus = 'P') AS any_partial FROM orders
""")
def conditional_counts(t):
    big = F.col("o_totalprice")
    return t.orders.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.avg((big > 200000).cast("double")).alias("share_large"), F.count_distinct("o_custkey").alias("customers"), F.bool_and(big > 0).alias("all_positive"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_partial"))


@query("""
SELECT o_custkey, o_orderkey, CASE WHEN n = 1 THEN o_orderpriority ELSE o_orderpriority || ' (' || n || ')' END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) n FROM orders)
""")
def collision_suffix(t):
    n = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.when(n == 1, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" ("), n.cast("string"), F.lit(")"))).alias("name"))


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey) = 1 AND o_orderstatus = 'O' AND bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) IS NOT TRUE THEN 'P' ELSE o_orderstatus END AS status FROM orders
""")
def claim_next(t):
    """Each customer's first waiting order starts, unless one of theirs is running."""
    s = F.col("o_orderstatus")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return H.claim(rows, ["o_custkey"], "o_orderstatus", "O", "P", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", s.alias("status"))


@query("""
WITH e AS (SELECT epoch_us(ts) // 1000000 AS s FROM events), x AS (SELECT s, unnest(list_distinct([s // 5400, (s - 600) // 5400, (s + 600) // 5400])) AS core FROM e)
SELECT core * 5400 AS core, count(*) AS seen, count(*) FILTER (s // 5400 = core) AS owned FROM x GROUP BY 1
""")
def owned_windows(t):
    """Windows of ninety minutes with ten more on both sides; a row is owned by one of them."""
    from quaver.streaming.events import owned_windows as windows

    w = windows(t.events, "90 minutes", "10 minutes")
    return w.select(F.floor(F.unix_seconds("core")).cast("long").alias("core"), "seen", "owned")


@query("SELECT event_type, count(*) AS n, sum(event_id)::bigint AS ids FROM events GROUP BY 1")
def late_copies(t):
    """Every third event arrives twice; one of each stays."""
    from quaver.streaming.events import first_seen

    return first_seen(t.events.union(t.events.where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
