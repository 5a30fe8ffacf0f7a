"""Queries of state, order and closure: status machines, stitched windows, as-of joins, invalidation, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.functions import text as X
from quaver.operators.digests import corpus_digest
from quaver.operators.ranges import PART, ROWS, last_known, over_edges, ranged
from quaver.operators.resampling import HALF, low_pass, resample
from quaver.operators.stitching import stitch as stitched
from quaver.plans.base import micros, query
from quaver.sources.storage import scratch
from quaver.streaming import export
from quaver.streaming.machine import SONGS, replay

_LOST = " ".join(f"WHEN '{s}' THEN '{to}'" for s, to in SONGS.recovery.items())
_ACTIVE = ", ".join(f"'{s}'" for s in SONGS.recovery)
_WISH = "CASE event_type WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN CASE event_id % 2 WHEN 0 THEN 'claim' ELSE 'retry' END WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'pause' ELSE 'resolve' END WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'fail' ELSE 'cancel' END END"


def log_of(events):
    """Events as wishes of their users' jobs."""
    return events.select(F.col("user_id").alias("job"), micros("ts").alias("at"), F.col("event_id").alias("id"), F.expr(_WISH).alias("wish"))


@query(f"""
WITH RECURSIVE rules(status, wish, goal) AS (VALUES {', '.join(f"('{s}', '{w}', '{to}')" for (s, w), to in SONGS.rules.items())}),
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, epoch_us(ts) a, {_WISH} AS wish FROM events),
m AS (SELECT user_id, 0::bigint i, '{SONGS.initial}' AS status, 0::bigint elapsed, 0::bigint starts, 0::bigint refused, 0::bigint crashes, a AS updated FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, coalesce(goal, now), elapsed + CASE WHEN active AND NOT lost THEN gap ELSE 0 END, starts + (coalesce(goal, '') IN ({_ACTIVE}) AND now NOT IN ({_ACTIVE}))::int, refused + (goal IS NULL)::int, crashes + lost::int, a
  FROM (SELECT x.*, r.goal FROM (SELECT m.user_id, e.i, e.a, e.wish, elapsed, starts, refused, crashes, e.a - updated AS gap, m.status IN ({_ACTIVE}) AS active, m.status IN ({_ACTIVE}) AND e.a - updated > {SONGS.timeout} AS lost, CASE WHEN m.status IN ({_ACTIVE}) AND e.a - updated > {SONGS.timeout} THEN CASE m.status {_LOST} END ELSE m.status END AS now
    FROM m JOIN e ON e.user_id = m.user_id AND e.i = m.i + 1) x LEFT JOIN rules r ON r.status = x.now AND r.wish = x.wish)),
f AS (SELECT user_id, arg_max(m, i) AS s, (SELECT max(a) FROM e) AS until FROM m GROUP BY user_id)
SELECT user_id, CASE WHEN s.status IN ({_ACTIVE}) AND until - s.updated > {SONGS.timeout} THEN CASE s.status {_LOST} END ELSE s.status END AS status, s.elapsed AS elapsed, s.starts AS starts, s.refused AS refused, s.crashes + (s.status IN ({_ACTIVE}) AND until - s.updated > {SONGS.timeout})::int AS crashes, s.updated AS updated FROM f
""")
def job_states(t):
    """Each user's job after all events: its status, the microseconds it ran without the downtime of crashes, starts, refused wishes, crashes."""
    return replay(log_of(t.events)).withColumnRenamed("job", "user_id")


def _pieces(t):
    """(rec, words, first): the words of each turn and the place of the first of them in its conversation.  Rows of one turn
    take turns word by word."""
    rows = t.conversations.where("text IS NOT NULL").select(F.struct("conv_id").alias("rec"), F.struct(F.col("turn").isNull().alias("none"), "turn").alias("turn"), "text")
    shared = rows.groupBy("rec", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rec", "turn", F.lit(True).alias("shared"))
    folder = scratch(t.spark, "shared")  # few: its size is known before it is joined
    shared.write.parquet(folder)
    shared = t.spark.read.schema(shared.schema).parquet(folder)
    one = lambda text, p: F.struct(p.alias("p"), text.alias("text"))
    split = F.transform(_words("text"), lambda w, p: one(w, p))
    texts = rows.join(shared, ["rec", "turn"], "left").select("rec", "turn", F.explode(F.when(F.col("shared"), split).otherwise(F.array(one(F.col("text"), F.lit(0))))).alias("x")).select("rec", "turn", "x.*")
    # texts are cut into ranges; what earlier ranges hold of a conversation is carried over their edges
    order = ["turn", "p"]
    cut = ranged(texts, ["rec"], order, ROWS // 10)
    held = cut.join(F.broadcast(over_edges(cut, ["rec"])), "rec", "left_semi").groupBy(PART, "rec").agg(F.sum(F.size(_words("text"))).alias("n"))
    before = Window.partitionBy("rec").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(PART, "rec", F.sum("n").over(before).alias("carried"))
    pieces = cut.repartition(PART, "rec").withColumn("words", _words("text")).drop("text")
    own = Window.partitionBy(PART, "rec").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("own", F.sum(F.size("words")).over(own)).join(F.broadcast(held), [PART, "rec"], "left")
    return pieces.select("rec", "words", (F.coalesce("own", F.lit(0)) + F.coalesce("carried", F.lit(0))).cast("long").alias("first")).where(F.size("words") > 0)


def _words(c):
    return F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _twenties(pieces):
    """(rec, seg, said): 20 words from every 17th on, as far as there are more than in the window before; a piece gives each of
    its windows a slice."""
    first, n = F.col("first"), F.size("words")
    seg = F.explode(F.sequence(F.greatest(F.floor(first / 17) - F.when(first % 17 < 3, 1).otherwise(0), F.lit(0)), F.floor((first + n - 1) / 17)))
    j = pieces.withColumn("seg", seg).withColumn("at", F.greatest(F.col("seg") * 17 - first, F.lit(0)).cast("int"))
    part = F.slice("words", F.col("at") + 1, (F.least(F.col("seg") * 17 + 20 - first, n) - F.col("at")).cast("int"))
    j = j.select("rec", F.col("seg").cast("int").alias("seg"), F.struct((first + F.col("at")).alias("i"), part.alias("ws")).alias("x"))
    return j.groupBy("rec", "seg").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("rec", "seg", F.flatten(F.transform("xs", lambda x: x["ws"])).alias("said"))


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS p FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, list(word ORDER BY turn, p) AS ws, count(*) AS n FROM w GROUP BY 1),
k AS (SELECT conv_id, ws, n, unnest(range(0, (n - 1) // 17 + 1)) AS k FROM l),
s AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k % 3 = 2 THEN 17 * k + 1 ELSE 17 * k + 3 END AS a, CASE WHEN (k + 1) % 3 = 2 AND n > 17 * (k + 1) THEN 17 * k + 17 ELSE least(n - 1, 17 * k + 19) END AS b, k % 3 = 2 AND n >= 17 * k + 2 AS conflict, (k + 1) % 3 = 2 AND n >= 17 * (k + 1) + 2 AS next_conflict FROM k)
SELECT conv_id, k::int AS segment, CASE WHEN conflict THEN 5.625 + 8.5 * k ELSE 5 + 0.5 * a + CASE WHEN k % 3 = 2 THEN -0.125 ELSE 0.125 END END::double AS start, (5.5 + 0.5 * b)::double AS stop, array_to_string(ws[a + 1:b + 1], ' ') AS text,
  conflict OR next_conflict AS uncertain, conflict, (b - a + 1)::int AS n_words, CASE WHEN conflict AND next_conflict AND a = b THEN 1 ELSE conflict::int + next_conflict::int END::int AS n_estimated, (2 * (b - a + 1) - conflict::int)::int AS n_chars
FROM s WHERE a <= b
""")
def stitch(t):
    """Every conversation heard in windows of 20 words that begin 3 words early; every third window hears its first word
    otherwise and all of its words a quarter of a second early, so that a cut falls into a word."""
    early, begin = F.col("seg") % 3 == 2, (8.5 * F.col("seg")).cast("double")
    said = F.when(early, F.concat(F.array(F.lit("(inaudible)")), F.slice("said", 2, 19))).otherwise(F.col("said"))
    windows = _twenties(_pieces(t)).select("rec", "seg", (5 + begin).alias("window_start"), (5.625 + begin).alias("core"), F.lit("en").alias("language"), (5 + begin + F.when(early, -0.125).otherwise(0.125)).cast("double").alias("first"), said.alias("said"))
    folder = scratch(t.spark, "heard")  # read twice: counted, and cut into ranges
    windows.write.parquet(folder)

    def heard(*fields):
        """The fields of a window's words, from the words themselves and their places."""

        def of(w, j):
            start, stop = F.col("first") + j * 0.5, F.col("window_start") + 0.5 + j * 0.5
            half = lambda a, z: F.struct(F.lit("x").alias("char"), a.alias("start"), z.alias("stop"))
            made = {"key": X.normalized(w), "word": w, "start": start, "stop": stop, "chars": F.array(half(start, start + 0.25), half(start + 0.25, stop))}
            return F.struct(*[made[f].alias(f) for f in fields])

        return F.transform("said", of)

    out = stitched(t.spark.read.schema(windows.schema).parquet(folder), hear=heard)
    return out.select("rec.conv_id", F.col("seg").alias("segment"), "start", "stop", "text", "uncertain", "conflict", F.size("words").alias("n_words"), F.size(F.filter("words", lambda w: w["estimated"])).alias("n_estimated"), F.aggregate("words", F.lit(0), lambda a, w: a + F.size(w["chars"])).alias("n_chars"))


@query("""
WITH e AS (SELECT user_id % 100 AS k, (epoch_us(ts) // 1000000 - 1704067200) * 120 + 1514764800 AS s, max(event_id) AS event_id FROM events GROUP BY ALL),
o AS (SELECT o_orderkey, o_custkey % 100 AS k, epoch_us(o_orderdate) // 1000000 + 820540800 AS s FROM orders)
SELECT o_orderkey, e.event_id FROM o ASOF LEFT JOIN e ON o.k = e.k AND e.s <= o.s
""")
def asof_last(t):
    """The last event of an order's group before it, in ranges of time, so that a group of any size is spread over tasks;
    the month of events is stretched over the years of orders."""
    at = (F.floor(micros("ts") / 1000000) - 1704067200) * 120 + 1514764800
    e = t.events.select((F.col("user_id") % 100).alias("k"), at.alias("at"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = t.orders.select((F.col("o_custkey") % 100).alias("k"), (F.floor(micros("o_orderdate") / 1000000) + 820540800).alias("at"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    # of one time, events come before orders, the greatest last
    both = o.unionByName(e).withColumn("side", F.col("event_id").isNull())
    cut = ranged(both, ["k"], ["at", "side", "event_id"])
    return last_known(cut, ["k"], ["at", "side", "event_id"], F.col("event_id"), "last").where("o_orderkey IS NOT NULL").select("o_orderkey", F.col("last").alias("event_id"))


_FIELDS = " || ';' || ".join(f"'{c}=' || coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "lang", "source", "text"))
_UP = "".join(f", n{i + 1} AS (SELECT source, place >> 10 AS place, sha256(string_agg(coalesce(place::varchar, '-') || ':' || h, ',' ORDER BY place)) AS h FROM n{i} GROUP BY 1, place >> 10)" for i in range(7))


@query(f"""
WITH r AS (SELECT source, doc_id, sha256({_FIELDS}) AS r FROM documents), c AS (SELECT source, doc_id, r, count(*) AS n FROM r GROUP BY ALL),
a AS (SELECT source, doc_id, r[1:6] AS place, sha256(string_agg(r || ':' || n, ',' ORDER BY r)) AS h FROM c GROUP BY ALL),
b AS (SELECT source, doc_id, place[1:3] AS place, sha256(string_agg(place || ':' || h, ',' ORDER BY place)) AS h FROM a GROUP BY 1, 2, 3),
n0 AS (SELECT source, doc_id AS place, sha256(string_agg(place || ':' || h, ',' ORDER BY place)) AS h FROM b GROUP BY 1, 2){_UP}
SELECT source, sha256(string_agg(coalesce(place::varchar, '-') || ':' || h, ',' ORDER BY place)) AS digest FROM n7 GROUP BY 1
""")
def corpus_digests(t):
    """A canonical digest of each source's documents, without their counted length, as a tree of hashes over ranges of ids."""
    return corpus_digest(t.documents, "doc_id", ["source"], ["n_chars"])


_TAPS = low_pass(2, 3)
_REACH = HALF * 3


@query(f"""
WITH v AS (SELECT vec_id // 8 AS rec, vec_id % 8 AS chunk, embedding AS x, len(embedding)::bigint AS n FROM embeddings), o AS (SELECT *, (sum(n) OVER (PARTITION BY rec ORDER BY chunk ROWS UNBOUNDED PRECEDING) - n)::bigint AS a FROM v),
s AS (SELECT rec, a + i AS k, x[i + 1]::double AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM o)),
m AS (SELECT rec, chunk, unnest(range((a * 2 + 2) // 3, ((a + n) * 2 + 2) // 3)) AS m FROM o),
h AS (SELECT [{', '.join(repr(float(x)) for x in _TAPS)}] AS taps),
y AS (SELECT m.rec, m.chunk, m.m, sum(s.x * h.taps[m.m * 3 - s.k * 2 + {_REACH} + 1]) AS y FROM m JOIN s ON s.rec = m.rec AND s.k * 2 BETWEEN m.m * 3 - {_REACH} AND m.m * 3 + {_REACH}, h GROUP BY ALL)
SELECT rec, chunk, count(*)::int AS n, round(sum(y), 6) AS total, round(sum(abs(y)), 6) AS size, round(arg_min(y, m), 6) AS first, round(arg_max(y, m), 6) AS last FROM y GROUP BY ALL
""")
def resampled(t):
    """Recordings of eight vectors each, at two thirds of their rate."""
    chunks = t.embeddings.select(F.floor(F.col("vec_id") / 8).alias("rec"), (F.col("vec_id") % 8).alias("chunk"), F.col("embedding").alias("x"))
    y = resample(chunks, ["rec"], "chunk", "x", 2, 3)
    total = lambda f: F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v)), 6)
    return y.select("rec", "chunk", F.size("x").alias("n"), total(lambda v: v).alias("total"), total(F.abs).alias("size"), F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.get("x", F.size("x") - 1), 6).alias("last"))


@query("""
WITH c AS (SELECT c_custkey k, c_name AS name, md5(c_mktsegment) AS f FROM customer)
SELECT name AS target, CASE WHEN k % 5 = 0 THEN md5('new') WHEN k % 2 = 1 OR k % 4 = 0 THEN f ELSE md5('x') END AS fingerprint, CASE WHEN k % 5 = 0 THEN 2 WHEN k % 2 = 0 THEN 0 ELSE 1 END::bigint AS batch FROM c
UNION ALL SELECT name || ' (2)', f, 1::bigint FROM c WHERE k % 4 = 2
""")
def exports(t):
    """Customers exported in three batches with a journal: the second one is killed after its rows are written, run again, and run once more."""
    folder, k = scratch(t.spark, "exports"), F.col("c_custkey")
    rows = lambda c, f: t.customer.where(c).select(F.col("c_name").alias("name"), F.md5(f.cast("binary")).alias("fingerprint"))
    export.publish(rows(k % 2 == 0, F.when(k % 4 == 0, F.col("c_mktsegment")).otherwise("x")), 0, folder)
    second = rows(F.lit(True), F.col("c_mktsegment"))
    export.write_try(second, 1, folder, "keep_both", "name string, fingerprint string")  # killed before its entry
    assert export.publish(second, 1, folder) and not export.publish(second, 1, folder)
    export.publish(rows(k % 5 == 0, F.lit("new")), 2, folder, "replace")
    return export.current(export.exported(t.spark, folder, "name string, fingerprint string"))
