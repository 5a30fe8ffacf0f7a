"""Notes, charts and folds over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import melody as M
from quaver.operators.folds import Hysteresis, Windows, ordered_fold
from quaver.plans.base import query
from quaver.sources import charts

#: Every vector is a recording: 64 frames of 0.02 s with a stepped tune, and three syllables.
TRACK = """
f AS (SELECT vec_id AS rec, i, i * 0.02 AS time, 440 * pow(2, ((i // 11) * 3 + vec_id) % 5 / 12.0) AS hz, abs(embedding[i + 1]::double) * 6 AS confidence, abs(embedding[i + 1]::double) AS energy
  FROM (SELECT *, unnest(range(0, len(embedding))) i FROM embeddings)),
u0 AS (SELECT vec_id AS rec, k AS unit, [0.0, 0.5, 0.9][k]::double AS start, [0.5, 0.9, 1.4][k]::double AS stop, ['la', 'lo ', 'li '][k] AS text, vec_id % 3 + k // 3 AS phrase, (vec_id + k) % 2 = 0 AS estimated, len(embedding) * 0.02 AS duration
  FROM (SELECT *, unnest([1, 2, 3]) k FROM embeddings)),
"""
NOTES = f"""
{TRACK}
u1 AS (SELECT rec, unit, text, phrase, estimated, duration, greatest(0, start) AS start, least(duration, stop) AS stop FROM u0),
u2 AS (SELECT u1.* EXCLUDE (start), CASE WHEN estimated THEN greatest(0, coalesce((SELECT arg_min(time, (energy, time)) FROM f WHERE f.rec = u1.rec AND abs(f.time - u1.start) < least(0.06, (u1.stop - u1.start) / 4)), start)) ELSE start END AS start FROM u1 WHERE stop > start),
u AS (SELECT u2.* EXCLUDE (stop), CASE WHEN estimated THEN least(duration, coalesce((SELECT arg_min(time, (energy, time)) FROM f WHERE f.rec = u2.rec AND abs(f.time - u2.stop) < least(0.06, (u2.stop - u2.start) / 4)), stop)) ELSE stop END AS stop FROM u2),
s AS (SELECT u.rec, unit, time, round_even(69 + 12 * log2(hz / 440), 0)::int - 60 AS p, confidence >= 0.35 AND energy > 0.001 AND hz > 0 AS sung FROM u JOIN f ON f.rec = u.rec AND time >= start AND time < stop),
c AS (SELECT rec, unit, count(*) FILTER (sung) n, count(*) m FROM s GROUP BY ALL),
t AS (SELECT rec, unit, time, p, round_even(median(p) OVER (PARTITION BY rec, unit ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0)::int AS q FROM s WHERE sung),
g AS (SELECT *, sum(d) OVER (PARTITION BY rec, unit ORDER BY time ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, CASE WHEN q IS NOT DISTINCT FROM lag(q) OVER (PARTITION BY rec, unit ORDER BY time) THEN 0 ELSE 1 END d FROM t)),
r AS (SELECT rec, unit, min(time) AS begin, min(q) AS q FROM g GROUP BY rec, unit, run HAVING count(*) >= 8),
mid AS (SELECT rec, unit, round_even(median(p), 0)::int AS middle FROM t GROUP BY ALL),
a AS (SELECT u.*, middle, begin, q, row_number() OVER w - 1 AS i, lead(begin) OVER w AS nxt FROM u JOIN c USING (rec, unit) JOIN mid USING (rec, unit) LEFT JOIN r USING (rec, unit) WHERE n / greatest(1, m) >= 0.3 AND n > 0 WINDOW w AS (PARTITION BY u.rec, u.unit ORDER BY begin)),
notes AS (
  SELECT rec, unit, i, CASE WHEN i = 0 THEN start ELSE begin END AS start, coalesce(nxt, stop) AS stop, coalesce(q, middle) AS pitch, ':' AS kind,
    (CASE WHEN i = 0 THEN rtrim(text) ELSE '~' END) || (CASE WHEN nxt IS NULL AND text LIKE '% ' THEN ' ' ELSE '' END) AS text, phrase, duration FROM a WHERE coalesce(nxt, stop) > CASE WHEN i = 0 THEN start ELSE begin END
  UNION ALL SELECT u.rec, u.unit, 0, start, stop, 0, 'F', text, phrase, duration FROM u LEFT JOIN c USING (rec, unit) WHERE NOT coalesce(n / greatest(1, m) >= 0.3 AND n > 0, false))
"""


def _recordings(t):
    frames = t.embeddings.select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("i", "x"))
    step = (F.floor(F.col("i") / 11) * 3 + F.col("rec")) % 5
    frames = frames.select("rec", (F.col("i") * F.lit(0.02)).alias("time"), (440 * F.pow(F.lit(2.0), step / 12.0)).alias("hz"), (F.abs(F.col("x").cast("double")) * 6).alias("confidence"), F.abs(F.col("x").cast("double")).alias("energy"))
    parts = F.array(*[F.struct(F.lit(k).alias("unit"), F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(x).alias("text")) for k, a, b, x in ((1, 0.0, 0.5, "la"), (2, 0.5, 0.9, "lo "), (3, 0.9, 1.4, "li "))])
    units = t.embeddings.select(F.col("vec_id").alias("rec"), (F.size("embedding") * F.lit(0.02)).alias("duration"), F.inline(parts))
    units = units.withColumn("phrase", F.col("rec") % 3 + F.floor(F.col("unit") / 3)).withColumn("estimated", (F.col("rec") + F.col("unit")) % 2 == 0)
    return units, frames


@query(f"WITH {NOTES} SELECT rec, unit, i::int AS i, round(start, 6) AS start, round(stop, 6) AS stop, pitch, kind, text, phrase::bigint AS phrase FROM notes")
def make_notes(t):
    n = M.make_notes(*_recordings(t))
    return n.select("rec", "unit", "i", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "pitch", "kind", "text", F.col("phrase").cast("long").alias("phrase"))


PLACED = f"""{NOTES},
n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start, unit, i) j, greatest(0, round_even(20 * start, 0))::bigint s, greatest(0, round_even(20 * stop, 0))::bigint e, greatest(0, round_even(20 * duration, 0))::bigint lim FROM notes),
p AS (SELECT rec, 0::bigint j, 0::bigint fin, 0::bigint begin, 0::bigint length, false AS put FROM (SELECT DISTINCT rec FROM n)
  UNION ALL SELECT n.rec, n.j, CASE WHEN greatest(e, greatest(fin, s) + 1) <= lim THEN greatest(e, greatest(fin, s) + 1) ELSE fin END, greatest(fin, s), greatest(e, greatest(fin, s) + 1) - greatest(fin, s), greatest(e, greatest(fin, s) + 1) <= lim FROM p JOIN n ON n.rec = p.rec AND n.j = p.j + 1),
q AS (SELECT n.*, p.begin AS tk, p.length, row_number() OVER (PARTITION BY n.rec ORDER BY n.j) k FROM p JOIN n USING (rec, j) WHERE put),
b AS (SELECT rec, k, tk, length, phrase, length(text)::bigint AS chars, NULL::bigint AS cut FROM q WHERE k = 1
  UNION ALL SELECT q.rec, q.k, q.tk, q.length, q.phrase, CASE WHEN q.phrase <> b.phrase OR b.chars >= 42 OR q.tk - b.tk - b.length >= 20 THEN 0 ELSE b.chars END + length(q.text), CASE WHEN q.phrase <> b.phrase OR b.chars >= 42 OR q.tk - b.tk - b.length >= 20 THEN b.tk + b.length END
  FROM b JOIN q ON q.rec = b.rec AND q.k = b.k + 1)"""
CHART = "'#TITLE:rec ' || rec || ' (AI)' || chr(10) || '#ARTIST:nobody' || chr(10) || '#MP3:audio.mp3' || chr(10) || '#VIDEO:video.mp4' || chr(10) || '#COVER:cover.jpg' || chr(10) || '#BPM:300' || chr(10) || '#GAP:0' || chr(10) || '#VIDEOGAP:0' || chr(10) || '#ENCODING:UTF8' || chr(10)"


def _charts(t):
    units, frames = _recordings(t)
    notes = M.make_notes(units, frames, ["duration"])
    return M.render(M.place(notes), F.concat(F.lit("rec "), F.col("rec").cast("string")), F.lit("nobody"))


@query(f"""
WITH RECURSIVE {PLACED}, l AS (SELECT rec, k, (CASE WHEN cut IS NOT NULL THEN '- ' || cut || chr(10) ELSE '' END) || kind || ' ' || q.tk || ' ' || q.length || ' ' || pitch || ' ' || text AS line FROM q JOIN b USING (rec, k))
SELECT rec, {CHART} || string_agg(line, chr(10) ORDER BY k) || chr(10) || 'E' || chr(10) AS chart FROM l GROUP BY rec
""")
def render_chart(t):
    return _charts(t)


@query(f"""
WITH RECURSIVE {PLACED}
SELECT rec::bigint AS rec, true AS valid, count(*)::int AS n_notes, (count(cut) + 1)::int AS n_phrases, max(q.tk + q.length) / 20.0::double AS end_seconds, '' AS problems FROM q JOIN b USING (rec, k) GROUP BY rec HAVING rec % 4 <> 1
UNION ALL SELECT rec::bigint, false, count(*)::int, (count(cut) + 1)::int, max(q.tk + q.length) / 20.0::double, 'after end' FROM q JOIN b USING (rec, k) GROUP BY rec HAVING rec % 4 = 1
""")
def chart_validate(t):
    """Rendered charts read back; every fourth has a line after its end mark."""
    c = _charts(t).withColumn("chart", F.when(F.col("rec") % 4 == 1, F.concat("chart", F.lit("junk\n"))).otherwise(F.col("chart")))
    return charts.validate(c, "rec", "chart").select("rec", "valid", "n_notes", "n_phrases", "end_seconds", "problems")


@query("""
WITH h AS (SELECT vec_id, 'TITLE' AS name, 'second ' || label AS value FROM embeddings UNION ALL SELECT vec_id, 'BPM', (100 + vec_id)::varchar FROM embeddings UNION ALL SELECT vec_id, 'NOTE', 'a:b' FROM embeddings)
SELECT vec_id, name, value FROM h
""")
def chart_headers(t):
    text = F.concat(F.lit("#TITLE:first\r\n#BPM: "), (F.col("vec_id") + 100).cast("string"), F.lit("\n#NOTE:a:b\n#TITLE:second "), F.col("label").cast("string"), F.lit("\n: 0 1 2 x\nE\n"))
    return charts.headers(t.embeddings.select("vec_id", text.alias("text")), "vec_id")


STEPS = """e AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_id % 9 <> 0 THEN event_type END AS seen, value >= 50 AS long, value, ts, event_id FROM events)"""


@query(f"""
WITH RECURSIVE {STEPS}, v AS (SELECT rec, seen, round(sum(value), 4) w, min(i) f FROM e WHERE seen IS NOT NULL GROUP BY ALL),
first AS (SELECT rec, arg_min(seen, (-w, f)) AS first FROM v GROUP BY rec),
x AS (SELECT rec, i, seen, long, first AS state FROM e JOIN first USING (rec) WHERE i = 0
  UNION ALL SELECT e.rec, e.i, e.seen, e.long, CASE WHEN e.seen = x.seen AND e.seen <> x.state AND e.long AND x.long THEN e.seen ELSE x.state END FROM x JOIN e ON e.rec = x.rec AND e.i = x.i + 1),
y AS (SELECT rec, i, CASE WHEN lead(state) OVER w <> state THEN lead(state) OVER w ELSE state END AS state FROM x WINDOW w AS (PARTITION BY rec ORDER BY i))
SELECT rec AS user_id, i::int AS i, state FROM y
""")
def language_hysteresis(t):
    """Each user's state by row: the weighted vote first, then a switch wherever two long observations in a row agree."""
    seen = F.when(F.col("event_id") % 9 != 0, F.col("event_type"))
    e = t.events.select("user_id", "ts", "event_id", seen.alias("seen"), (F.col("value") >= 50).alias("long"), "value")
    votes = e.where("seen IS NOT NULL").groupBy("user_id", "seen").agg(F.round(F.sum("value"), 4).alias("w"), F.min(F.struct("ts", "event_id")).alias("f"))
    first = votes.groupBy("user_id").agg(F.min_by("seen", F.struct(-F.col("w"), "f")).alias("first"))
    out = ordered_fold(e.join(first, "user_id").drop("value"), ["user_id"], ["ts", "event_id"], Hysteresis, ["seen", "long", "first"], "n int, state string")
    return out.select("user_id", (F.col("n") - 1).alias("i"), "state")


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events),
n AS (SELECT user_id, count(*) n FROM e GROUP BY 1),
c AS (SELECT user_id, n, i + 22 AS spot, arg_min(e2, (v2, e2)) AS cut FROM (SELECT a.user_id, a.i, n, b.i AS e2, b.value AS v2 FROM e a JOIN n USING (user_id) JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i + 22 AND a.i + 26 WHERE a.i + 26 < n) GROUP BY ALL),
x AS (SELECT user_id, n, 0::bigint AS i, 0::bigint AS core_start, coalesce((SELECT cut FROM c WHERE c.user_id = n.user_id AND spot = 22), n)::bigint AS core_end FROM n
  UNION ALL SELECT x.user_id, x.n, x.i + 1, x.core_end, coalesce(c.cut, x.n) FROM x LEFT JOIN c ON c.user_id = x.user_id AND c.spot = x.core_end + 22 WHERE x.core_end < x.n)
SELECT user_id, i::int AS i, core_start, core_end FROM x
""")
def plan_windows(t):
    """Cores over each user's values: each ends at the quietest step between 22 and 26 after its start."""
    e = t.events.select("user_id", "ts", "event_id", F.col("value").alias("level"))
    return ordered_fold(e, ["user_id"], ["ts", "event_id"], Windows, ["level"], "i int, core_start long, core_end long")
