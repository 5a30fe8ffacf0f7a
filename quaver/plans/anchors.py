"""Known texts against what was heard, over conversations, with SQL for all that follows the blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import text as X
from quaver.operators import anchors as A
from quaver.plans.base import query

#: Every conversation is a recording: its turns are the lines; their words, in plain letters and numbered (so that blocks
#: are known), are heard for half a second each from second 5 on, an eighth of a second late by turns, and every seventh is misheard.
SAID = r"""
w0 AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS p FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS j, regexp_replace(lower(word), '[^a-z]', '', 'g') || 'n' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1) AS word FROM w0),
h AS (SELECT *, j % 7 <> 6 AS heard, length(word) AS c, 5 + 0.5 * j + (j % 3) * 0.125 AS start, 5.5 + 0.5 * j AS stop FROM w)"""


def _recordings(t):
    """(recordings, lines, words), as SAID says."""
    every = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    c = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(every).alias("p", "word"))
    said = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "p", "word"))).alias("w"))
    numbered = said.select(F.col("conv_id").alias("rec"), F.size("w").alias("n"), F.posexplode("w").alias("j", "x")).select("rec", "n", "j", F.col("x.turn").alias("turn"), F.concat(F.regexp_replace(F.lower("x.word"), "[^a-z]", ""), F.lit("n"), F.col("j").cast("string")).alias("word"))
    lines = numbered.groupBy("rec", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "word"))), lambda x: x["word"]), " ").alias("text"), F.min("j").alias("first"), F.max("j").alias("last"))
    words = numbered.select("rec", "j", F.when(F.col("j") % 7 == 6, "\u03c9\u03c9").otherwise(F.col("word")).alias("word"), (5 + F.col("j") * 0.5 + (F.col("j") % 3) * 0.125).cast("double").alias("start"), (5.5 + F.col("j") * 0.5).cast("double").alias("stop"))
    recordings = said.select(F.col("conv_id").alias("rec"), (5 + F.size("w") * 0.5).cast("double").alias("duration"))
    return recordings, lines.withColumn("i", F.col("turn").cast("int")), words


@query(f"""
WITH {SAID},
r AS (SELECT conv_id, j // 7 AS r, sum(c) >= 3 AS long FROM h WHERE heard GROUP BY 1, 2),
x AS (SELECT h.*, heard AND coalesce(long, false) AS hit FROM h LEFT JOIN r ON r.conv_id = h.conv_id AND r.r = h.j // 7),
l0 AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n_words, min(j) AS f, max(j) AS e, sum(c) AS len, coalesce(sum(c) FILTER (hit), 0) AS hits, arg_min(start, j) FILTER (hit) AS a_first, arg_max(stop, j) FILTER (hit) AS a_last FROM x GROUP BY ALL),
l1 AS (SELECT conv_id, turn, text, n_words, conv_id % 2 = 0 AS timed, 0.5 * f AS given, CASE WHEN hits >= greatest(3, 0.6 * len) THEN a_first END AS first, a_last, (SELECT 5 + 0.5 * count(*) FROM h WHERE h.conv_id = l0.conv_id) AS duration, CASE WHEN conv_id % 3 = 0 THEN 'provider' ELSE 'user' END AS source FROM l0),
g AS (SELECT conv_id, list_sort(list(first - given) FILTER (timed AND first IS NOT NULL)) AS gs FROM l1 GROUP BY 1),
m0 AS (SELECT conv_id, coalesce(gs, []) AS gs, CASE WHEN len(gs) >= 2 THEN gs[len(gs) // 2 + 1] ELSE 0 END AS middle FROM g),
m AS (SELECT conv_id, CASE WHEN len(list_filter(gs, lambda v: abs(v - middle) > 3)) > 0 THEN 0 ELSE middle END AS moved FROM m0),
l2 AS (SELECT *, CASE WHEN timed THEN given + moved END AS want, CASE WHEN NOT timed OR abs(first - given - moved) <= 3 THEN first END AS anchor FROM l1 JOIN m USING (conv_id)),
l3 AS (SELECT *, timed AND coalesce(bool_or(s >= nxt) OVER (PARTITION BY conv_id), false) AS falls FROM (SELECT *, coalesce(anchor, want) AS s, lead(coalesce(anchor, want)) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM l2)),
l4 AS (SELECT * EXCLUDE (s, anchor, nxt), CASE WHEN NOT falls THEN anchor END AS anchor, CASE WHEN falls THEN want ELSE s END AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM l3),
l5 AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN k END IGNORE NULLS) OVER b AS bk, last_value(s IGNORE NULLS) OVER b AS bt, first_value(CASE WHEN s IS NOT NULL THEN k END IGNORE NULLS) OVER a AS ak, first_value(s IGNORE NULLS) OVER a AS at_ FROM l4 WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l6 AS (SELECT * EXCLUDE (s), coalesce(s, coalesce(bt, 0) + (coalesce(at_, duration) - coalesce(bt, 0)) * (k - coalesce(bk, 1)) / nullif(coalesce(ak, n + 1) - coalesce(bk, 1), 0)) AS s, bool_or(anchor IS NOT NULL) OVER (PARTITION BY conv_id) AS any_ FROM l5),
l7 AS (SELECT *, greatest(0, s) AS start, CASE WHEN anchor IS NOT NULL THEN least(duration, coalesce(lead(s) OVER o, duration), a_last + 0.3) ELSE least(duration, coalesce(lead(s) OVER o, duration)) END AS stop FROM l6 WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
l8 AS (SELECT *, CASE WHEN NOT timed AND NOT any_ AND source <> 'user' THEN 'no anchors' WHEN source = 'user' AND bool_or(stop <= start) OVER p THEN 'lines overlap' WHEN NOT bool_or(stop > start) OVER p THEN 'no line fits' END AS problem FROM l7 WINDOW p AS (PARTITION BY conv_id)),
o AS (SELECT conv_id, turn::int AS i, start, stop, text, anchor IS NOT NULL AS anchored, true AS external, n_words, moved, duration, source FROM l8 WHERE problem IS NULL AND stop > start),
u0 AS (SELECT h.conv_id, h.j, CASE WHEN heard THEN word ELSE 'ωω' END AS word, h.start, h.stop, NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id = h.conv_id AND h.start < o.stop AND h.stop > o.start) AS free FROM h WHERE conv_id IN (SELECT conv_id FROM o WHERE source = 'provider')),
u1 AS (SELECT *, sum((NOT free)::int) OVER (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS run FROM u0),
u AS (SELECT conv_id, -1 AS i, arg_min(start, j) AS start, arg_max(stop, j) AS stop, string_agg(word, '' ORDER BY j) AS text, false AS anchored, false AS external, count(*) AS n_words FROM u1 WHERE free GROUP BY conv_id, run),
a AS (SELECT conv_id, i, start, stop, text, anchored, external, n_words, moved, duration FROM o UNION ALL SELECT u.*, d.moved, d.duration FROM u JOIN (SELECT conv_id, any_value(moved) AS moved, any_value(duration) AS duration FROM o GROUP BY 1) d USING (conv_id))
SELECT conv_id, i, text, 'en' AS language, anchored, external, n_words::int AS n_words, NULL::varchar AS problem, round(start, 6)::double AS start, round(stop, 6)::double AS stop,
  round(greatest(0, start - 2, (lag(stop) OVER b + start) / 2), 6)::double AS window_start, round(least(duration, stop + 2, (stop + coalesce(lead(start) OVER b, duration)) / 2), 6)::double AS window_stop, round(moved, 6)::double AS moved FROM a WINDOW b AS (PARTITION BY conv_id ORDER BY start, i)
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, NULL, NULL, NULL, problem, NULL, NULL, NULL, NULL, NULL FROM l8 WHERE problem IS NOT NULL
""")
def compose_lines(t):
    """Turns placed by what is heard: times that lie 5 s early for even conversations, none at all for odd ones."""
    recordings, lines, words = _recordings(t)
    recordings = recordings.withColumns({"source": F.when(F.col("rec") % 3 == 0, "provider").otherwise("user"), "language": F.lit(None).cast("string"), "heard_language": F.lit("en")})
    lines = lines.select("rec", "i", "text", F.when(F.col("rec") % 2 == 0, F.col("first") * 0.5).cast("double").alias("start"))
    out = A.compose(recordings, lines, words)
    return out.select(F.col("rec").alias("conv_id"), "i", "text", "language", "anchored", "external", "n_words", "problem", *[F.round(c, 6).alias(c) for c in ("start", "stop", "window_start", "window_stop", "moved")])


@query(f"""
WITH {SAID}, l AS (SELECT conv_id, turn, bool_and(heard) AS ok, min(j) AS f, max(j) AS e FROM h GROUP BY ALL),
x AS (SELECT l.conv_id, unnest([abs(a.start - 0.5 * f), abs(z.stop - 0.5 * (e + 1))]) AS err FROM l JOIN h a ON a.conv_id = l.conv_id AND a.j = f JOIN h z ON z.conv_id = l.conv_id AND z.j = e WHERE ok),
s AS (SELECT conv_id, list_sort(list(err)) AS es FROM x GROUP BY 1)
SELECT n.conv_id, n.n_lines, coalesce(len(es) // 2, 0)::int AS n_matched, round(coalesce(len(es) // 2, 0) / n.n_lines, 6) AS coverage, round(es[len(es) // 2 + 1], 6)::double AS median_error, round(es[ceil(95 * len(es) / 100)::bigint], 6)::double AS p95_error
FROM (SELECT conv_id, count(*)::int AS n_lines FROM l GROUP BY 1) n LEFT JOIN s USING (conv_id)
""")
def line_timing(t):
    """Errors of the turns' edges against what is heard, which lies 5 s late."""
    recordings, lines, words = _recordings(t)
    lines = lines.select("rec", "i", "text", (F.col("first") * 0.5).cast("double").alias("start"), ((F.col("last") + 1) * 0.5).cast("double").alias("stop"))
    out = A.line_errors(recordings, lines, words, lambda c: X.units(c, F.lit("en")))
    return out.select(F.col("rec").alias("conv_id"), "n_lines", "n_matched", *[F.round(c, 6).alias(c) for c in ("coverage", "median_error", "p95_error")])


@query(None)
def sequence_match(t):
    """Blocks of equal words of every text and benchmark item that share a run of five."""
    return A.match_items(t.documents, t.benchmark)
