"""Rules over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import rules as R
from quaver.plans.base import micros, query

#: An event as a timed word: seconds of its day, a length that may be negative, NaN or infinite.
TIMED = """w AS (SELECT event_id, user_id, epoch_us(ts) // 86400000000 AS day, (epoch_us(ts) % 86400000000) / 1e6 AS start,
  CASE WHEN event_id % 50 = 0 THEN 'NaN'::double WHEN event_id % 50 = 1 THEN 'Infinity'::double ELSE (epoch_us(ts) % 86400000000) / 1e6 + value - 40 END AS stop, event_type, value FROM events),
v AS (SELECT *, NOT isnan(stop) AND NOT isinf(stop) AND start < stop AND start >= 3600 AND stop <= 86400 + 0.02 AS ok FROM w)"""


def _timed(t):
    at = (micros("ts") % 86400000000) / 1e6
    stop = F.when(F.col("event_id") % 50 == 0, float("nan")).when(F.col("event_id") % 50 == 1, float("inf")).otherwise(at + F.col("value") - 40)
    return t.events.select("event_id", "user_id", F.floor(micros("ts") / 86400000000).alias("day"), at.alias("start"), stop.alias("stop"), "event_type", "value")


@query(f"WITH {TIMED} SELECT event_id, ok AS valid FROM v")
def interval_validity(t):
    return _timed(t).select("event_id", R.valid_time(F.col("start"), F.col("stop"), F.lit(3600.0), F.lit(86400.0)).alias("valid"))


@query(f"""
WITH {TIMED}, o AS (SELECT *, ok AND event_type <> 'signup' AND (event_id % 5 <> 0 OR start + value - 45 > start) AS good, start < lag(start) OVER (PARTITION BY user_id, day ORDER BY value, event_id) AS falls FROM v)
SELECT user_id, day::bigint AS day, count(*) AS n, bool_and(good) AND NOT bool_or(coalesce(falls, false)) AS valid FROM o GROUP BY ALL
""")
def word_sequences(t):
    """A user's day as words in the order of their values; some words say nothing, some have a character of their own."""
    rows = _timed(t)
    chars = F.when(F.col("event_id") % 5 == 0, F.array(F.struct("start", (F.col("start") + F.col("value") - 45).alias("stop")))).otherwise(F.array().cast("array<struct<start:double,stop:double>>"))
    word = F.struct("value", "event_id", F.when(F.col("event_type") == "signup", " . ").otherwise(F.col("event_type")).alias("word"), "start", "stop", chars.alias("chars"))
    g = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(word)).alias("w"))
    return g.select("user_id", F.col("day").cast("long").alias("day"), F.size("w").cast("long").alias("n"), R.valid_words(F.col("w"), F.lit(3600.0), F.lit(86400.0)).alias("valid"))


@query("""
WITH x AS (SELECT event_id, value / 500 AS silence, CASE WHEN event_id % 40 = 0 THEN 'NaN'::double ELSE -value / 300 END AS logprob, 1 + value / 200 AS density,
  CASE WHEN event_id % 11 = 0 THEN []::double[] WHEN event_id % 13 = 0 THEN [0.9, 'Infinity'::double] ELSE [0.9, 0.45 + value / 1000] END AS chances, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE event_type END AS text FROM events)
SELECT event_id, CASE WHEN isnan(logprob) OR len(list_filter(chances, lambda p: isinf(p))) > 0 THEN true ELSE silence > 0.7 OR logprob < -0.8 OR density > 2.4 OR len(chances) = 0 OR len(list_filter(chances, lambda p: p < 0.5)) > 0 END AS retry,
  trim(text) <> '' AND NOT isnan(logprob) AND silence <= 0.7 AND logprob >= -1.5 AS keeps FROM x
""")
def retry_rule(t):
    v, i = F.col("value"), F.col("event_id")
    lp = F.when(i % 40 == 0, float("nan")).otherwise(-v / 300)
    chances = F.when(i % 11 == 0, F.array().cast("array<double>")).when(i % 13 == 0, F.array(F.lit(0.9), F.lit(float("inf")))).otherwise(F.array(F.lit(0.9), 0.45 + v / 1000))
    text = F.when(i % 17 == 0, "  ").otherwise(F.col("event_type"))
    return t.events.select("event_id", R.needs_retry(v / 500, lp, 1 + v / 200, chances).alias("retry"), R.keeps_hypothesis(text, v / 500, lp).alias("keeps"))


CANDIDATES = """c AS (SELECT doc_id // 4 AS passage, doc_id AS n, CASE WHEN doc_id % 23 = 0 THEN '--' WHEN doc_id // 4 % 3 = 0 THEN lang ELSE upper(lang) || (n_chars % 2) END AS text, doc_id % 3 = 0 AS q, source, n_chars % 19 = 0 AS truncated, doc_id % 5 = 0 AS estimated,
  (n_chars % 30) / 10.0 AS uncovered, (n_chars % 7) / 7.0 AS coverage, (n_chars % 5) / 5.0 AS score, CASE WHEN doc_id % 2 = 0 THEN 'original.wav' ELSE 'vocals.wav' END AS audio FROM documents),
k AS (SELECT *, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS plain FROM c)"""


def _candidates(t):
    i, n = F.col("doc_id"), F.col("n_chars")
    text = F.when(i % 23 == 0, "--").when(F.floor(i / 4) % 3 == 0, F.col("lang")).otherwise(F.concat(F.upper("lang"), (n % 2).cast("string")))
    return t.documents.select(F.floor(i / 4).alias("passage"), i.alias("n"), text.alias("text"), (i % 3 == 0).alias("q"), (n % 19 == 0).alias("truncated"), (i % 5 == 0).alias("estimated"), ((n % 30) / 10.0).alias("uncovered"), ((n % 7) / 7.0).alias("coverage"), ((n % 5) / 5.0).alias("score"), F.when(i % 2 == 0, "original.wav").otherwise("vocals.wav").alias("audio"))


@query(f"WITH {CANDIDATES} SELECT passage::bigint AS passage, count(*) AS n, count(*) < 2 OR count(DISTINCT plain) <> 1 OR bool_and(plain = '') OR bool_or(truncated OR estimated OR uncovered >= 2) AS recover FROM k GROUP BY passage")
def recovery_rule(t):
    g = _candidates(t).groupBy("passage").agg(F.collect_list(F.struct("text", "truncated", "estimated", "uncovered")).alias("c"))
    return g.select("passage", F.size("c").cast("long").alias("n"), R.needs_recovery(F.col("c")).alias("recover"))


@query(f"""
WITH {CANDIDATES}, u AS (SELECT * FROM k WHERE plain <> '' AND NOT truncated),
f AS (SELECT passage, plain, count(DISTINCT q) AS families, count(DISTINCT audio) AS audios, count(*) AS agree FROM u GROUP BY ALL),
r AS (SELECT u.*, families, audios, agree, count(*) OVER (PARTITION BY u.passage) AS usable, row_number() OVER (PARTITION BY u.passage ORDER BY families DESC, audios DESC, estimated, round(coverage, 2) DESC, round(score, 2) DESC, (q AND audio = 'original.wav') DESC, n) AS place FROM u JOIN f USING (passage, plain)),
t AS (SELECT passage, count(*) AS texts FROM f GROUP BY 1)
SELECT p.passage::bigint AS passage, r.n AS winner, coalesce(estimated OR uncovered >= 2 OR NOT (families > 1 OR agree > 1) OR (texts > 1 AND families <= 1), true) AS uncertain
FROM (SELECT DISTINCT passage FROM k) p LEFT JOIN r ON r.passage = p.passage AND place = 1 LEFT JOIN t ON t.passage = p.passage
""")
def candidate_winner(t):
    """Of each passage's candidates the one that most families and recordings agree on; the first wins ties."""
    from quaver.operators.evaluation import choose_candidate

    return choose_candidate(_candidates(t).withColumn("family", F.when(F.col("q"), "qwen").otherwise("whisper")), "passage").select("passage", F.col("n").alias("winner"), "uncertain")


@query(f"""
WITH {TIMED} SELECT event_id, event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 7 <> 0 AND event_id % 10 <> 0 AND ok AND event_id % 50 > 1 AS reusable FROM v
""")
def reuse_rule(t):
    i = F.col("event_id")
    words = F.array(F.struct(F.col("event_type").alias("word"), "start", "stop", F.lit(None).cast("array<struct<start:double,stop:double>>").alias("chars"), (i % 10 == 0).alias("estimated")))
    out = R.reusable((i % 3).cast("string"), F.when(i % 3 == 0, "9").otherwise((i % 3).cast("string")), i % 4 == 0, F.when(i % 7 == 0, F.lit(None).cast("boolean")).otherwise(False), words, F.lit(3600.0), F.lit(86400.0))
    return _timed(t).select("event_id", out.alias("reusable"))


MESSAGES = ["CUDA Out Of Memory here", "op is Not Supported on MPS device", "plain failure", "std::bad_alloc", "Metal device lost", "exit", "Failed to allocate 3", "hardware accelerator gone"]


@query(f"""
WITH m AS (SELECT event_id, {MESSAGES!r}[event_id % 8 + 1] AS message, CASE WHEN event_id % 3 = 0 THEN 'cpu' ELSE 'mps' END AS backend, CASE WHEN event_id % 10 = 0 THEN -9 ELSE 1 END AS code FROM events)
SELECT event_id, CASE WHEN code IN (-9, -6) OR regexp_matches(lower(message), 'out of memory|cannot allocate|memoryerror|bad_alloc|failed to allocate') THEN 'memory'
  WHEN backend <> 'cpu' AND regexp_matches(lower(message), 'not supported|unsupported|mps device|metal device|hardware accelerator') THEN 'backend' ELSE 'application' END AS kind FROM m
""")
def failure_class(t):
    i = F.col("event_id")
    message = F.get(F.array(*[F.lit(x) for x in MESSAGES]), (i % 8).cast("int"))
    return t.events.select("event_id", R.failure_kind(message, F.when(i % 3 == 0, "cpu").otherwise("mps"), F.when(i % 10 == 0, -9).otherwise(1)).alias("kind"))


@query("""
WITH m AS (SELECT p_partkey, p_size::bigint * 1073741824 AS total, (p_partkey % 9)::bigint * 1073741824 // 2 AS free, p_partkey % 5 = 0 AS reduced FROM part),
b AS (SELECT *, CASE WHEN total < 12 * 1073741824::bigint THEN 8 WHEN total < 24 * 1073741824::bigint THEN 16 ELSE 32 END AS b FROM m)
SELECT p_partkey, CASE WHEN free < greatest(2 * 1073741824::bigint, total // 4) OR reduced THEN greatest(4, b // 2) ELSE b END::int AS batch, CASE WHEN free >= 1073741824 THEN total // 2 ELSE 0 END::bigint AS most FROM b
""")
def memory_profile(t):
    gib = F.lit(1 << 30).cast("long")
    batch, most = R.memory_profile(F.col("p_size").cast("long") * gib, F.floor((F.col("p_partkey") % 9) * gib / 2), F.col("p_partkey") % 5 == 0)
    return t.part.select("p_partkey", batch.cast("int").alias("batch"), most.alias("most"))


@query("""
SELECT event_id, CASE WHEN coalesce(event_id % 31 = 0, false) OR event_type = 'signup' THEN 'live' WHEN value * 5 > 1200 THEN 'long' WHEN event_type = 'purchase' THEN 'account' END AS rejected FROM events
""")
def media_rejection(t):
    e = F.col("event_type")
    live = F.when(F.col("event_id") % 31 == 0, True)
    return t.events.select("event_id", R.rejection(live, F.when(e == "signup", "is_live").otherwise("none"), F.col("value") * 5, F.when(e == "purchase", "private").otherwise("public")).alias("rejected"))


@query(r"""
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_brand || ' ' WHEN p_partkey % 5 = 1 THEN '  ' END AS credit, CASE WHEN p_partkey % 4 = 1 THEN [' ' || p_type, ' ', p_brand] ELSE []::varchar[] END AS credits,
  CASE WHEN p_partkey % 7 = 0 THEN p_name END AS tag, CASE WHEN p_partkey % 3 = 0 THEN 'Song / ' || p_brand || ' : Official Music Video ' ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type || ' - Topic' ELSE p_type END AS channel FROM part)
SELECT p_partkey, coalesce(nullif(trim(credit), ''), nullif(list_aggregate(list_filter(list_transform(credits, lambda x: trim(x)), lambda x: x <> ''), 'string_agg', ', '), ''), nullif(trim(tag), ''),
  CASE WHEN title LIKE '% : Official Music Video ' THEN trim(split_part(split_part(title, ' / ', 2), ':', 1)) END, CASE WHEN channel LIKE '% - Topic' THEN nullif(trim(replace(channel, ' - Topic', '')), '') END, 'Unknown Artist') AS artist FROM m
""")
def artist_resolution(t):
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    credit = F.when(k % 5 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(k % 5 == 1, "  ")
    credits = F.when(k % 4 == 1, F.array(F.concat(F.lit(" "), "p_type"), F.lit(" "), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    title = F.when(k % 3 == 0, F.concat(F.lit("Song / "), "p_brand", F.lit(" : Official Music Video "))).otherwise(F.col("p_name"))
    channel = F.when(k % 2 == 0, F.concat("p_type", F.lit(" - Topic"))).otherwise(F.col("p_type"))
    return t.part.select("p_partkey", R.artist(credit, credits, F.when(k % 7 == 0, F.col("p_name")), none, title, channel, none).alias("artist"))


@query("""
SELECT doc_id, concat_ws(';', CASE WHEN length(trim(source || repeat('x', (n_chars % 400)::int))) > 300 THEN 'title' END, CASE WHEN NOT regexp_full_match(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' || lang || ' ' WHEN doc_id % 3 = 1 THEN source ELSE '' END), '([a-z]{2,3})?') THEN 'language' END,
  CASE WHEN length(trim(text)) > 100000 THEN 'lyrics' END) AS problems FROM documents
""")
def settings_check(t):
    i = F.col("doc_id")
    language = F.when(i % 3 == 0, F.concat(F.lit(" "), "lang", F.lit(" "))).when(i % 3 == 1, F.col("source"))
    title = F.concat("source", F.repeat(F.lit("x"), (F.col("n_chars") % 400).cast("int")))
    return t.documents.select("doc_id", R.settings_problems(title, F.lit(None).cast("string"), language, F.col("text")).alias("problems"))


URLS = ["https://www.youtube.com/watch?v={}", "https://youtu.be/{}/", "https://music.youtube.com/embed/{}?x=1", "https://m.youtube.com:443/watch?a=b&v={}#t", "http://youtube.com/watch?v={}", "https://u:p@youtube.com/watch?v={}", "https://youtube.com/watch?v={}&list=PL1", "https://youtube.com:8443/watch?v={}", "https://example.com/watch?v={}", "https://youtube.com/playlist?v={}"]


@query(f"""
WITH u AS (SELECT p_partkey, lpad(p_partkey::varchar, CASE WHEN p_partkey % 13 = 0 THEN 10 ELSE 11 END, 'a_Z-') AS id, {URLS!r}[p_partkey % 10 + 1] AS form FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 < 4 AND length(id) = 11 THEN 'https://www.youtube.com/watch?v=' || id END AS canonical, CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN p_partkey END AS record FROM u
""")
def video_urls(t):
    k = F.col("p_partkey")
    id_ = F.lpad(k.cast("string"), 11, "a_Z-")
    id_ = F.when(k % 13 == 0, F.lpad(k.cast("string"), 10, "a_Z-")).otherwise(id_)
    form = F.get(F.array(*[F.lit(u) for u in URLS]), (k % 10).cast("int"))
    record = F.concat(F.when(k % 3 == 0, "https://lrclib.net/tracks/").when(k % 3 == 1, "https://lrclib.com/tracks/").otherwise("https://lrclib.net/other/"), k.cast("string"), F.when(k % 2 == 0, "/").otherwise(""))
    return t.part.select("p_partkey", R.video_url(F.replace(form, F.lit("{}"), id_)).alias("canonical"), R.provider_id(record).alias("record"))


@query(r"""
WITH r AS (SELECT c_custkey, ['kyō', 'rāmen', 'konnichiha', 'sha-shin', 'n', 'strr', 'gēmu'][c_custkey % 7 + 1] || lower(substr(c_mktsegment, 1, 4)) || CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE '' END AS t FROM customer),
d AS (SELECT c_custkey, replace(replace(replace(replace(replace(regexp_replace(t, '([aeiou])[-ー]', '\1\1', 'g'), 'ā', 'aa'), 'ī', 'ii'), 'ū', 'uu'), 'ē', 'ee'), 'ō', 'ou') AS d FROM r),
m AS (SELECT c_custkey, d, regexp_replace(d, '([aeiou])n($|[^aeiouy])', '\1' || chr(1) || '\2', 'g') AS x FROM d)
SELECT c_custkey, d AS doubled, len(regexp_extract_all(x, '[^aeiou]*[aeiou]|[^aeiou]+$')) > 0 AS has_units, replace(list_aggregate(regexp_extract_all(x, '[^aeiou\x01]*[aeiou]\x01?|[^aeiou]+$'), 'string_agg', '.'), chr(1), 'n') AS units FROM m
""")
def morae(t):
    """Units of romanised words; SQL without look-ahead marks the closing n beforehand."""
    k = F.col("c_custkey")
    word = F.get(F.array(*[F.lit(x) for x in ("kyō", "rāmen", "konnichiha", "sha-shin", "n", "strr", "gēmu")]), (k % 7).cast("int"))
    d = R.doubled_vowels(F.concat(word, F.lower(F.substring("c_mktsegment", 1, 4)), F.when(k % 2 == 0, "n").otherwise("")))
    return t.customer.select("c_custkey", d.alias("doubled")).select("c_custkey", "doubled", (F.size(R.morae(F.col("doubled"))) > 0).alias("has_units"), F.array_join(R.morae(F.col("doubled")), ".").alias("units"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(text, '[<>:"/\\|?*\x00-\x1f\x7f]', '_', 'g') AS x FROM documents),
c AS (SELECT doc_id, x, list_max(list_filter(range(0, 101), lambda k: strlen(substr(x, 1, k)) <= 100)) AS k FROM n)
SELECT doc_id, source || ' - ' || CASE WHEN y = '' THEN 'Unknown Song' ELSE y END AS name FROM (SELECT doc_id, source, regexp_replace(substr(x, 1, k), '^[ .]+|[ .]+$', '', 'g') AS y FROM c JOIN documents USING (doc_id))
""")
def download_names(t):
    named = R.download_name(F.col("source"), F.col("text"))
    return t.documents.select("doc_id", named.alias("name"))


@query("""
SELECT vec_id, i::int AS i, round((x - m) / greatest(s, 1e-6), 5) AS z FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::double AS x, list_avg(list_transform(embedding, lambda v: v::double)) AS m, list_stddev_samp(list_transform(embedding, lambda v: v::double)) AS s FROM embeddings)
""")
def normalise_signal(t):
    """Every sample less the mean, over the sample standard deviation."""
    from quaver.functions.signals import standardise

    x = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return x.select("vec_id", "i", F.round(standardise(["vec_id"], "x"), 5).alias("z"))
