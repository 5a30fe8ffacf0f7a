"""Text, signal and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import rules as R
from quaver.functions import signals as G
from quaver.functions import text as X
from quaver.plans.base import query


@query(r"""
SELECT doc_id, len(regexp_extract_all(replace(lower(text), '’', ''''), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*')) AS n_units,
  length(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS n_normal, length(regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g')) AS n_compare,
  len(regexp_extract_all(replace(lower(text), 'auld', 'old'), '[\p{L}\p{N}_]+')) AS n_excerpt,
  CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[가-힯]') THEN 'ko' ELSE lang END AS script
FROM documents
""")
def text_units(t):
    c = F.col("text")
    n = lambda x: x.cast("long")
    return t.documents.select("doc_id", n(F.size(X.units(c, F.lit("en")))).alias("n_units"), n(F.length(X.normalized(c))).alias("n_normal"), n(F.length(X.comparison(c))).alias("n_compare"), n(F.size(X.excerpt_words(c))).alias("n_excerpt"), F.coalesce(X.script(c), "lang").alias("script"))


@query("SELECT c_custkey, levenshtein(lower(c_name), lower(p_name)) AS distance FROM customer JOIN part ON c_custkey = p_partkey")
def char_edit_distance(t):
    return t.customer.join(t.part, F.col("c_custkey") == F.col("p_partkey")).select("c_custkey", F.levenshtein(F.lower("c_name"), F.lower("p_name")).cast("long").alias("distance"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/@?#]+/') THEN 'https://' || regexp_replace(regexp_extract(url, '^https://([^/?#]+)', 1), '^(www|m)\.', '') || regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) END AS canonical,
       regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages
""")
def url_canonical(t):
    u = F.col("url")
    host = F.regexp_replace(F.regexp_extract(u, r"^https://([^/?#]+)", 1), r"^(www|m)\.", "")
    canonical = F.when(u.rlike(r"^https://[^/@?#]+/"), F.concat(F.lit("https://"), host, F.regexp_extract(u, r"^https://[^/?#]+(/[^?#]*)", 1)))
    return t.pages.select("page_id", canonical.alias("canonical"), F.regexp_extract(u, r"/([0-9]+)", 1).alias("number"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 6) AS rms FROM embeddings")
def frame_rms(t):
    return t.embeddings.select("vec_id", F.round(G.rms(F.col("embedding")), 6).alias("rms"))


@query("""
WITH f AS (SELECT vec_id, i, embedding[greatest(1, i * 8 - 7):least(len(embedding), i * 8 + 8)] b FROM (SELECT *, unnest(range(0, ceil(len(embedding) / 8)::bigint)) i FROM embeddings))
SELECT vec_id, i AS frame, round(sqrt(list_sum(list_transform(b, lambda x: x::double * x::double)) / len(b)), 6) AS rms FROM f
""")
def sliding_rms(t):
    f = t.embeddings.select("vec_id", F.posexplode(F.transform(G.frames(F.col("embedding"), 16, 8), G.rms)).alias("frame", "rms"))
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("rms", 6).alias("rms"))


@query("""
WITH b AS (SELECT vec_id, i, round(sqrt(list_sum(list_transform(embedding[i * 4 + 1:i * 4 + 4], lambda x: x::double * x::double)) / 4), 6) l
           FROM (SELECT *, unnest(range(0, len(embedding) // 4)) i FROM embeddings)),
f AS (SELECT *, l > greatest(1e-6, 0.8 * max(l) OVER (PARTITION BY vec_id)) a FROM b),
g AS (SELECT *, sum((NOT a)::int) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) k FROM f),
r AS (SELECT vec_id, k, count(*) FILTER (a) n FROM g GROUP BY ALL)
SELECT vec_id, sum(n)::bigint AS n_active, max(n) AS longest FROM r GROUP BY vec_id
""")
def activity(t):
    levels = F.transform(G.blocks(F.col("embedding"), 4), lambda b: F.round(G.rms(b), 6))
    flags = G.active_blocks(levels, share=0.8)
    return t.embeddings.select("vec_id", flags.alias("f")).select("vec_id", F.size(F.filter("f", lambda x: x)).cast("long").alias("n_active"), G.longest_run(F.col("f")).cast("long").alias("longest"))


@query("""
SELECT event_id, CASE WHEN value > 0 THEN (round_even(69 + 12 * log2(value / 440), 0) - 60)::int END AS pitch, greatest(0, round_even(20 * value, 0)::int) AS ticks,
       CASE WHEN value > 0 THEN round(abs(1200 * log2(value / 440)), 4) END AS cents FROM events
""")
def hz_pitch_ticks(t):
    v = F.col("value")
    return t.events.select("event_id", G.pitch(v).alias("pitch"), G.ticks(v).alias("ticks"), F.round(G.cents(v, F.lit(440.0)), 4).alias("cents"))


@query("SELECT doc_id, sha256(text) AS fingerprint, strlen(text) AS n_bytes FROM documents")
def fingerprint(t):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""
WITH h AS (SELECT source, ('0x' || substr(md5(doc_id || '|' || text), 1, 15))::bigint AS a, ('0x' || substr(md5(doc_id || '|' || text), 17, 15))::bigint AS b FROM documents)
SELECT source, (sum(a) % 1000000000000000003)::varchar AS total, bit_xor(b) AS crossed, count(*) AS n FROM h GROUP BY 1
""")
def set_digest(t):
    """One digest for each source's set of texts, the same for any order of rows: a sum and an exclusive or of two halves of
    each row's hash, combined on the map side."""
    h = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text").cast("binary"))
    half = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("long")
    d = t.documents.select("source", half(1).cast("decimal(28,0)").alias("a"), half(17).alias("b")).groupBy("source").agg(F.sum("a").alias("a"), F.bit_xor("b").alias("crossed"), F.count(F.lit(1)).alias("n"))
    return d.select("source", (F.col("a") % F.lit(1000000000000000003).cast("decimal(28,0)")).cast("string").alias("total"), "crossed", "n")


@query(r"""
SELECT p_partkey, CASE WHEN n = '' THEN 'untitled' ELSE n END AS file, CASE WHEN p_retailprice >= 1000 THEN format('{:.1f} GB', floor(p_retailprice / 100) / 10) ELSE format('{:.0f} MB', floor(p_retailprice)) END AS size,
  (p_size // 60)::varchar || ':' || lpad((p_size % 60)::varchar, 2, '0') AS clock
FROM (SELECT *, regexp_replace(substr(regexp_replace(p_type || '/' || p_name || '?', '[<>:"/\\|?*]', '_', 'g'), 1, 120), '^[ .]+|[ .]+$', '', 'g') n FROM part)
""")
def labels_and_names(t):
    p = t.part
    return p.select("p_partkey", R.safe_name(F.concat("p_type", F.lit("/"), "p_name", F.lit("?")), "untitled", 120).alias("file"), X.bytes_label(F.when(F.col("p_retailprice") >= 1000, F.floor(F.col("p_retailprice") / 100) * 1e8).otherwise(F.floor("p_retailprice") * 1e6)).alias("size"), X.clock_label(F.col("p_size")).alias("clock"))


@query(r"""
SELECT conv_id, turn, replace(replace(replace(trim(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g')), 'x', 'X'), '  ', ' '), '  ', ' ') AS cleaned, CASE WHEN turn % 2 = 0 THEN replace(trim(string_split(text, ' ')[1]) || trim(coalesce(string_split(text, ' ')[2], '')), ' ', '') ELSE trim(trim(string_split(text, ' ')[1]) || ' ' || trim(coalesce(string_split(text, ' ')[2], ''))) END AS joined
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN chr(7) || text || chr(9) || chr(127) ELSE text END AS text FROM conversations WHERE text IS NOT NULL)
""")
def clean_and_join(t):
    """Turns, every third one with control characters around it, cleaned, and their first two words joined as each language does."""
    odd = F.concat(F.lit("\x07"), "text", F.lit("\x09\x7f"))
    c = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, odd).otherwise(F.col("text")).alias("text"))
    tidy = F.replace(F.replace(F.replace(X.clean(F.col("text")), F.lit("x"), F.lit("X")), F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" "))
    words = F.slice(F.split("text", " "), 1, 2)
    return c.select("conv_id", "turn", tidy.alias("cleaned"), X.join_words(words, F.when(F.col("turn") % 2 == 0, "ja").otherwise("en")).alias("joined"))
