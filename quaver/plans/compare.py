"""Comparison queries over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import compare as C
from quaver.operators import evaluation as E
from quaver.plans.base import days, query


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, arg_min(o_orderkey, o_orderkey) AS k, arg_min(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o.o_orderkey, f.k AS first_key, round(o.o_totalprice / f.p, 6) AS ratio FROM orders o LEFT JOIN f USING (o_custkey, o_orderpriority) WHERE o_orderstatus = 'O'
""")
def first_match(t):
    """Open orders against the first finished one of the same customer and priority."""
    o = t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    f = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    j = C.first_match(o, f, ["o_custkey", "o_orderpriority"], ["k"])
    return j.select("o_orderkey", F.col("match.k").alias("first_key"), F.round(F.col("o_totalprice") / F.col("match.p"), 6).alias("ratio"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::date) AS d, round(o_totalprice)::bigint AS p FROM orders WHERE o_orderstatus <> 'P')
SELECT a.o_custkey, count(*) AS pairs, sum(abs(a.d - b.d))::bigint AS days, min(abs(a.p - b.p)) AS closest, sum(CASE WHEN a.p > b.p THEN 1 ELSE 0 END)::bigint AS falls FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY 1
""")
def run_pairs(t):
    """Every pair of a customer's orders, with figures that need both rows of a pair."""
    r = t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", days("o_orderdate").cast("long").alias("d"), F.round("o_totalprice").cast("long").alias("p"))
    p = C.pairs_within(r, ["o_custkey"], "o_orderkey")
    gap = lambda c: F.abs(F.col("a." + c) - F.col("b." + c))
    return p.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(gap("d")).alias("days"), F.min(gap("p")).alias("closest"), F.count_if(F.col("a.p") > F.col("b.p")).alias("falls"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus s, round(o_totalprice)::bigint AS p FROM orders)
SELECT a.o_orderkey, count(*) AS n, round(median(abs(a.p - b.p)), 6) AS middle, sum((a.p >= b.p)::int)::bigint AS not_below FROM o a JOIN o b USING (o_custkey) WHERE a.s = 'O' AND b.s = 'F' GROUP BY 1
""")
def cross_within(t):
    """Every open order against every finished one of the customer."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice").cast("long").alias("p"))
    x = C.cross_within(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_custkey"])
    return x.groupBy(F.col("a.o_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.abs(F.col("a.p") - F.col("b.p"))), 6).alias("middle"), F.count_if(F.col("a.p") >= F.col("b.p")).alias("not_below"))


@query("""
WITH l AS (SELECT l_orderkey k, l_linenumber // 4 AS n, l_quantity q, l_orderkey // 2 AS h, l_orderkey % 2 AS side FROM lineitem),
a AS (SELECT h, list(n ORDER BY n, q) x FROM l WHERE side = 0 GROUP BY 1), b AS (SELECT h, list(n ORDER BY n, q) x FROM l WHERE side = 1 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, q) p FROM l)
SELECT e.h, count(*) AS n, round(median(abs(u.q - v.q)), 6) AS middle, round(quantile_cont(abs(u.q - v.q), 0.95), 6) AS p95, max(abs(u.q - v.q)) AS widest
FROM a e JOIN b ON b.h = e.h AND b.x = e.x JOIN r u ON u.h = e.h AND u.side = 0 JOIN r v ON v.h = e.h AND v.side = 1 AND v.p = u.p GROUP BY 1
""")
def side_by_side(t):
    """Lines of two neighbouring orders by place, where the labels (line number over 4) are the same."""
    l = t.lineitem.select(F.floor(F.col("l_orderkey") / 2).alias("h"), (F.col("l_orderkey") % 2).alias("side"), F.struct(F.floor(F.col("l_linenumber") / 4).alias("n"), F.col("l_quantity").alias("q")).alias("r"))
    side = lambda i, n: l.where(F.col("side") == i).groupBy("h").agg(F.array_sort(F.collect_list("r")).alias(n))
    rows = C.side_by_side(side(0, "a").join(side(1, "b"), "h"), "a", "b", "n").withColumn("d", F.abs(F.col("x.q") - F.col("y.q")))
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("d"), 6).alias("middle"), F.round(F.percentile("d", F.lit(0.95)), 6).alias("p95"), F.max("d").alias("widest"))


@query("""
WITH a AS (SELECT doc_id % 5 AS g, doc_id // 10 AS k, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id % 5 AS g, doc_id // 10 AS k, lang FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0),
x AS (SELECT g, k, count(*) l, min(lang) lv FROM a GROUP BY ALL), y AS (SELECT g, k, count(*) r, min(lang) rv FROM b GROUP BY ALL),
j AS (SELECT * FROM x FULL JOIN y USING (g, k))
SELECT g, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND lv IS DISTINCT FROM rv) AS unlike, count(*) FILTER (l > 1 OR r > 1) AS repeated,
  count(*) FILTER (r IS NULL) = 0 AND count(*) FILTER (l IS NULL) = 0 AND count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND lv IS DISTINCT FROM rv) = 0 AS same FROM j GROUP BY g
""")
def key_sets(t):
    d = t.documents.select("doc_id", (F.col("doc_id") % 5).alias("g"), F.floor(F.col("doc_id") / 10).alias("k"), "lang")
    return C.key_sets(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 OR doc_id % 10 = 0"), ["k"], ["lang"], ["g"])


#: Six pairs of runs over the documents of three languages: the first passes, each other one fails by its own rules.
GATE = """d AS (SELECT doc_id AS id, CASE lang WHEN 'fr' THEN 'es' WHEN 'de' THEN 'ja' ELSE lang END AS language, 5 + n_chars % 20 AS reference_units, n_chars % 9 AS deletions, n_chars % 4 AS insertions, n_chars % 5 AS substitutions FROM documents WHERE lang IN ('en', 'fr', 'de')),
b AS (SELECT g, id, language, reference_units, substitutions, deletions, insertions, substitutions + deletions + insertions AS errors FROM d, range(6) r(g)),
a AS (SELECT g, id, language, reference_units + CASE WHEN g = 1 AND id % 50 = 0 THEN 1 ELSE 0 END AS reference_units, CASE WHEN g = 2 THEN substitutions + 3 ELSE 0 END AS substitutions, CASE WHEN g = 3 THEN deletions ELSE deletions // 3 END AS deletions, insertions + CASE WHEN g = 4 THEN 1 ELSE 0 END AS insertions FROM b WHERE NOT (g = 5 AND id % 40 = 0)),
a2 AS (SELECT *, substitutions + deletions + insertions AS errors FROM a)"""


def _runs(t):
    code = F.when(F.col("lang") == "fr", "es").when(F.col("lang") == "de", "ja").otherwise(F.col("lang"))
    n = F.col("n_chars")
    d = t.documents.where(F.col("lang").isin("en", "fr", "de")).select(F.col("doc_id").alias("id"), code.alias("language"), (5 + n % 20).alias("reference_units"), (n % 9).alias("deletions"), (n % 4).alias("insertions"), (n % 5).alias("substitutions"))
    errors = (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors")
    b = d.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("*", errors)
    g = F.col("g")
    a = b.where(~((g == 5) & (F.col("id") % 40 == 0))).select(
        "g", "id", "language", (F.col("reference_units") + ((g == 1) & (F.col("id") % 50 == 0)).cast("int")).alias("reference_units"), F.when(g == 2, F.col("substitutions") + 3).otherwise(0).alias("substitutions"),
        F.when(g == 3, F.col("deletions")).otherwise(F.floor(F.col("deletions") / 3)).alias("deletions"), (F.col("insertions") + (g == 4).cast("int")).alias("insertions"),
    )
    return b, a.select("*", errors)


@query(f"""
WITH {GATE}, rb AS (SELECT g, language, sum(errors) / greatest(1, sum(reference_units)) r, sum(deletions) d, sum(insertions) i FROM b GROUP BY ALL), ra AS (SELECT g, language, sum(errors) / greatest(1, sum(reference_units)) r, sum(deletions) d, sum(insertions) i FROM a2 GROUP BY ALL),
s AS (SELECT g, 1 - (SELECT avg(r) FROM ra WHERE ra.g = x.g) / (SELECT avg(r) FROM rb WHERE rb.g = x.g) AS improvement, (SELECT count(*) FROM a WHERE a.g = x.g) AS na, (SELECT count(*) FROM b WHERE b.g = x.g) AS nb,
  (SELECT count(*) FROM b JOIN a USING (g, id) WHERE g = x.g AND b.reference_units <> a.reference_units) AS unlike, (SELECT sum(d) FROM ra WHERE ra.g = x.g) AS da, (SELECT sum(d) FROM rb WHERE rb.g = x.g) AS db, (SELECT sum(i) FROM ra WHERE ra.g = x.g) AS ia, (SELECT sum(i) FROM rb WHERE rb.g = x.g) AS ib,
  (SELECT string_agg('worse in ' || language, ';' ORDER BY language) FROM ra JOIN rb USING (g, language) WHERE g = x.g AND ra.r > rb.r) AS worse FROM range(6) x(g)),
t AS (SELECT g, improvement, concat_ws(';', CASE WHEN g = 4 THEN 'split' END, CASE WHEN g = 3 THEN 'profiles' END, CASE WHEN g = 5 THEN 'corpus' END, CASE WHEN na <> nb THEN 'recordings;once' END, CASE WHEN na <> nb OR unlike > 0 THEN 'references' END, CASE WHEN improvement < 0.3 THEN 'improvement' END, worse, CASE WHEN da >= db THEN 'deletions' END, CASE WHEN ia > ib THEN 'insertions' END) AS reasons FROM s)
SELECT g::int AS g, round(improvement, 6) AS improvement, reasons, reasons = '' AS passed FROM t
""")
def release_gate(t):
    b, a = _runs(t)
    g = F.col("g")
    runs = b.groupBy("g").agg(F.count_distinct("id").alias("n_frozen")).withColumns({"frozen": g != 4, "profiles": g != 3, "corpus": F.when(g == 5, F.lit(None).cast("boolean")).otherwise(True)})
    return C.release_gate(b, a, runs, "g").withColumn("improvement", F.round("improvement", 6))


@query("""
WITH g AS (SELECT l_orderkey, median(l_extendedprice) s FROM lineitem GROUP BY 1 HAVING count(*) = 3 AND count(DISTINCT l_linenumber) = 3 AND min(l_linenumber) = 1 AND max(l_linenumber) = 3)
SELECT l_orderkey, round(s, 6) AS seconds, round(o_totalprice / s, 6) AS ratio FROM g JOIN orders ON o_orderkey = l_orderkey WHERE s > 0
""")
def complete_runs(t):
    """Orders with exactly the lines 1, 2 and 3, against a stored figure of theirs."""
    g = C.complete_runs(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], "l_linenumber", "l_extendedprice")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return g.join(o, "l_orderkey").select("l_orderkey", F.round("seconds", 6).alias("seconds"), F.round(F.col("o_totalprice") / F.col("seconds"), 6).alias("ratio"))


@query("""
WITH w AS (SELECT p_partkey AS id, regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]', '', 'g') t, regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]', '', 'g') a, p_size::double AS d FROM part WHERE p_partkey % 4 = 0),
r AS (SELECT p_partkey AS id, regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]', '', 'g') t, regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]', '', 'g') a, p_size::double AS d, CASE WHEN p_partkey % 3 = 0 THEN 'timed ' || p_size // 2 END AS synced, CASE WHEN p_partkey % 5 > 0 THEN 'plain ' || p_size // 2 END AS plain FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
m AS (SELECT w.id, r.id AS rid, coalesce(synced, plain) AS text, synced IS NOT NULL AS s FROM w JOIN r USING (t, a) WHERE abs(w.d - r.d) <= 2 AND coalesce(synced, plain) IS NOT NULL),
x AS (SELECT id, text, max(rid) AS rid, arg_max(s, rid) AS s FROM m GROUP BY ALL),
b AS (SELECT id, s, count(*) n, max(text) AS text, max(rid) AS rid FROM x GROUP BY id, s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1)
SELECT w.id, CASE WHEN n = 1 THEN text END AS text, CASE WHEN n = 1 THEN rid END AS record_id, coalesce(s, false) AS synced, coalesce(n, 0) AS n_texts, NOT coalesce(n = 1 AND s, false) AS needs_input FROM w LEFT JOIN b USING (id)
""")
def lookup(t):
    """Parts as titles wanted and as records on offer: brand and type must be equal, sizes within 2."""
    p = t.part.withColumn("duration", F.col("p_size").cast("double"))
    k = F.col("p_partkey")
    half = F.floor(F.col("p_size") / 2).cast("string")
    wanted = p.where("p_partkey % 4 = 0").select(k.alias("id"), F.lower("p_brand").alias("title"), F.concat(F.lit(" "), "p_type").alias("artist"), "duration")
    records = p.where("p_partkey % 4 <> 0").select(
        k.alias("record_id"), F.col("p_brand").alias("title"), F.col("p_type").alias("artist"), F.when(k % 13 == 0, float("nan")).otherwise(F.col("duration")).alias("duration"), F.when(k % 11 == 0, True).alias("instrumental"),
        F.when(k % 3 == 0, F.concat(F.lit("timed "), half)).otherwise("").alias("synced_text"), F.when(k % 5 > 0, F.concat(F.lit("plain "), half)).alias("plain_text"),
    )
    return C.lookup(wanted, records)


@query("""
WITH grid AS (SELECT n_nationkey, r::int AS run, m AS mode FROM nation, range(1, 4) a(r), (VALUES ('cpu'), ('gpu')) b(m)), done AS (SELECT s_nationkey AS n_nationkey, (s_suppkey % 3 + 1)::int AS run, CASE WHEN s_acctbal > 5000 THEN 'cpu' ELSE 'gpu' END AS mode FROM supplier)
SELECT * FROM grid ANTI JOIN done USING (n_nationkey, run, mode)
""")
def missing_runs(t):
    """What of nations x runs x modes no supplier stands for."""
    grid = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run")).withColumn("mode", F.explode(F.array(F.lit("cpu"), F.lit("gpu"))))
    done = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("run"), F.when(F.col("s_acctbal") > 5000, "cpu").otherwise("gpu").alias("mode"))
    return C.missing_runs(grid, done, ["n_nationkey", "run", "mode"])


@query("""
SELECT 'known' AS kind, c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey * 3 FROM supplier) UNION ALL SELECT 'unknown', k FROM (SELECT DISTINCT s_suppkey * 3 AS k FROM supplier) WHERE k NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'unknown', -1::bigint
""")
def split_subset(t):
    asked = t.supplier.select((F.col("s_suppkey") * 3).alias("c_custkey")).union(t.spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey")))
    known, unknown = C.select_known(t.customer, asked, "c_custkey")
    return known.select(F.lit("known").alias("kind"), "c_custkey").union(unknown.select(F.lit("unknown").alias("kind"), "c_custkey"))


@query("""
SELECT n_nationkey, round(coalesce(avg(c_acctbal / 10000 - greatest(0, 1 + c_custkey % 3 - 2.4)), -99), 4) AS quality FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 AND n_nationkey % 4 > 0 GROUP BY 1
""")
def mean_quality(t):
    """Mean score less a penalty; -99 for a nation without scores."""
    c = t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_acctbal") / 10000).alias("s"), (1 + F.col("c_custkey") % 3).cast("double").alias("d")).where("n_nationkey % 4 > 0")
    return E.mean_quality(t.nation.select("n_nationkey"), c, "n_nationkey", "s", "d").withColumn("quality", F.round("quality", 4))


@query("""
WITH w AS (SELECT conv_id, sum(length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'))) FILTER (turn % 3 < 2) AS said, sum(length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'))) AS whole, avg(1.0 / (1 + turn)) FILTER (turn % 3 < 2) AS score FROM conversations GROUP BY 1)
SELECT conv_id, round(coalesce(said, 0) / greatest(1, coalesce(whole, 0)), 6) AS coverage, coalesce(said, 0) / greatest(1, coalesce(whole, 0)) >= 0.98 AND coalesce(score, 0) >= 0.3 AS accepted FROM w
""")
def alignment_coverage(t):
    """Letters of the turns that count as aligned (two in three) over all, and whether that and their score suffice."""
    from quaver.functions import rules as R
    from quaver.functions.text import normalized

    c = t.conversations.select("conv_id", F.length(normalized(F.col("text"))).alias("n"), F.when(F.col("turn") % 3 < 2, F.lit(1.0) / (1 + F.col("turn"))).alias("score"))
    cover = F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("n"))), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))
    g = c.groupBy("conv_id").agg(cover.alias("coverage"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))
    return g.select("conv_id", F.round("coverage", 6).alias("coverage"), ((F.col("coverage") >= R.COVERED) & (F.col("score") >= R.SCORED)).alias("accepted"))


@query("""
WITH g AS (SELECT user_id, event_type, min((ts, event_id)) f, sum(round(value * 100)::decimal(18, 0)) s FROM events GROUP BY user_id, event_type)
SELECT user_id, string_agg(event_type, '>' ORDER BY f) AS seen, round(sum(s)::double / 100, 2) AS seconds FROM g GROUP BY user_id
""")
def ordered_distinct(t):
    """A user's event types in the order they first came, and the sum of the values to two places."""
    e = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"), F.sum(F.round(F.col("value") * 100).cast("decimal(18,0)")).alias("s"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("x"), F.sum("s").alias("s"))
    return g.select("user_id", F.array_join(F.transform("x", lambda v: v["event_type"]), ">").alias("seen"), F.round(F.col("s").cast("double") / 100, 2).alias("seconds"))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'P', o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('O', 'P')
""")
def running_first(t):
    """What runs comes first, the rest in order of arrival."""
    from quaver.operators.history import running_first as order

    rows = t.orders.where(F.col("o_orderstatus").isin("O", "P"))
    return order(rows, ["o_custkey"], F.col("o_orderstatus") == "P", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, o_orderstatus AS status, 'moved' AS stage, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, NULL FROM orders WHERE o_orderkey % 2 = 1")
def struct_overlay(t):
    """Fields of one struct laid over another, and a field dropped."""
    o = t.orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("price"), F.lit(1).alias("extra")).alias("r"))
    r = F.col("r").dropFields("extra")
    even = F.col("o_orderkey") % 2 == 0
    return o.select("o_orderkey", F.when(even, r.withField("stage", F.lit("moved"))).otherwise(r.withField("price", F.lit(None).cast("double"))).alias("r")).select("o_orderkey", "r.status", "r.stage", "r.price")


@query("""
WITH f AS (SELECT vec_id, i, 440 * pow(2, embedding[i + 1]::double) AS hz, abs(embedding[i + 1]::double) * 6 >= 0.35 AS v FROM (SELECT *, unnest(range(0, len(embedding))) i FROM embeddings)),
p AS (SELECT a.vec_id, abs(1200 * log2(b.hz / a.hz)) AS cents, a.v AS va, b.v AS vb FROM f a JOIN f b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.vec_id % 2 = 0)
SELECT vec_id, count(*) AS frames, round(median(cents) FILTER (va AND vb), 4) AS middle, round(quantile_cont(cents, 0.95) FILTER (va AND vb), 4) AS p95, round(avg((va <> vb)::int), 6) AS unlike, round(avg((cents < 150)::int) FILTER (va AND vb), 6) AS close FROM p GROUP BY 1
""")
def track_comparison(t):
    """Two pitch tracks frame by frame: cents where both are voiced, and how often one of them is not."""
    from quaver.functions.signals import cents

    x = F.col("x").cast("double")
    f = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", (440 * F.pow(F.lit(2.0), x)).alias("hz"), (F.abs(x) * 6 >= 0.35).alias("v"))
    p = f.where("vec_id % 2 = 0").join(f.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("hz").alias("hz2"), F.col("v").alias("v2")), ["vec_id", "i"])
    p = p.withColumn("c", F.when(F.col("v") & F.col("v2"), cents(F.col("hz2"), F.col("hz"))))
    return p.groupBy("vec_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.median("c"), 4).alias("middle"), F.round(F.percentile("c", F.lit(0.95)), 4).alias("p95"), F.round(F.avg((F.col("v") != F.col("v2")).cast("double")), 6).alias("unlike"), F.round(F.avg((F.col("c") < 150).cast("double")), 6).alias("close"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS stage, p_partkey // 3 AS needs FROM part WHERE p_partkey > 0), r AS (SELECT p_partkey AS stage FROM part WHERE p_partkey % 40 = 7 UNION SELECT e.stage FROM r JOIN e ON e.needs = r.stage) SELECT stage FROM r
""")
def invalid_stages(t):
    """Stages that are invalid, and all that stand on them."""
    p = t.part.select(F.col("p_partkey").alias("stage"), F.floor(F.col("p_partkey") / 3).alias("needs")).where("stage > 0")
    return C.downstream(p, t.part.where("p_partkey % 40 = 7").select(F.col("p_partkey").alias("stage")))


@query("""
WITH n AS (SELECT vec_id, i::int AS frame, i * 0.02 AS time, 60 + (i // 11) % 3 * 4 AS midi, 440 * pow(2, (60 + (i // 11) % 3 * 4 + embedding[i + 1]::double - 69) / 12.0) AS hz, abs(embedding[i + 1]::double) * 6 AS conf FROM (SELECT *, unnest(range(0, len(embedding))) i FROM embeddings)),
s AS (SELECT *, (i0 >= 1 AND i0 < 10) AS ref, abs(69 + 12 * log2(hz / 440) - midi) * 100 AS err FROM (SELECT *, frame % 11 AS i0 FROM n))
SELECT vec_id, count(*) FILTER (ref AND conf >= 0.35) AS evaluated, count(*) FILTER (ref) AS asked, round(median(err) FILTER (ref AND conf >= 0.35), 4) AS middle, round(avg((err < 50)::int) FILTER (ref AND conf >= 0.35), 6) AS close, count(*) FILTER (NOT ref AND conf >= 0.35) AS false_voiced FROM s GROUP BY 1
""")
def pitch_score(t):
    """Frames inside known notes (their edges left out): error in cents, coverage, and voiced frames outside of them."""
    f = t.embeddings.select("vec_id", F.posexplode("embedding").alias("frame", "x"))
    midi = 60 + F.floor(F.col("frame") / 11) % 3 * 4
    hz = 440 * F.pow(F.lit(2.0), (midi + F.col("x").cast("double") - 69) / 12.0)
    f = f.select("vec_id", "frame", hz.alias("hz"), midi.alias("midi"), (F.abs(F.col("x").cast("double")) * 6).alias("conf"))
    ref = (F.col("frame") % 11 >= 1) & (F.col("frame") % 11 < 10)
    counted = ref & (F.col("conf") >= 0.35)
    err = F.when(counted, F.abs(69 + 12 * F.log2(F.col("hz") / 440) - F.col("midi")) * 100)
    return f.withColumn("e", err).groupBy("vec_id").agg(F.count_if(counted).alias("evaluated"), F.count_if(ref).alias("asked"), F.round(F.median("e"), 4).alias("middle"), F.round(F.avg((F.col("e") < 50).cast("double")), 6).alias("close"), F.count_if(~ref & (F.col("conf") >= 0.35)).alias("false_voiced"))


@query("""
SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 4
""")
def available(t):
    """Customers that have all four kinds of orders asked for."""
    return C.complete_sets(t.orders, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query("""
WITH m AS (SELECT o_orderpriority f, o_orderstatus p, median(o_totalprice) s FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') GROUP BY ALL)
SELECT p AS profile, round(sum(s), 4) AS total, count(*) AS fixtures FROM m GROUP BY p HAVING count(*) = (SELECT count(DISTINCT f) FROM m)
""")
def profile_totals(t):
    rows = t.orders.where(~((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"))).select(F.col("o_orderpriority").alias("f"), F.col("o_orderstatus").alias("profile"), "o_totalprice")
    return C.profile_totals(rows, "f", "profile", "o_totalprice").withColumn("total", F.round("total", 4))


@query("""
WITH g AS (SELECT l_orderkey k, median(l_extendedprice) s FROM lineitem GROUP BY 1 HAVING count(*) = 3 AND count(DISTINCT l_linenumber) = 3 AND min(l_linenumber) = 1 AND max(l_linenumber) = 3),
w AS (SELECT 'all' AS kind, k, s, (SELECT sum(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT k FROM g)) / (SELECT sum(s) FROM g) AS total FROM g UNION ALL SELECT 'open', k, s, NULL FROM g)
SELECT kind, k, round(s, 6) AS seconds, round(o_totalprice / s, 6) AS ratio, round(total, 6) AS total_ratio FROM w JOIN orders ON o_orderkey = k WHERE s > 0
""")
def benchmark_report(t):
    """Complete orders against stored figures; the total is given only where nothing stored is still open."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_extendedprice")
    stored = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("seconds"))
    whole = stored.join(C.complete_runs(rows, ["k"], "l_linenumber", "l_extendedprice").select("k"), "k", "left_semi")
    one = lambda s, kind: C.report(rows, s, "k", "l_linenumber", "l_extendedprice").select(F.lit(kind).alias("kind"), "k", *[F.round(c, 6).alias(c) for c in ("seconds", "ratio", "total_ratio")])
    return one(whole, "all").union(one(stored, "open"))


@query("""
WITH w AS (SELECT event_id AS id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 600 + round(value)::bigint AS f FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id AS e, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type <> 'purchase')
SELECT id, count(e) AS n, coalesce(string_agg(e::varchar, ',' ORDER BY e), '') AS inside FROM w LEFT JOIN p ON p.user_id = w.user_id AND p.s >= w.s - 20 AND p.s < w.f GROUP BY id
""")
def points_with_tolerance(t):
    """What lies in each span or up to 20 seconds before it, as a list; spans without anything stay."""
    from quaver.operators.intervals import points_in
    from quaver.plans.base import micros

    at = F.floor(micros("ts") / 1000000)
    w = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", (at - 20).alias("lo"), (at + 600 + F.round("value").cast("long")).alias("hi"))
    p = t.events.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("e"), at.alias("s"))
    g = points_in(p, "s", w, "lo", "hi", 1200, ["user_id"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("e")).alias("x"))
    return w.select("id").join(g, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), F.lit("")).alias("inside"))


@query("""
WITH l AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000) - CASE WHEN event_id % 20 = 0 THEN 90000 ELSE 0 END AS s, ts FROM events), n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM l)
SELECT event_id, least(1706000000, coalesce(nxt, 1706000000)) AS stop, bool_or(coalesce(s >= nxt, false)) OVER (PARTITION BY user_id) AS falls FROM n
""")
def line_ends(t):
    """Every line ends where the next begins, the last at the end; and whether any of a user's starts do not rise."""
    from quaver.operators.sequences import until_next
    from quaver.plans.base import micros

    at = F.floor(micros("ts") / 1000000) - F.when(F.col("event_id") % 20 == 0, 90000).otherwise(0)
    l = t.events.select("user_id", "event_id", "ts", at.alias("s"))
    return until_next(l, ["user_id"], ["ts", "event_id"], "s", F.lit(1706000000)).select("event_id", "stop", "falls")


@query("""
SELECT conv_id, count(*) FILTER (role = 'assistant') AS precise, count(*) FILTER (role = 'user') AS estimated, count(*) FILTER (role NOT IN ('assistant', 'user')) AS fallback, round(count(*) FILTER (role = 'assistant') / nullif(count(*) FILTER (role <> 'system'), 0), 6) AS coverage FROM conversations GROUP BY 1
""")
def outcome_counts(t):
    """Turns by outcome, and the precise share of those that count; null where none does."""
    r = F.col("role")
    counts = [F.count_if(r == "assistant").alias("precise"), F.count_if(r == "user").alias("estimated"), F.count_if(~r.isin("assistant", "user")).alias("fallback")]
    return t.conversations.groupBy("conv_id").agg(*counts, F.round(F.try_divide(F.count_if(r == "assistant"), F.count_if(r != "system")), 6).alias("coverage"))


@query(r"""
WITH w AS (SELECT conv_id, turn, p, word FROM (SELECT conv_id, turn, unnest(range(0, len(x))) AS p, unnest(x) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\s]+') AS x FROM conversations WHERE text IS NOT NULL))),
s AS (SELECT *, regexp_extract_all(lower(word), '[^aeiou]*[aeiou]+|[^aeiou]+$') AS y FROM w WHERE regexp_matches(word, '^[A-Za-z]+$')),
u AS (SELECT conv_id, turn, p, word, y, unnest(range(0, len(y))) AS part FROM s)
SELECT conv_id, turn, p::int AS p, part::int AS part, y[part + 1] || CASE WHEN part = len(y) - 1 THEN ' ' ELSE '' END AS text, round(p * 0.5 + 0.5 * coalesce(length(list_aggregate(y[1:part], 'string_agg', '')), 0) / length(word), 6) AS start,
  round(p * 0.5 + 0.5 * length(list_aggregate(y[1:part + 1], 'string_agg', '')) / length(word), 6) AS stop, len(y) > 1 AS estimated FROM u
""")
def syllable_times(t):
    """Every plain word of the turns, half a second each, cut after its groups of vowels."""
    from quaver.operators.anchors import syllables

    w = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("p", "word")).where(F.col("word").rlike("^[A-Za-z]+$"))
    w = w.withColumns({"word": F.lower("word"), "start": F.col("p") * F.lit(0.5), "stop": (F.col("p") + 1) * F.lit(0.5), "chars": F.lit(None).cast("array<struct<char:string,start:double,stop:double>>")})
    out = syllables(w, lambda x: F.regexp_extract_all(x, F.lit("[^aeiou]*[aeiou]+|[^aeiou]+$"), F.lit(0)), ["conv_id", "turn", "p"])
    return out.withColumns({"start": F.round("start", 6), "stop": F.round("stop", 6)})


@query("""
SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN coalesce(n, 0) END AS lines_done FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey
""")
def live_progress(t):
    """A snapshot of what is done, joined to the rows that are running."""
    n = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(n, "o_orderkey", "left").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "P", F.coalesce("n", F.lit(0))).alias("lines_done"))


@query("""
WITH b AS (SELECT vec_id, i, sqrt(list_sum(list_transform(embedding[i * 4 + 1:i * 4 + 4], lambda x: x::double * x::double)) / 4) * CASE WHEN vec_id % 3 = 0 THEN 1e-7 ELSE 1 END l FROM (SELECT *, unnest(range(0, len(embedding) // 4)) i FROM embeddings)),
m AS (SELECT vec_id, max(l) AS p FROM b GROUP BY 1)
SELECT vec_id, count(*) FILTER (round(l, 9) > round(greatest(1e-6, 0.08 * p), 9)) >= 5 AS active FROM b JOIN m USING (vec_id) GROUP BY 1
""")
def vocal_activity(t):
    """Whether at least five blocks lie above a share of the peak and above silence."""
    from quaver.functions import signals as G

    quiet = F.when(F.col("vec_id") % 3 == 0, 1e-7).otherwise(1.0)
    levels = F.transform(G.blocks(F.col("embedding"), 4), lambda b: F.round(G.rms(b) * quiet, 9))
    return t.embeddings.select("vec_id", (F.size(F.filter(G.active_blocks(levels), lambda x: x)) >= 5).alias("active"))


@query("""
SELECT user_id, to_json({'user': user_id, 'types': list_sort(list(DISTINCT event_type)), 'first': min(event_id)})::varchar AS encoded, list_aggregate(list_sort(list(DISTINCT event_type)), 'string_agg', ',') AS types FROM events GROUP BY 1
""")
def json_encoded(t):
    """Sorted distinct values of a group, as a list and inside a JSON text."""
    g = t.events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("x"), F.min("event_id").alias("f"))
    return g.select("user_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("x").alias("types"), F.col("f").alias("first"))).alias("encoded"), F.array_join("x", ",").alias("types"))


@query("""
WITH r AS (SELECT vec_id AS job, vec_id // 2 AS run, vec_id % 2 AS fast, 10 + vec_id % 7 AS seconds, label AS errors FROM embeddings),
f AS (SELECT vec_id AS job, i, i * 0.01 + CASE WHEN vec_id % 14 = 1 AND i = 9 THEN 0.005 ELSE 0 END AS time, CASE WHEN i % 9 = 0 THEN 0 ELSE 220 * pow(2, embedding[i + 1]::double / 12) END AS hz, abs(embedding[i + 1]::double) * 6 AS conf FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)),
w AS (SELECT job, i // 8 AS j, CASE WHEN job % 10 = 3 AND i = 16 THEN 'other' WHEN job % 10 = 5 AND i = 16 THEN 'word16word' WHEN job % 10 = 5 AND i = 24 THEN '24' ELSE 'word' || i END AS word, (i * 0.1 + (job % 3) * 0.015625)::double AS start, (i * 0.1 + 0.25)::double AS stop, conf < 0.3 AS est FROM f WHERE i % 8 = 0),
p AS (SELECT a.job AS job, a.run, a.seconds, a.errors, b.job AS slow, b.seconds AS slow_seconds, b.errors AS slow_errors FROM r a JOIN r b ON b.run = a.run AND b.fast = 0 WHERE a.fast = 1),
pf AS (SELECT p.job, bool_and(abs(x.time - y.time) <= 1e-6 + 1e-5 * abs(y.time)) AS same_time, median(abs(1200 * log2(x.hz / y.hz))) FILTER (x.conf >= 0.35 AND y.conf >= 0.35 AND x.hz > 0 AND y.hz > 0) AS middle,
  avg((abs(1200 * log2(x.hz / y.hz)) < 50)::int) FILTER (x.conf >= 0.35 AND y.conf >= 0.35 AND x.hz > 0 AND y.hz > 0) AS close, avg(((x.conf >= 0.35) <> (y.conf >= 0.35))::int) AS unlike
  FROM p JOIN (SELECT * REPLACE (CASE WHEN hz = 0 THEN NULL ELSE hz END AS hz) FROM f) x ON x.job = p.slow JOIN (SELECT * REPLACE (CASE WHEN hz = 0 THEN NULL ELSE hz END AS hz) FROM f) y ON y.job = p.job AND y.i = x.i GROUP BY 1),
pw AS (SELECT p.job, bool_and(x.word = y.word) AS same, string_agg(x.word, '' ORDER BY x.j) = string_agg(y.word, '' ORDER BY y.j) AS kept, max(greatest(abs(x.start - y.start), abs(x.stop - y.stop))) AS widest, count(*) FILTER (x.est) AS slow_estimated, count(*) FILTER (y.est) AS fast_estimated FROM p JOIN w x ON x.job = p.slow JOIN w y ON y.job = p.job AND y.j = x.j GROUP BY 1)
SELECT run, job, errors <= slow_errors AS errors_pass, round(slow_seconds / seconds, 6) AS speedup, same_time, CASE WHEN same_time THEN round(middle, 4) END AS middle_cents, CASE WHEN same_time THEN round(close, 6) END AS share_close, CASE WHEN same_time THEN round(unlike, 6) END AS share_unlike, kept AS text_kept, CASE WHEN same THEN round(widest, 6)::double END AS widest, slow_estimated, fast_estimated FROM p JOIN pf USING (job) JOIN pw USING (job)
""")
def acceleration(t):
    """Odd vectors as fast runs against the even ones before them: errors, speed, pitch frame by frame, words' edges."""
    e = t.embeddings.where("vec_id IS NOT NULL")
    k = F.col("vec_id")
    runs = e.select(F.lit("en").alias("language"), F.floor(k / 2).alias("run"), F.when(k % 2 == 0, "slow").otherwise("fast").alias("mode"), k.alias("job"), (10 + k % 7).cast("double").alias("seconds"), F.col("label").alias("errors"))
    i, x = F.col("i"), F.col("x").cast("double")
    late = F.when((F.col("job") % 14 == 1) & (i == 9), 0.005).otherwise(0.0)
    frames = e.select(k.alias("job"), F.posexplode("embedding").alias("i", "x")).select("job", i.alias("frame"), (i * 0.01 + late).alias("time"), F.when(i % 9 == 0, 0.0).otherwise(220 * F.pow(F.lit(2.0), x / 12)).alias("hz"), (F.abs(x) * 6).alias("confidence"))
    n, j = F.col("frame"), F.col("job")
    word = F.when((j % 10 == 3) & (n == 16), "other").when((j % 10 == 5) & (n == 16), "word16word").when((j % 10 == 5) & (n == 24), "24").otherwise(F.concat(F.lit("word"), n.cast("string")))
    words = frames.where(n % 8 == 0).select("job", F.floor(n / 8).alias("j"), word.alias("word"), (n * 0.1 + (j % 3) * 0.015625).alias("start"), (n * 0.1 + 0.25).alias("stop"), (F.col("confidence") < 0.3).alias("estimated"))
    out = C.compare_runs(runs, frames, words, "fast", "slow")
    return out.select("run", "job", "errors_pass", F.round("speedup", 6).alias("speedup"), "same_time", F.round("middle_cents", 4).alias("middle_cents"), F.round("share_close", 6).alias("share_close"), F.round("share_unlike", 6).alias("share_unlike"), "text_kept", F.round("widest", 6).alias("widest"), "slow_estimated", "fast_estimated")
