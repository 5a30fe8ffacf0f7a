"""Benchmark decontamination (DataFrame and SQL functions only).

Windows of a text that are as long as a benchmark item are compared with the
items of that length:

1. Texts and items become lower-case words without punctuation.  A window can
   reach the similarity asked for only if it shares a ``K``-word shingle with its
   item, so windows are laid where a shingle of an item occurs: one for every
   (start, length) that puts that shingle in the item's place.
2. Each window and item gets a 64-bit SimHash of its shingles, each weighted by
   its number of occurrences.
3. Multi-index search: the 64 bits are cut into BLOCKS blocks; two fingerprints
   within RADIUS differ in at most RADIUS // BLOCKS bits of at least one block.
   Every item is entered under all values within that many bits of each of its
   blocks, every window under its own values, so a join on (length, block, value)
   finds every pair within RADIUS, checked by the bit count.  Of two unrelated
   fingerprints about one pair in seven meets.
4. The exact weighted Jaccard of the two shingle multisets (sum of least counts
   over sum of largest) decides.

The radius is part of the method and can drop a window that the exact measure
would keep: in a simulation with random shingle hashes (20,000 pairs each) 0.03 to
0.09 % of windows at a similarity of exactly 0.8 (18 to 100 shingles), none of
exact copies.  The test on the supplied tables finds no loss.

The benchmark's shingles are broadcast only while their counted number is at
most SHINGLES; beyond that the same join shuffles.  Windows of copies of one
passage have equal words and are fingerprinted and compared once.

Edge cases: null and empty texts or items match nothing; an item of fewer than K
words is one shingle of its own length and matches where its words occur; a text
shorter than an item is one window; a very long text is read whole, window by
window; repeated rows and items are reported alike, and items that match one window
equally well are all reported; a null id is reported as null; an empty table gives
an empty result; columns other than id and text are not read, whatever their names.
``clean`` goes by text, not by id: it drops every row whose text holds a copy,
also under a null or a repeated id, and keeps all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.shared import broadcast_if_small, fresh, materialise

K, THRESHOLD, RADIUS, BLOCKS, BITS, SHINGLES, IDS = 5, 0.8, 19, 4, 64, 1_000_000, 4_000_000


def normal_words(text: Column) -> Column:
    """Lower-case words; punctuation marks are dropped, white space separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def _shingle_at(at: Column, width: int) -> Column:
    """Hash of ``width`` words from ``at`` (from 0) of the column ``words``."""
    return F.xxhash64(F.lit(width), *[F.get("words", at + i) for i in range(width)])


def _shingles(words: Column, k: int) -> Column:
    """Shingle strings of a word array; a shorter one is one shingle."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " "))).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def simhash(df: DataFrame, key: str, words: str, k: int) -> DataFrame:
    """(key, fp): a 64-bit SimHash; each occurrence of a shingle has weight 1."""
    hashes = df.select(key, F.explode(_shingles(F.split(words, " "), k)).alias("_s")).select(key, F.xxhash64("_s").alias("_h"))
    bits = [F.sum(F.getbit("_h", F.lit(b)).cast("int")).alias(f"_b{b}") for b in range(BITS)]
    sums = hashes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *bits)
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"_b{b}") > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(key, fp.alias("fp"))


def blocks(fp: Column) -> Column:
    """Array of (block, value): BLOCKS blocks that cover all bits."""
    size = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, i * size).bitwiseAND(F.lit((1 << size) - 1)).alias("value")) for i in range(BLOCKS)])


def near_values(value: Column, radius: int) -> Column:
    """All values of a block within ``radius // BLOCKS`` bits of ``value``."""
    masks = [m for m in range(1 << BITS // BLOCKS) if m.bit_count() <= radius // BLOCKS]
    listed = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")
    return F.transform(listed, lambda m: value.bitwiseXOR(m))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of largest counts of two arrays of shingles."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    least = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return least / F.greatest(F.size(a) + F.size(b) - least, F.lit(1))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc_id, text_hash, start, n_words, item_id, distance, similarity) of every window that is an item's copy."""
    items = benchmark.select(F.col(item).alias("item_id"), normal_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    items = materialise(items.withColumn("n", F.size("words")).withColumn("item_text", F.array_join("words", " ")), "items")
    width = F.least(F.col("n"), F.lit(k))
    widths = sorted(r[0] for r in items.select(width.alias("w")).distinct().collect())  # at most k values
    if not widths:
        return docs.select(F.col(key).alias("doc_id")).limit(0).selectExpr("doc_id", "0L AS text_hash", "0 AS start", "0 AS n_words", "0L AS item_id", "0 AS distance", "0D AS similarity")
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), normal_words(F.col(text)).alias("words"))
    found = None
    for w in widths:
        own = items.where(width == w)
        known = own.select("n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - w)).alias("at")).select(_shingle_at(F.col("at"), w).alias("h"), "n", "at").distinct()
        known = materialise(known, "known")
        start = lambda n: F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), n - F.col("n")))
        if known.count() > SHINGLES:  # places go to the shingles without their texts, and what is hit comes back to them once
            bare = texts.where(F.size("words") >= w).select("text_hash", "words").dropDuplicates(["text_hash"])
            bare = bare.select("text_hash", F.size("words").alias("m"), F.transform(F.sequence(F.lit(0), F.size("words") - w), lambda p: _shingle_at(p, w)).alias("hs")).select("text_hash", "m", F.posexplode("hs").alias("p", "h"))
            laid = bare.join(known, "h").select("text_hash", "n", start(F.col("m")).alias("start")).distinct()
            hits = texts.join(laid, "text_hash").select("doc_id", "text_hash", "n", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ").alias("window"))
            found = hits if found is None else found.union(hits)
            continue
        known = F.broadcast(known)
        places = texts.where(F.size("words") >= w).select("doc_id", "text_hash", "words", F.explode(F.sequence(F.lit(0), F.size("words") - w)).alias("p")).select("doc_id", "text_hash", "words", "p", _shingle_at(F.col("p"), w).alias("h"))
        hits = places.join(known, "h")
        begin = start(F.size("words"))
        hits = hits.select("doc_id", "text_hash", "n", begin.alias("start"), F.array_join(F.slice("words", begin + 1, F.col("n")), " ").alias("window"))
        found = hits if found is None else found.union(hits)
    windows = materialise(found.distinct(), "windows")
    kinds = materialise(windows.select("n", "window").distinct().withColumn("wid", F.xxhash64("n", "window")), "kinds")
    wfp = simhash(kinds, "wid", "window", k)
    texts_of_items = items.select("n", "item_text").distinct().withColumn("tid", F.xxhash64("n", "item_text"))
    ifp = simhash(texts_of_items, "tid", "item_text", k)
    left = kinds.join(wfp, "wid").select("wid", "n", "window", F.col("fp").alias("wfp"))
    right = materialise(texts_of_items.join(ifp, "tid").select("tid", "n", "item_text", F.col("fp").alias("ifp")), "itemfps")
    pairs = left.withColumn("b", F.explode(blocks(F.col("wfp")))).select("wid", "n", "wfp", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    probe = right.withColumn("b", F.explode(blocks(F.col("ifp")))).select("tid", "n", "ifp", F.col("b.block").alias("block"), F.explode(near_values(F.col("b.value"), radius)).alias("value"))
    distance = F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp")))
    near = pairs.join(probe.hint("shuffle_merge"), ["n", "block", "value"]).where(distance <= radius).select("wid", "tid", distance.alias("distance")).distinct()
    judged = near.join(left.select("wid", "window"), "wid").join(right.select("tid", "item_text"), "tid")
    judged = judged.withColumn("similarity", weighted_jaccard(_shingles(F.split("window", " "), k), _shingles(F.split("item_text", " "), k)))
    judged = materialise(judged.where(F.col("similarity") >= threshold).select("wid", "tid", "distance", F.round("similarity", 6).alias("similarity")), "judged")
    named = judged.join(items.select(F.xxhash64("n", "item_text").alias("tid"), "item_id"), "tid")
    out = windows.withColumn("wid", F.xxhash64("n", "window")).join(named, "wid")
    return out.select("doc_id", "text_hash", "start", F.col("n").alias("n_words"), "item_id", "distance", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a copy of an item."""
    mark = fresh(docs, "leak")
    bad = materialise(leaks(docs, benchmark, key=key, text=text).select(F.col("text_hash").alias(mark)).distinct(), "leaks")
    bad = broadcast_if_small(bad, bad.count(), IDS)
    return docs.join(bad, F.xxhash64(docs[text]) == bad[mark], "left_anti")


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n_windows"))
