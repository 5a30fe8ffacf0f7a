"""N-gram Jaccard join: rare-first prefix filtering, each pair verified once.

1. Every text becomes a set of k-word shingle hashes.  A counter of all shingles
   (``dense_sum``; its size follows the input up to a fixed memory) gives each an
   estimated frequency; (estimate, hash) is one total order, rarest first, for all
   texts.  Estimates only order, so collisions cost time and change no result.
2. Texts with equal sets form classes by a 128-bit set fingerprint; one row of a
   class stands for it under a number of its own (``rid``), so ids need not be
   unique nor known.
3. Each representative posts the prefix of its ordered set: n - ceil(t n) + 1
   shingles, enough that any two sets of Jaccard >= t share one.  A posting
   carries the size and position; length and positional filters give the range
   of partner sizes it can still match.
4. Postings meet by shingle.  First each one is paired with its list's two hubs
   and its next possible partner; these pairs are verified once and connected.  Then
   every further pair that passes the filters and whose ends are not connected
   yet is verified once.  Pairs inside a component are skipped: no link can
   change it.  The suffix filter comes before any set is built: a set's parity
   sketch (bit i: whether an odd number of its shingles hash to i) differs from
   another's in at most as many bits as the sets differ in shingles, so a pair with
   more is none.  Verification bounds the overlap by counts in hash ranges, too,
   before it intersects the sets.

Lists whose estimate could be long are counted; those with more than LONG postings
are dealt into blocks, and block pairs meet in tasks of their own, so no list need
fit one task and no other list is copied.

Edge cases: null and empty texts, and texts of white space, have no shingles and
link with nothing; a text of fewer than k words is one shingle; a very long text is
one set like any other, worked through in pieces; repeated rows are one class; rows
with one id and different texts are classes of their own, linked only if their
texts are; a null id never names a component, unless all of its ids are null; ties
in the order of shingles go by hash; an empty table gives an empty result; columns
other than id and text are not read, whatever their names.  ``one_per_group`` keeps
one row of every component (of the least id; of rows with one id, that of the least
hash of id and text; of rows equal in both, any one) and every text without words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaver.llm import textvec as T
from quaver.llm.links import components
from quaver.llm.shared import broadcast_if_small, discard, fresh, map_arrow, materialise, text_bytes
from quaver.llm.sketch import dense_sum

#: Least and most counter cells, input bytes for one; postings beyond which a list is
#: dealt in blocks; ids up to which a table of them is broadcast; flagged cells up to
#: which only their lists are counted; partners tried for each text in the first
#: round (the second is complete).
CELLS, MOST_CELLS, CELL_BYTES, LONG, IDS, FLAGGED, FIRST = 1 << 18, 1 << 21, 256, 50_000, 4_000_000, 100_000, 4
#: Least bits of a parity sketch; a set of n has the next power of two from n on.
BITS = 256
SIGNATURE = "doc_id long, row_hash long, n long, fp1 long, fp2 long, prefix array<long>, parity array<long>"


def _count(k: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(cells, np.int64)
        for b in batches:
            for *_, data, off in T.pieces(b.column(0)):
                _, _, h, wo = T.words(data, off)
                s, _ = T.shingles(h, wo, k)
                np.add.at(total, (s & np.uint64(cells - 1)).astype(np.int64), 1)
        return total

    return run


def prefix_length(n: int, t: Fraction) -> int:
    return n - math.ceil(t * n) + 1 if n else 0


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _parity(own: np.ndarray) -> np.ndarray:
    bits = max(BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((T.mix(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _distinct(own: np.ndarray) -> np.ndarray:
    own = np.sort(own)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _fingerprint(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set of shingles."""
    return T.mix(own + np.uint64(0x51ED27)).sum(dtype=np.uint64), T.mix(own ^ np.uint64(0xA5A5F00D12345)).sum(dtype=np.uint64)


def _signatures(k: int, t: Fraction, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        mask = np.uint64(len(freq) - 1)
        for b in batches:
            for i, j, data, off in T.pieces(b.column(2)):
                _, _, h, wo = T.words(data, off)
                s, so = T.shingles(h, wo, k)
                n = np.zeros(j - i, np.int64)
                fp = np.zeros((2, j - i), np.uint64)
                pre, po = [], np.zeros(j - i + 1, np.int64)
                parity, bo = [], np.zeros(j - i + 1, np.int64)
                for d in range(j - i):
                    own = _distinct(s[so[d] : so[d + 1]])
                    if len(own):
                        n[d] = len(own)
                        fp[:, d] = _fingerprint(own)
                        parity.append(_parity(own))
                        first = np.argsort(freq[(own & mask).astype(np.int64)], kind="stable")
                        pre.append(own[first[: prefix_length(len(own), t)]])
                    po[d + 1] = po[d] + (len(pre[-1]) if n[d] else 0)
                    bo[d + 1] = bo[d] + (len(parity[-1]) if n[d] else 0)
                flat = np.concatenate(pre) if pre else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(po, pa.int32()), _i64(flat))
                bits = pa.ListArray.from_arrays(pa.array(bo, pa.int32()), pa.array(np.concatenate(parity) if parity else np.zeros(0, np.int64)))
                columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), _i64(fp[0].copy()), _i64(fp[1].copy()), lists, bits]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", "n", "fp1", "fp2", "prefix", "parity"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in T.pieces(b.column(1)):
                _, _, h, wo = T.words(data, off)
                s, so = T.shingles(h, wo, k)
                own = [_distinct(s[so[d] : so[d + 1]]) for d in range(j - i)]
                prints = pa.array([int(_fingerprint(x)[0].view(np.int64)) for x in own], pa.int64())
                blobs = pa.array([x.tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), prints, blobs], ["row_hash", "fp1", "shingles"])

    return run


def _most(n: np.ndarray, pos: np.ndarray, t: Fraction) -> np.ndarray:
    """The largest partner size that a posting at ``pos`` of a set of ``n`` can still match."""
    p, q = t.numerator, t.denominator
    return ((n - pos) * (p + q)) // p - n


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole lists, from batches sorted by (h, cell): many short lists at a time."""
    rest: dict[str, np.ndarray] | None = None
    for b in batches:
        now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in now}
        n = len(now["h"])
        if not n:
            continue
        last = n - 1 - int(np.argmax((now["h"][::-1] != now["h"][-1]) | (now["cell"][::-1] != now["cell"][-1])))
        if now["h"][last] == now["h"][-1] and now["cell"][last] == now["cell"][-1]:
            rest = now  # one list so far
            continue
        yield {c: x[: last + 1] for c, x in now.items()}
        rest = {c: x[last + 1 :] for c, x in now.items()}
    if rest is not None and len(rest["h"]):
        yield rest


def _bounds(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["cell"][1:] != x["cell"][:-1])])
    st = np.flatnonzero(new)
    return st, np.concatenate([st[1:], [len(new)]])


PAIR = "a long, b long, na int, nb int"


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray], na: list[np.ndarray], nb: list[np.ndarray]) -> pa.RecordBatch:
    cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, na, nb)]
    swap = cat[0] > cat[1]
    lo, hi = np.where(swap, cat[1], cat[0]), np.where(swap, cat[0], cat[1])
    ln, hn = np.where(swap, cat[3], cat[2]), np.where(swap, cat[2], cat[3])
    _, first = np.unique(np.stack([lo, hi]), axis=1, return_index=True) if len(lo) else (None, np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(lo[first]), pa.array(hi[first]), pa.array(ln[first], pa.int32()), pa.array(hn[first], pa.int32())], ["a", "b", "na", "nb"])


def _lists(t: Fraction, reach: int):
    """Postings of lists with at least one possible pair, each with up to three partners to try first:
    the list's two hubs (the texts that can still match the largest sets, so have least of their own) and
    the next possible one in the list's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _grouped(batches):
            st, en = _bounds(x)
            keep = x["dealt"] > 0  # its other blocks may hold partners
            size = en - st
            most = _most(x["n"], x["pos"], t)
            rank = np.repeat(np.arange(len(st)), size)
            best = np.lexsort((x["doc"], -most, rank))
            hubs = (best[st], best[np.minimum(st + 1, en - 1)])
            fits = lambda i, j: (x["n"][j] <= most[i]) & (x["n"][i] <= most[j]) & (x["doc"][i] != x["doc"][j])
            near = np.full((3, len(keep)), -1, np.int64)
            for r, hub in enumerate(hubs):
                j = hub[rank]
                i = np.flatnonzero((size[rank] > 1) & fits(np.arange(len(keep)), j))
                near[r, i] = j[i]
            for gap in range(1, reach + 1):
                i = np.flatnonzero(np.repeat(en, size) - np.arange(len(keep)) > gap)
                j = i + gap
                ok = fits(i, j) & (near[2, i] < 0)
                near[2, i[ok]] = j[ok]
            for r in range(3):
                i = np.flatnonzero(near[r] >= 0)
                keep[i] = keep[near[r, i]] = True
            # longer lists may hold pairs further apart (rows are sorted by size within a list)
            for s, e in zip(st[size > reach + 1], en[size > reach + 1], strict=True):
                n, m = x["n"][s:e], most[s:e]
                to = np.searchsorted(n, m, "right")
                keep[s:e] |= (to - np.arange(len(n)) > 1) | (m >= n[0])
            i = np.flatnonzero(keep)
            tries = [pa.array(np.where(near[r, i] >= 0, x["doc"][near[r, i]], -1), pa.int64()) for r in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x[c][i], pa.int64()) for c in ("h", "cell", "doc")] + [pa.array(x[c][i], pa.int32()) for c in ("n", "pos")] + tries, ["h", "cell", "doc", "n", "pos", "t0", "t1", "t2"])

    return run


def _rest(t: Fraction):
    """Pairs of one list that pass the filters and lie in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _grouped(batches):
            st, en = _bounds(x)
            most = _most(x["n"], x["pos"], t)
            out: tuple[list, list, list, list] = ([], [], [], [])
            held = 0
            for s, e in zip(st, en, strict=True):
                n, m, c, d, side = x["n"][s:e], most[s:e], x["comp"][s:e], x["doc"][s:e], x["side"][s:e]
                if len(n) < 2 or (c == c[0]).all():
                    continue
                to = np.searchsorted(n, m, "right")
                for i in np.flatnonzero(to - np.arange(len(n)) > 1):
                    j = np.arange(i + 1, to[i])
                    j = j[(c[j] != c[i]) & (m[j] >= n[i]) & (d[j] != d[i]) & ((side[j] != side[i]) | (side[i] < 0))]
                    if len(j):
                        out[0].append(np.full(len(j), d[i]))
                        out[1].append(d[j])
                        out[2].append(np.full(len(j), n[i]))
                        out[3].append(n[j])
                        held += len(j)
                    if held > 200_000:
                        yield _pair_batch(*out)
                        out, held = ([], [], [], []), 0
            if held:
                yield _pair_batch(*out)

    return run


BINS = 16


def similar(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    """Whether sorted distinct arrays have Jaccard >= t; exact."""
    need = math.ceil(t * (len(x) + len(y)) / (1 + t))
    if min(len(x), len(y)) < need:
        return False
    edges = np.arange(1, BINS, dtype=np.uint64) << np.uint64(60)
    cx, cy = (np.diff(np.concatenate([[0], np.searchsorted(v, edges), [len(v)]])) for v in (x, y))
    if np.minimum(cx, cy).sum() < need:  # suffix filter: ranges of hashes bound the overlap
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("set_a"), b.column("set_b")
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), t) for x, y in zip(a, c, strict=True)]
            i = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(i)), b.column("b").take(pa.array(i))], ["a", "b"])

    return run


def verify(texts: DataFrame, heads: DataFrame, pairs: DataFrame, k: int, t: Fraction, name: str) -> DataFrame:
    """(a, b) of those ``pairs`` of rids whose shingle sets are similar.

    ``texts``: row_hash, text.  ``heads`` (rid, row_hash, fp1) says which text is whose.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    ids = materialise(heads.join(ids, "rid"), name + "ids")
    count = ids.count()
    asked = ids.select("row_hash").distinct()
    own = texts.join(broadcast_if_small(asked, count, IDS), "row_hash", "left_semi")
    found = map_arrow(own, _sets(k), "row_hash long, fp1 long, shingles binary").dropDuplicates(["row_hash", "fp1"])
    sets = materialise(found.join(broadcast_if_small(ids, count, IDS), ["row_hash", "fp1"]).select("rid", "shingles"), name + "sets")
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = both.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    out = materialise(map_arrow(both, _verify(t), "a long, b long"), name)
    discard(ids, sets)
    return out


def plausible(pairs: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) of those ``pairs`` that the parity sketches (rid, n, parity) do not rule out.

    Sets with Jaccard >= t differ in at most (na + nb) (1 - t) / (1 + t) shingles.
    Sizes that can match differ by less than two, so their sketches' lengths by one
    doubling at most; the longer one is folded to the shorter.
    """
    side = lambda x: sketches.select(F.col("rid").alias(x), F.col("n").alias("n" + x), F.col("parity").alias("p" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    w = F.least(F.size("pa"), F.size("pb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.when(F.size(x) == 2 * w, F.zip_with(F.slice(x, 1, w), F.slice(x, w + 1, w), xor)).otherwise(F.col(x))
    unlike = F.aggregate(F.zip_with(fold("pa"), fold("pb"), lambda x, y: F.coalesce(F.bit_count(xor(x, y)), F.lit(0))), F.lit(0), lambda s, x: s + x)
    p, q = t.numerator, t.denominator
    return both.where(unlike * F.lit(q + p) <= (F.col("na") + F.col("nb")) * F.lit(q - p)).select("a", "b")


def _long_lists(post: DataFrame, freq: np.ndarray) -> DataFrame | None:
    """(h, parts) of the lists with more than LONG postings; an estimate is never below the true number."""
    flagged = np.flatnonzero(freq > LONG)
    if not len(flagged):
        return None
    if len(flagged) <= FLAGGED:
        listed = F.split(F.lit(",".join(map(str, flagged.tolist()))), ",").cast("array<long>")  # made in the JVM: no Python worker starts for it
        slots = post.sparkSession.range(1).select(F.explode(listed).alias("slot"))
        post = post.join(F.broadcast(slots), F.col("h").bitwiseAND(F.lit(len(freq) - 1)) == F.col("slot"), "left_semi")
    counted = post.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > LONG)
    few = materialise(counted.select("h", F.ceil(F.col("c") / LONG).cast("int").alias("parts")), "longlists")
    n = few.count()
    return broadcast_if_small(few, n, IDS) if n else None


def members(docs: DataFrame, k: int, threshold: str, key: str, text: str) -> DataFrame:
    """(rid, row_hash, doc_id, n_shingles, class_id, component_id, component) of every row: ``component`` is the number of
    its component, or of its class where that has no link; null for texts without words."""
    spark = docs.sparkSession
    t = Fraction(threshold)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    cells = CELLS
    while cells < MOST_CELLS and cells * CELL_BYTES < text_bytes(texts):
        cells *= 2
    freq = dense_sum(texts.select("text"), _count(k, cells), cells)
    counts = spark.sparkContext.broadcast(np.minimum(freq, (1 << 32) - 1).astype(np.uint32))
    sigs = map_arrow(texts, _signatures(k, t, counts), SIGNATURE)
    sigs = materialise(sigs.withColumn("rid", F.monotonically_increasing_id()), "sigs")  # written once, so the numbers stay
    some = sigs.where("n > 0")
    classes = some.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("rid", "row_hash")).alias("head"), F.min("doc_id").alias("class_id"))
    classes = materialise(classes.select("fp1", "fp2", "n", F.col("head.rid").alias("node"), F.col("head.row_hash").alias("row_hash"), "class_id"), "classes")
    heads = classes.select(F.col("node").alias("rid"), "row_hash", "fp1")
    reps = some.select("rid", "n", "prefix", "parity").join(heads.select("rid"), "rid", "left_semi")
    sketches = reps.select("rid", "n", "parity")
    post = reps.select("rid", "n", F.posexplode("prefix").alias("pos", "h")).select("h", F.col("rid").alias("doc"), F.col("n").cast("int").alias("n"), "pos")
    few = _long_lists(post, freq)
    if few is None:
        parts = F.lit(1)
    else:
        post = post.join(few, "h", "left")
        parts = F.coalesce(F.col("parts"), F.lit(1))
    block = F.pmod(F.hash("doc"), parts)
    dealt = post.select("h", block.cast("long").alias("cell"), "doc", "n", "pos", (parts > 1).cast("int").alias("dealt"))
    # within a size, an order of each list's own: its neighbours differ from those in other lists
    dealt = dealt.repartition("h", "cell").sortWithinPartitions("h", "cell", "n", F.xxhash64("doc", "h"))
    lists = materialise(map_arrow(dealt, _lists(t, 2), "h long, cell long, doc long, n int, pos int, t0 long, t1 long, t2 long"), "lists")
    tries = lists.select("doc", F.explode(F.array_distinct(F.filter(F.array("t0", "t1", "t2"), lambda v: v >= 0))).alias("near"))
    # the partners that share most lists with a text, whichever text they are
    tried = tries.groupBy("doc", "near").agg(F.count(F.lit(1)).alias("c"))
    tried = tried.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("c"), "near"))).where(F.col("r") <= FIRST)
    met = tried.select(F.least("doc", "near").alias("a"), F.greatest("doc", "near").alias("b")).distinct()
    first = materialise(plausible(met, sketches, t).distinct(), "pairs1")
    own = texts.select("row_hash", "text")
    links = verify(own, heads, first, k, t, "links1")
    comp = components(links)
    held = lists.select("h", "cell", "doc", "n", "pos").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    if few is not None:
        # a long list's blocks i < j meet in cell (i, j); a block with itself in (i, i)
        held = held.join(few, "h", "left")
        n = F.coalesce(F.col("parts"), F.lit(1))
        cells_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.least(i.cast("long"), F.col("cell")) * 1_000_000 + F.greatest(i.cast("long"), F.col("cell"))).alias("cell"), F.when(i == F.col("cell"), F.lit(-1)).otherwise(F.col("cell").cast("int")).alias("side")))
        held = held.withColumn("_c", F.explode(cells_)).select("h", F.col("_c.cell").alias("cell"), F.col("_c.side").alias("side"), "doc", "n", "pos", "comp")
    else:
        held = held.withColumn("side", F.lit(-1))
    open_ = held.groupBy("h", "cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h", "cell")
    held = held.join(open_, ["h", "cell"], "left_semi").select("h", "cell", "side", "doc", "n", "pos", "comp")
    second = map_arrow(held.repartition("h", "cell").sortWithinPartitions("h", "cell", "n", "doc"), _rest(t), PAIR)
    second = plausible(second.select("a", "b").distinct(), sketches, t).distinct()
    second = materialise(second.join(first, ["a", "b"], "left_anti"), "pairs2")
    discard(lists, comp)
    more = verify(own, heads, second, k, t, "links2")
    final = components(links.union(more))
    # a component's id is the least id of its classes
    linked = classes.select("node", "class_id").join(final, "node")
    least = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = materialise(linked.join(least, "component").select("node", "component", "component_id"), "named")
    discard(first, second, links, more, final)
    kinds = classes.join(named, "node", "left").select("fp1", "fp2", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("component", "node").alias("component"))
    member = sigs.select("rid", "row_hash", "doc_id", "n", "fp1", "fp2").join(kinds, ["fp1", "fp2", "n"], "left")
    alone = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return member.select("rid", "row_hash", "doc_id", F.col("n").alias("n_shingles"), alone("class_id"), alone("component_id"), "component")


def near_groups(docs: DataFrame, k: int = 5, threshold: str = "0.8", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``."""
    return members(docs, k, threshold, key, text).select("doc_id", "n_shingles", "class_id", "component_id")


def one_per_group(docs: DataFrame, k: int = 5, threshold: str = "0.8", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component; texts without words all stay."""
    rows = members(docs, k, threshold, key, text).where("component IS NOT NULL")
    rows = materialise(rows.groupBy("component", "row_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_hash"))
    best = rows.groupBy("component").agg(first.alias("b")).select("b.row_hash")
    # by the hash of id and text, which tells rows apart: a large component does not meet in one task
    gone = materialise(rows.join(best, "row_hash", "left_anti").select("row_hash"), "gone")
    twice = materialise(rows.where("c > 1").join(best, "row_hash", "left_semi").select("row_hash"), "twice")
    mark, n_gone, n_twice = fresh(docs, "row_hash"), gone.count(), twice.count()
    kept = docs.withColumn(mark, F.xxhash64(docs[key].cast("long"), docs[text]))
    kept = kept.join(broadcast_if_small(gone.withColumnRenamed("row_hash", mark), n_gone, IDS), mark, "left_anti")
    if n_twice:
        again = broadcast_if_small(twice.withColumnRenamed("row_hash", mark), n_twice, IDS)
        kept = kept.join(again, mark, "left_anti").unionByName(kept.join(again, mark, "left_semi").dropDuplicates([mark]))
    return kept.select(*docs.columns)


def q_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, threshold="0.9")
    return out.select("doc_id", "n_shingles", "component_id")
