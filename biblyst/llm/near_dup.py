"""Near-duplicate records: consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Each text becomes its distinct runs of n words with their counts; texts with
   equal sets collapse to one representative (their smallest id).
2. Shingles in at least ``FREQUENT`` of all texts are counted exactly (two-pass
   heavy hitters); the rarer ones share the top weight, so only a bounded table
   of weights travels. The weight is (1 + ln tf) * max(FLOOR, idf / top idf).
3. Improved consistent weighted sampling draws BANDS * ROWS samples per text.
   Texts that agree on all samples of a band share a bucket.
4. Buckets of up to ALL_PAIRS texts give all their pairs; larger ones first give
   a star around their smallest text, and after the stars are verified the
   members outside the bucket's largest group meet the whole bucket. Buckets
   that hold more than FREQUENT of all texts are starred map-side, so no task
   receives them.
5. Sizes, weights and a MASK_WORDS * 64 bit mask of each set bound the similarity
   of a pair from above; pairs that can't reach the thresholds end there, before
   any set travels. The others are verified by weighted Jaccard similarity, and,
   where asked, by the plain Jaccard similarity of the sets; verified pairs are
   joined to groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.llm.components import connected_components
from biblyst.llm.heavy import heavy_hitters
from biblyst.llm.text import distinct_runs, mix
from biblyst.session import materialize, small

FREQUENT = 1e-3
FLOOR = 0.35  # least weight of a shingle at tf 1: groups of copies make their own shingles frequent
BANDS = 40
ROWS = 3
ALL_PAIRS = 32
MASK_WORDS = 8
#: Members of a large bucket that one task holds against its loose members.
BUCKET_PART = 1000
POOL = 1 << 16  # entries of the table of random variates
SLICE = 1 << 15  # shingles that are sampled together
U = np.uint64


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64())


def shingle_sets(df: DataFrame, n: int) -> DataFrame:
    """(id, fp1, fp2, shingles, tf) of (id, text); texts shorter than n words are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c, off = distinct_runs(b.column(1).to_pylist(), n)
            keep = np.flatnonzero(np.diff(off))
            at = off[:-1][keep]
            m = mix(h)
            fp1 = np.add.reduceat(m, at) if len(keep) else np.zeros(0, U)
            fp2 = np.bitwise_xor.reduceat(mix(m), at) if len(keep) else np.zeros(0, U)
            ends = pa.array(np.append(at, len(h)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), _i64(fp1), _i64(fp2), pa.ListArray.from_arrays(ends, _i64(h)), pa.ListArray.from_arrays(ends, pa.array(c, pa.int32()))],
                names=["id", "fp1", "fp2", "shingles", "tf"],
            )

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInArrow(run, f"id {kind}, fp1 long, fp2 long, shingles array<long>, tf array<int>")


class Weights:
    """Weight of a shingle by its text frequency; unknown shingles have weight 1 at tf 1."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, rows: int) -> None:
        order = np.argsort(values)
        self.values = values[order]
        top = np.log(1 / FREQUENT)
        idf = np.log(max(rows, 1) / np.maximum(counts[order], 1))
        self.w = np.clip(idf / top, FLOOR, 1)

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = np.ones(len(h))
        if len(self.values):
            at = np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)
            hit = self.values[at] == h
            w[hit] = self.w[at[hit]]
        return w * (1 + np.log(tf)) if len(tf) and tf.max() > 1 else w


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.default_rng(20240229)
    return (g.gamma(2, 1, POOL).astype(np.float32), np.log(g.gamma(2, 1, POOL)).astype(np.float32), g.random(POOL).astype(np.float32))


def _ordered(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the same order as the floats."""
    bits = a.view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(U)


def icws_bands(h: np.ndarray, w: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) band keys. Each sample is the shingle with the least a = c / (y e^r), y on the shingle's own grid."""
    r_pool, c_pool, b_pool = _pool()
    base = _ordered((c_pool - r_pool * (1 - b_pool)).astype(np.float32)) << U(32)  # ln a for weight 1: the grid step t is 0
    h = h.view(U)
    log_w = np.log(w).astype(np.float32)
    g = np.random.default_rng(7)
    seeds = [U(g.integers(1 << 63)) for _ in range(bands * rows)]
    keys = np.zeros((len(offsets) - 1, bands), U)
    # texts go in slices whose arrays stay in the processor's cache
    cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, offsets[-1], SLICE)), len(offsets) - 1))
    for first, last in zip(cuts, cuts[1:]):
        part = h[offsets[first] : offsets[last]]
        at = offsets[first:last] - offsets[first]
        low = mix(part) & U(0xFFFFFFFF)
        odd = np.flatnonzero(w[offsets[first] : offsets[last]] != 1)
        lw = log_w[offsets[first] : offsets[last]][odd]
        out = keys[first:last]
        for k, seed in enumerate(seeds):
            idx = (mix(part ^ seed) >> U(48)).view(np.int64)
            a = base[idx]
            if len(odd):
                i = idx[odd]
                r = r_pool[i]
                b = b_pool[i]
                a[odd] = _ordered(c_pool[i] - r * (np.floor(lw / r + b) - b + 1)) << U(32)
            least = np.minimum.reduceat(a | low, at) & U(0xFFFFFFFF)
            band = k // rows
            out[:, band] = mix(out[:, band] * U(31) + least + U(band + 1))
    return keys


MARKS = ["n", "w", *(f"m{i}" for i in range(MASK_WORDS))]


def masks(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Words of each set's bit mask: bit h mod (64 * MASK_WORDS) for every shingle h."""
    bit = mix(h.view(U)) % U(64 * MASK_WORDS)
    one = U(1) << (bit & U(63))
    word = bit >> U(6)
    return [np.bitwise_or.reduceat(np.where(word == U(k), one, U(0)), at) for k in range(MASK_WORDS)]


def band_keys(sets: DataFrame, weights: Weights, bands: int, rows: int) -> DataFrame:
    """(rid, keys) of representative sets, with their size n, weight w and mask."""
    shared = sets.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            h = lists.values.to_numpy()[off[0] : off[-1]]
            tf = b.column(2).values.to_numpy()[off[0] : off[-1]]
            off = off - off[0]
            w = shared.value(h, tf)
            keys = icws_bands(h, w, off, bands, rows)
            ends = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            marks = [pa.array(np.diff(off), pa.int64()), pa.array(np.add.reduceat(w, off[:-1]), pa.float64()), *map(_i64, masks(h, off[:-1]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, _i64(keys.ravel())), *marks], names=["rid", "keys", *MARKS])

    kinds = ", ".join(f"m{i} long" for i in range(MASK_WORDS))
    return sets.select("rid", "shingles", "tf").mapInArrow(run, f"rid long, keys array<long>, n long, w double, {kinds}")


def possible(pairs: DataFrame, marks: DataFrame, weighted: float, plain: float | None) -> DataFrame:
    """Pairs (a, b) whose similarities may reach the thresholds: none is lost.

    A bit of one mask that the other lacks stands for a shingle that the other
    set lacks, and no shingle weighs less than FLOOR.
    """
    left = marks.select(F.col("rid").alias("a"), *[F.col(c).alias(f"x_{c}") for c in MARKS])
    right = marks.select(F.col("rid").alias("b"), *[F.col(c).alias(f"y_{c}") for c in MARKS])
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    lack_x = sum((F.bit_count(F.col(f"x_m{i}").bitwiseAND(F.bitwise_not(f"y_m{i}"))) for i in range(MASK_WORDS)), F.lit(0))
    lack_y = sum((F.bit_count(F.col(f"y_m{i}").bitwiseAND(F.bitwise_not(f"x_m{i}"))) for i in range(MASK_WORDS)), F.lit(0))
    heavy = F.least(F.col("x_w") - FLOOR * lack_x, F.col("y_w") - FLOOR * lack_y)
    ok = heavy * (1 + weighted) >= weighted * (F.col("x_w") + F.col("y_w")) - 1e-6
    if plain is not None:
        most = F.least(F.col("x_n") - lack_x, F.col("y_n") - lack_y)
        ok = ok & (most * (1 + plain) >= plain * (F.col("x_n") + F.col("y_n")) - 1e-6)
    return both.where(ok).select("a", "b")


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the buckets of rows sorted by (key, rid); beyond ALL_PAIRS members only (first, member), marked with the key."""
    key, held = None, []
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        big: list[int | None] = []
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                key, held = k, [x]
            elif len(held) < ALL_PAIRS:
                a += held
                b += [x] * len(held)
                big += [None] * len(held)
                held.append(x)
            else:
                a.append(held[0])
                b.append(x)
                big.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(big, pa.int64())], names=["a", "b", "big"])


def verify(pairs: DataFrame, marks: DataFrame, sets: DataFrame, weights: Weights, weighted: float, plain: float | None) -> DataFrame:
    """(a, b) of the pairs whose similarity reaches the thresholds."""
    shared = sets.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            cols = [batch.column(i) for i in range(2, 6)]
            off = [c.offsets.to_numpy() for c in cols]
            val = [c.values.to_numpy() for c in cols]
            for i in range(batch.num_rows):
                x, tx, y, ty = (v[o[i] : o[i + 1]] for v, o in zip(val, off))
                _, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                if plain is not None and len(ix) < plain * (len(x) + len(y) - len(ix)):
                    continue
                wx, wy = shared.value(x, tx), shared.value(y, ty)
                inter = np.minimum(wx[ix], wy[iy]).sum()
                if inter >= weighted * (wx.sum() + wy.sum() - inter):
                    keep.append(i)
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(k), batch.column(1).take(k)], names=["a", "b"])

    pairs = materialize(possible(pairs, marks, weighted, plain), "possible")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "pair-ids")
    used = materialize(sets.join(small(ids), "rid", "left_semi").select("rid", "shingles", "tf"), "pair-sets")
    left = used.toDF("a", "xa", "ta")
    right = used.toDF("b", "xb", "tb")
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "ta", "xb", "tb")
    return full.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str, text: str, n: int = 5, weighted: float = 0.8, plain: float | None = None, bands: int = BANDS, rows: int = ROWS, singles: bool = False) -> DataFrame:
    """(id, group_id, links): texts linked to another one, with the smallest id of their group.

    Two texts are linked if the weighted Jaccard similarity of their runs of
    ``n`` words is at least ``weighted`` and, if ``plain`` is given, the plain
    Jaccard similarity of the sets at least ``plain``. ``links`` counts
    verified candidate partners, with copies (texts of equal sets) counting
    through one representative. NULL, empty and shorter texts link to nothing;
    rows repeating an id count once (the first text in string order). With
    ``singles``, texts without a partner come out as groups of one. Other
    columns of ``df`` are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    sets = materialize(shingle_sets(docs, n).withColumn("rid", F.xxhash64("id")), "shingles")
    if sets.groupBy("rid").count().where("count > 1").limit(1).count():
        once = docs.groupBy("id").agg(F.min("text").alias("text"))
        sets = materialize(shingle_sets(once, n).withColumn("rid", F.xxhash64("id")), "shingles")
    # smallest id of each set of copies stands for them
    reps = materialize(sets.groupBy("fp1", "fp2").agg(F.min_by("rid", "id").alias("rep"), F.count("*").alias("copies")), "copies")
    groups = sets.select("id", "rid", "fp1", "fp2")
    hot = reps.where("copies > 1")
    copies = materialize(groups.join(hot, ["fp1", "fp2"]).where("rid <> rep").select(F.col("rep").alias("a"), F.col("rid").alias("b")), "copy-links")
    uniq = sets.select("rid", "shingles", "tf")
    if copies.limit(1).count():
        # the copies leave, so the sets stay where they are unless there are many copies
        uniq = materialize(uniq.join(small(copies.select(F.col("b").alias("rid"))), "rid", "left_anti"), "sets")
    values, counts, total = heavy_hitters(uniq, "shingles", FREQUENT)
    weights = Weights(values, counts, total)
    keys = materialize(band_keys(uniq, weights, bands, rows), "bands")
    hot_keys, hot_n, _ = heavy_hitters(keys, "keys", FREQUENT, ALL_PAIRS + 1)
    flat = keys.select(F.explode("keys").alias("key"), "rid")
    spark = df.sparkSession
    stars = None
    if len(hot_keys):
        hot_df = F.broadcast(spark.createDataFrame([(int(k),) for k in hot_keys], "key long"))  # at most bands / FREQUENT rows
        pivot = F.broadcast(materialize(flat.join(hot_df, "key").groupBy("key").agg(F.min("rid").alias("a")), "pivots"))
        stars = flat.join(pivot, "key").where("rid <> a").select("a", F.col("rid").alias("b"), F.col("key").alias("big"))
        flat = flat.join(hot_df, "key", "left_anti")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = flat.repartition(parts, "key").sortWithinPartitions("key", "rid").mapInArrow(_bucket_pairs, "a long, b long, big long")
    if stars is not None:
        found = found.unionByName(stars)
    found = materialize(found, "candidates")
    pairs = found.select("a", "b").distinct()
    linked = materialize(verify(pairs, keys, uniq, weights, weighted, plain).unionByName(copies), "links")
    big = found.where("big is not null").select(F.col("big").alias("key")).distinct()
    if big.limit(1).count():
        linked = _large_buckets(keys, materialize(big, "big"), linked, uniq, weights, weighted, plain)
    names = groups.select("id", "rid")
    touched = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "rid")
    named = connected_components(linked, "a", "b", "rid", "comp")
    member = materialize(names.join(named.join(touched, "rid"), "rid"), "members")
    least = member.groupBy("comp").agg(F.min("id").alias("group_id"))
    out = member.join(least, "comp").select("id", "group_id", "links")
    if singles:
        rest = df.select(F.col(id_col).alias("id")).where("id is not null").distinct().join(out, "id", "left_anti")
        out = out.unionByName(rest.select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("links")))
    return out


def _large_buckets(keys: DataFrame, big: DataFrame, linked: DataFrame, sets: DataFrame, weights: Weights, weighted: float, plain: float | None) -> DataFrame:
    """Links still missing in large buckets: members outside a bucket's largest group against the other groups of the bucket."""
    comp = connected_components(linked, "a", "b", "rid", "comp")
    rows = keys.select(F.explode("keys").alias("key"), "rid").join(big, "key", "left_semi").join(comp, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    rows = materialize(rows, "large")
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    loose = rows.join(largest, "key").where("comp <> top").select("key", F.col("rid").alias("x"), F.col("comp").alias("cx"))
    # a bucket is split, and each part meets copies of its loose members
    parts = sizes.groupBy("key").agg((1 + F.sum("n") / BUCKET_PART).cast("int").alias("parts"))
    split = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part")
    rows = rows.join(parts, "key").select("key", "rid", "comp", split)
    loose = loose.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = materialize(rows.join(loose, ["key", "part"]).where("comp <> cx").select(F.least("rid", "x").alias("a"), F.greatest("rid", "x").alias("b")).distinct(), "loose")
    if not pairs.limit(1).count():
        return linked
    members = small(materialize(rows.select("rid").distinct(), "large-ids"))
    return materialize(verify(pairs, keys.join(members, "rid", "left_semi"), sets, weights, weighted, plain).unionByName(linked.select("a", "b")).distinct(), "links")
