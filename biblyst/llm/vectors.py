"""The k most similar vectors for every vector: an inverted multi-index, reranked exactly.

Each vector is cut in two halves, each half has its own codebook, and a cell is
a pair of centroids. A query visits cells in the order of the summed distances
of its halves (the order in which a heap over the two sorted lists pops the
pairs) until the visited cells hold ``entries`` vectors; those are reranked by
exact cosine similarity.

Distribution: cells are grouped to a few blocks of space. A vector goes to its
own block as data and query at once, and once to each other block in which it
visits cells, so what is shuffled is a small multiple of the vectors. A block
is searched cell by cell with matrix products. Blocks above their share split
their queries over several tasks, and their data where it outgrows a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.operators.skew import salted_lookup
from biblyst.session import materialize

#: Rows on which the codebooks are fitted, at least (16 a code where that is more). All rows are indexed.
SAMPLE = 20_000
#: Vectors visited by a query before it stops (more: higher recall, more work).
ENTRIES = 512
#: Average vectors per cell that sets the codebook size; size of the largest codebook, whose
#: cells' sizes still fit a broadcast (MAX_CODES ** 2 numbers). Beyond it cells grow fuller, and a
#: query visits CELLS average cells instead of ENTRIES vectors, so recall doesn't fall with the size.
PER_CELL, MAX_CODES, CELLS = 16, 2048, 32
BLOCKS, BLOCK_ROWS = 8, 40_000
QUERY_CHUNK = 40_000


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from a seeded start; at most as many as there are rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = (2 * x @ c.T - (c**2).sum(1)).argmax(1)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def heap_order(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) in ascending d1[i] + d2[j] by a heap over the two sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap = [(d1[o1[0]] + d2[o2[0]], 0, 0)]
    seen = {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield int(o1[a]), int(o2[b])
        for n in ((a + 1, b), (a, b + 1)):
            if n[0] < len(o1) and n[1] < len(o2) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (d1[o1[n[0]]] + d2[o2[n[1]]], *n))


def codes(rows: int) -> int:
    """Size of each codebook for so many vectors."""
    return int(np.clip(2 ** round(np.log2(max(rows / PER_CELL, 1)) / 2), 1, MAX_CODES))


class MultiIndex:
    """Codebooks, cell sizes and the blocks of cells."""

    def __init__(self, sample: np.ndarray, rows: int, entries: int) -> None:
        h = sample.shape[1] // 2
        k = codes(rows)
        self.half, self.entries = h, entries if k < MAX_CODES else max(entries, -(-CELLS * rows // k**2))
        self.c1, self.c2 = kmeans(sample[:, :h], k), kmeans(sample[:, h:], k)
        self.k2 = len(self.c2)
        blocks = kmeans(sample, max(BLOCKS, -(-rows // BLOCK_ROWS)), seed=9)
        both = np.concatenate([np.repeat(self.c1, self.k2, 0), np.tile(self.c2, (len(self.c1), 1))], 1)
        self.block = np.concatenate([distances(both[i : i + 65536], blocks).argmin(1) for i in range(0, len(both), 65536)]).astype(np.int32)
        self.sizes = np.zeros(len(both), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return distances(x[:, : self.half], self.c1).argmin(1) * self.k2 + distances(x[:, self.half :], self.c2).argmin(1)

    def visits(self, x: np.ndarray) -> list[np.ndarray]:
        """Cells each query visits: the heap's order, taken in slices.

        The n-th popped pair has ranks with (a + 1)(b + 1) <= n, so the first
        ``top`` pairs are found among those alone, for many queries at once.
        """
        d1, d2 = distances(x[:, : self.half], self.c1), distances(x[:, self.half :], self.c2)
        o1, o2 = np.argsort(d1, 1), np.argsort(d2, 1)
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        out: list[np.ndarray | None] = [None] * len(x)
        todo = np.arange(len(x))
        top = 64
        total = len(self.sizes)
        while len(todo):
            top = min(top, total)
            a, b = np.nonzero(np.arange(1, s1.shape[1] + 1)[:, None] * np.arange(1, s2.shape[1] + 1) <= top)
            for part in np.array_split(todo, max(1, len(todo) * len(a) // 20_000_000)):
                sums = s1[part][:, a] + s2[part][:, b]
                if top < sums.shape[1]:
                    best = np.argpartition(sums, top - 1, 1)[:, :top]
                    best = np.take_along_axis(best, np.argsort(np.take_along_axis(sums, best, 1), 1), 1)
                else:
                    best = np.argsort(sums, 1)
                cells = o1[part][np.arange(len(part))[:, None], a[best]] * self.k2 + o2[part][np.arange(len(part))[:, None], b[best]]
                cum = np.cumsum(self.sizes[cells], 1)
                need = (cum < self.entries).sum(1) + 1
                for r, q in enumerate(part):
                    if need[r] <= cells.shape[1] or top == total:
                        c = cells[r, : need[r]]
                        out[q] = c[self.sizes[c] > 0]
            todo = np.array([q for q in todo if out[q] is None], int)
            top *= 4
        return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.float32).reshape(-1, dim)


def unit_vectors(df: DataFrame, id_col: str, vec: str, dim: int) -> DataFrame:
    """(id, vid, vec): usable vectors as unit float32 bytes; ``vid`` is a hash of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.asarray(lists.value_lengths().fill_null(0))
            ok = np.flatnonzero(size == dim)
            part = lists.take(pa.array(ok))
            x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            x[~np.isfinite(x)] = np.nan  # NULL elements read as NaN too
            norm = np.sqrt((x**2).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            x = np.ascontiguousarray((x[good] / norm[good][:, None]).astype(np.float32))
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * dim * 4, dim * 4, dtype=np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok[good])), raw], names=["id", "vec"])

    kind = df.schema[id_col].dataType.simpleString()
    flat = df.select(F.col(id_col), F.col(vec).cast("array<float>")).where(F.col(id_col).isNotNull() & F.col(vec).isNotNull())
    return flat.mapInArrow(run, f"id {kind}, vec binary").withColumn("vid", F.xxhash64("vec"))


def _route(index, dim: int, splits: np.ndarray, parts: np.ndarray, starts: np.ndarray):
    """Copies of each vector: (task, rid, cell or -1, visited cells, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dim)
            rid = b.column(0).to_numpy()
            cell = ix.cells(x)
            salt = (rid & 0x7FFFFFFF).astype(np.int64)
            take: list[int] = []
            task: list[int] = []
            own: list[int] = []
            seen: list[bytes] = []
            for i, c in enumerate(ix.visits(x)):
                home = int(ix.block[cell[i]])
                at = ix.block[c]
                mine = int(salt[i] % parts[home])
                blocks = set(at.tolist())
                blocks.add(home)
                for g in blocks:
                    visited = c[at == g].astype(np.int32).tobytes()
                    q = int(salt[i] % splits[g])
                    for p in range(parts[g]):
                        for s in range(splits[g]) if g == home and p == mine else (q,):
                            take.append(i)
                            task.append(int(starts[g]) + p * int(splits[g]) + s)
                            own.append(int(cell[i]) if g == home and p == mine else -1)
                            seen.append(visited if s == q else b"")
            k = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), b.column(0).take(k), pa.array(own, pa.int32()), pa.array(seen, pa.binary()), b.column(1).take(k)], names=["task", "rid", "cell", "visits", "vec"])

    return run


def _search(k: int, dim: int):
    """Top k per query of the rows of one or more tasks, sorted by task with data (cell >= 0) first."""

    def answer(data: tuple, rid: np.ndarray, x: np.ndarray, visits: list[bytes]) -> pa.RecordBatch:
        cells, drid, dx = data
        lens = np.array([len(v) // 4 for v in visits])
        q = np.repeat(np.arange(len(visits)), lens)
        c = np.frombuffer(b"".join(visits), np.int32)
        order = np.argsort(c, kind="stable")
        q, c = q[order], c[order]
        cut = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, int)
        ends = np.append(cut[1:], len(c)) if len(c) else cut
        lo, hi = np.searchsorted(cells, c[cut]), np.searchsorted(cells, c[cut], side="right")
        qs, ss, ns = [], [], []
        for a, e, l0, h0 in zip(cut, ends, lo, hi):
            if l0 == h0:
                continue
            for l in range(l0, h0, 4096):
                h = min(h0, l + 4096)
                who = q[a:e]
                for w in np.array_split(who, max(1, len(who) * (h - l) // 8_000_000)):
                    sims = x[w] @ dx[l:h].T
                    sims[rid[w][:, None] == drid[l:h]] = -2
                    if h - l > k:
                        best = np.argpartition(-sims, k - 1, 1)[:, :k]
                        sims = np.take_along_axis(sims, best, 1)
                        near = drid[l:h][best]
                    else:
                        near = np.broadcast_to(drid[l:h], sims.shape)
                    qs.append(np.repeat(w, sims.shape[1]))
                    ss.append(sims.ravel())
                    ns.append(near.ravel())
        if not qs:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=["rid", "near", "sim"])
        qs, ss, ns = np.concatenate(qs), np.concatenate(ss), np.concatenate(ns)
        keep = ss > -2
        qs, ss, ns = qs[keep], ss[keep], ns[keep]
        order = np.lexsort((ns, -ss, qs))
        qs, ss, ns = qs[order], ss[order], ns[order]
        first = np.searchsorted(qs, qs)
        keep = np.arange(len(qs)) - first < k
        return pa.RecordBatch.from_arrays([pa.array(rid[qs[keep]]), pa.array(ns[keep]), pa.array(ss[keep], pa.float32())], names=["rid", "near", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, data = None, None
        held: list[tuple] = []
        asked: list[tuple] = []

        def close() -> tuple:
            if not held:
                return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
            c, r, m = (np.concatenate(z) for z in zip(*held))
            o = np.argsort(c, kind="stable")
            return c[o], r[o], m[o]

        def flush() -> Iterator[pa.RecordBatch]:
            for r, m, v in asked:
                for i in range(0, len(r), QUERY_CHUNK):
                    yield answer(data, r[i : i + QUERY_CHUNK], m[i : i + QUERY_CHUNK], v[i : i + QUERY_CHUNK])
            asked.clear()

        for b in batches:
            tasks = b.column(0).to_numpy()
            cut = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1])) if len(tasks) else []
            for a, e in zip(cut, [*cut[1:], len(tasks)]):
                if tasks[a] != task:
                    if asked:
                        data = close() if data is None else data
                        yield from flush()
                    task, data = tasks[a], None
                    held.clear()
                p = b.slice(a, e - a)
                cell, rid, x = p.column(2).to_numpy(), p.column(1).to_numpy(), _matrix(p.column(4), dim)
                own = cell >= 0
                if own.any():
                    held.append((cell[own], rid[own], x[own]))
                v = p.column(3).to_pylist()
                ask = np.array([len(z) > 0 for z in v], bool)
                asked.append((rid[ask], x[ask], [z for z in v if z]))
                # rows with cell -1 come last: by then all data of the task is held
                if not own.all():
                    data = close() if data is None else data
                    yield from flush()
        if asked:
            data = close() if data is None else data
            yield from flush()

    return run


def nearest(df: DataFrame, id_col: str, vec: str, dim: int, k: int, entries: int = ENTRIES) -> DataFrame:
    """(id, near_id, sim, rank): for every usable vector the k most similar other vectors.

    Usable are vectors of exactly ``dim`` finite numbers not all zero; others
    give no row and are nobody's neighbour. Repeated ids count once. Equal
    vectors have similarity 1 and come first, by id; other ties are broken by an
    internal id. With fewer than k other vectors, all come out. Other columns
    are ignored.
    """
    spark = df.sparkSession
    vecs = unit_vectors(df, id_col, vec, dim)
    members = vecs.groupBy("id").agg(F.min("vid").alias("rid"))
    uniq = materialize(vecs.groupBy(F.col("vid").alias("rid")).agg(F.min("vec").alias("vec")), "vectors")
    rows = uniq.count()
    # smallest k + 1 ids of each distinct vector: all that a list of k can need
    ranked = members.groupBy("rid", F.pmod(F.xxhash64("id"), F.lit(64)).alias("s")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    copies = materialize(ranked.groupBy("rid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "copies")
    if rows:
        drawn = max(SAMPLE, 16 * codes(rows))
        some = uniq.where(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, 1.2 * drawn / rows) * (1 << 30))).select("vec").limit(drawn)
        sample = np.stack([np.frombuffer(r[0], np.float32) for r in some.collect()] or [np.ones(dim, np.float32)])
        index = MultiIndex(sample, rows, entries)
        bare = spark.sparkContext.broadcast(index)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    c, n = np.unique(bare.value.cells(_matrix(b.column(0), dim)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

        filled = uniq.select("vec").mapInArrow(assign, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most MAX_CODES ** 2 rows
        index.sizes[filled["cell"].to_numpy(np.int64)] = filled["n"].to_numpy(np.int64)
        size = np.bincount(index.block, weights=index.sizes)
        share = max(1.5 * rows / len(size), 10_000)
        splits = np.maximum(1, np.ceil(size / share)).astype(int)
        parts = np.maximum(1, np.ceil(size / (2 * BLOCK_ROWS))).astype(int)
        starts = np.append(0, np.cumsum(splits * parts))
        full = spark.sparkContext.broadcast(index)
        sent = uniq.mapInArrow(_route(full, dim, splits, parts, starts), "task int, rid long, cell int, visits binary, vec binary")
        sent = sent.repartitionById(int(starts[-1]), F.col("task")).sortWithinPartitions("task", F.col("cell") < 0)
        found = sent.mapInArrow(_search(k, dim), "rid long, near long, sim float")
    else:
        found = spark.createDataFrame([], "rid long, near long, sim float")
    lists = found.groupBy("rid").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "near")), False), 1, k).alias("n"))
    lists = materialize(lists, "lists")
    # neighbours' ids in order, then the query's own copies in front
    near = lists.select("rid", F.posexplode("n").alias("p", "x")).select("rid", "p", F.col("x.near").alias("near"), F.col("x.sim").alias("sim"))
    near = near.join(copies.withColumnRenamed("rid", "near"), "near").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("p", "sim", "ids"))).alias("n"))
    flat = F.slice(F.flatten(F.transform("n", lambda e: F.transform(e["ids"], lambda i: F.struct(i.alias("near_id"), e["sim"].alias("sim"))))), 1, k)
    near = near.select("rid", flat.alias("far"))
    groups = copies.join(near, "rid", "left")
    kind = groups.schema["ids"].dataType.elementType.simpleString()
    groups = groups.withColumn("far", F.coalesce("far", F.array().cast(f"array<struct<near_id:{kind},sim:float>>")))
    counts = members.groupBy("rid").agg(F.count("*").alias("_n"))
    whole = salted_lookup(members, materialize(groups.join(counts, "rid"), "groups"), ["rid"])
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(i.alias("near_id"), F.lit(1.0).cast("float").alias("sim")))
    out = whole.select("id", F.posexplode(F.slice(F.concat(own, "far"), 1, k)).alias("p", "x"))
    return out.select("id", F.col("x.near_id").alias("near_id"), F.col("x.sim").alias("sim"), (F.col("p") + 1).alias("rank"))
