"""The multi-index against brute force, its order against a heap."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from biblyst.llm.vectors import MultiIndex, heap_order, distances, nearest


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return [set(np.argsort(-r)[:k].tolist()) for r in s]


def test_recall_and_dirt(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((150, 16))
    x = np.concatenate([c + 0.15 * rng.standard_normal((8, 16)) for c in centres])
    rows = [(f"h{i:04d}", [float(v) for v in r * (1 + i % 3)]) for i, r in enumerate(x)]
    dirt = [("n1", None), ("n2", [1.0]), ("n3", [0.0] * 16), ("n4", [float("nan")] * 16), ("n5", [float("inf")] + [1.0] * 15), (None, [1.0] * 16), rows[0]]
    df = spark.createDataFrame(rows + dirt, "h string, v array<double>").withColumn("id", F.lit("clash")).withColumn("sim", F.lit(1))
    got = {}
    for r in nearest(df, "h", "v", 16, 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], int(r["near_id"][1:]), r["sim"]))
    assert set(got) == {h for h, _ in rows} and all(sorted(k for k, _, _ in v) == [1, 2, 3, 4, 5] for v in got.values())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = brute(u, 5)
    hit = sum(len(want[int(h[1:])] & {n for _, n, _ in v}) for h, v in got.items())
    assert hit / (5 * len(rows)) >= 0.9
    h, v = next(iter(got.items()))
    assert abs(v[0][2] - float(u[int(h[1:])] @ u[v[0][1]])) < 1e-5


def test_copies_and_small_tables(spark):
    same = [(f"c{k:02d}", [1.0, 2.0, 3.0, 4.0]) for k in range(40)]
    df = spark.createDataFrame([*same, ("x", [1.0, 2.0, 3.0, 5.0]), ("y", [-1.0, 0.0, 0.0, 0.0])], "h string, v array<float>")
    got = {}
    for r in nearest(df, "h", "v", 4, 5).orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["near_id"])
    assert got["c00"] == ["c01", "c02", "c03", "c04", "c05"] and got["c39"] == ["c00", "c01", "c02", "c03", "c04"]
    assert got["x"][:5] == ["c00", "c01", "c02", "c03", "c04"] and len(got["y"]) == 5
    assert nearest(df.limit(0), "h", "v", 4, 5).count() == 0
    assert nearest(df.limit(1), "h", "v", 4, 5).count() == 0
    assert nearest(df.where("h in ('x', 'y')"), "h", "v", 4, 5).count() == 2


def test_visits_follow_the_heap():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 8)).astype(np.float32)
    ix = MultiIndex(x, 3000, 200)
    c, n = np.unique(ix.cells(x), return_counts=True)
    ix.sizes[c] = n
    for q, cells in zip(x[:20], ix.visits(x[:20])):
        d1, d2 = distances(q[None, :4], ix.c1)[0], distances(q[None, 4:], ix.c2)[0]
        want, held = [], 0
        for i, j in itertools.islice(heap_order(d1, d2), len(ix.sizes)):
            held += ix.sizes[i * ix.k2 + j]
            if ix.sizes[i * ix.k2 + j]:
                want.append(i * ix.k2 + j)
            if held >= 200:
                break
        assert sorted(cells.tolist()) == sorted(want)
