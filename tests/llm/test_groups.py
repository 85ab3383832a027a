"""Components, heavy hitters and near-duplicates against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from biblyst.llm import near_dup
from biblyst.llm.components import connected_components
from biblyst.llm.heavy import heavy_hitters
from biblyst.llm.near_dup import Weights, band_keys, icws_bands, near_duplicates, possible, shingle_sets
from biblyst.llm.text import WORD, distinct_runs


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components_random_hub_chain(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(200)]
    pairs += [("hub", f"m{k}") for k in range(400)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(40)] + [("loop", "loop"), ("a", "b"), ("b", "a"), ("a", "b")]
    df = spark.createDataFrame([*pairs, (None, "x"), ("y", None)], "s string, t string").withColumn("group", F.lit("clash"))
    got = {r["node"]: r["group"] for r in connected_components(df, "s", "t").collect()}
    assert got == union_find(pairs)
    assert connected_components(df.limit(0), "s", "t").count() == 0


def test_heavy_hitters_exact(spark):
    rng = random.Random(2)
    rows = [(sorted({rng.randrange(40) ** 2 for _ in range(6)}),) for _ in range(500)]
    want = Counter(v for (r,) in rows for v in r)
    values, counts, n = heavy_hitters(spark.createDataFrame(rows, "a array<long>").repartition(7), "a", 0.05)
    assert n == 500 and dict(zip(values.tolist(), counts.tolist())) == {v: c for v, c in want.items() if c >= 25}


def words(t):
    return WORD.findall(t.lower())


def brute(docs, n, least):
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, words(t)) for i, t in docs if t)}
    sets = {i: s for i, s in sets.items() if s}
    ids = sorted(sets)
    return union_find([(a, b) for x, a in enumerate(ids) for b in ids[:x] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


def corpus():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(4000)]
    docs = []
    for k in range(60):
        w = rng.choices(vocab, k=80)
        docs.append((f"d{k:03d}", " ".join(w)))
        for j in range(rng.randrange(3)):
            v = list(w)
            for _ in range(3):
                v[rng.randrange(80)] = rng.choice(vocab)
            docs.append((f"d{k:03d}x{j}", " ".join(v)))
    base = rng.choices(vocab, k=120)
    for k in range(70):  # one group too large for all its pairs
        v = list(base)
        v[k] = f"own{k}"
        docs.append((f"g{k:02d}", " ".join(v)))
    docs += [("same1", "Alpha beta, gamma delta EPSILON zeta eta"), ("same2", "alpha BETA gamma delta epsilon; zeta eta")] * 2
    return docs


def test_near_duplicates(spark):
    docs = corpus()
    df = spark.createDataFrame([*docs, ("null", None), ("empty", ""), ("short", "one two"), (None, "x")], "i string, t string").withColumn("group_id", F.lit(1))
    got = {r["id"]: r["group_id"] for r in near_duplicates(df, "i", "t", n=3, weighted=0.4, plain=0.5).collect()}
    want = brute(dict(docs).items(), 3, 0.5)
    assert got == want
    singles = near_duplicates(df, "i", "t", n=3, weighted=0.4, plain=0.5, singles=True)
    assert singles.count() == len({i for i, _ in docs}) + 3 and singles.where("id = 'null'").first()["links"] == 0
    assert near_duplicates(df.limit(0), "i", "t").count() == 0


def test_bounds_keep_every_similar_pair(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(base[: 40 + k] + [f"x{k}y{rng.randrange(9)}" for _ in range(k)])) for k in range(40)]
    sets = shingle_sets(spark.createDataFrame(docs, "id long, text string"), 3).withColumn("rid", F.col("id"))
    weights = Weights(np.zeros(0, np.int64), np.zeros(0, np.int64), 40)
    marks = band_keys(sets, weights, 4, 2)
    held = {r["id"]: set(r["shingles"]) for r in sets.collect()}
    pairs = [(a, b) for a in held for b in held if a < b]
    kept = {(r["a"], r["b"]) for r in possible(spark.createDataFrame(pairs, "a long, b long"), marks, 0.1, 0.5).collect()}
    similar = {(a, b) for a, b in pairs if len(held[a] & held[b]) >= 0.5 * len(held[a] | held[b])}
    assert similar and similar <= kept and len(kept) < len(pairs)


def test_bucket_of_several_large_groups(spark):
    # a run of words that all texts share brings several groups of more than ALL_PAIRS texts into the same buckets
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    docs = []
    for g in range(3):
        own = [f"g{g}w{k}" for k in range(50)]
        for j in range(45):
            v = list(own)
            v[rng.randrange(50)] = f"own{g}{j}"
            docs.append((f"d{g}-{j:02d}", " ".join(shared + v)))
    got = {r["id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(docs, "i string, t string"), "i", "t", n=3, weighted=0.1, plain=0.7).collect()}
    assert got == brute(dict(docs).items(), 3, 0.7) and len(set(got.values())) == 3


def test_long_text(spark):
    t = " ".join(f"w{k % 5003}" for k in range(60_000))
    got = near_duplicates(spark.createDataFrame([(1, t), (2, t + " tail"), (3, "else " * 10)], "i long, t string"), "i", "t")
    assert {(r["id"], r["group_id"]) for r in got.collect()} == {(1, 1), (2, 1)}


def test_samples_agree_as_often_as_sets_are_similar():
    h, c, off = distinct_runs([" ".join(f"w{k}" for k in range(0, 300)), " ".join(f"w{k}" for k in range(100, 400))], 1)
    w = np.where(h % np.uint64(2) == 0, 0.3, 1.0)
    keys = icws_bands(h, w, off, 2000, 1)
    a, b = (dict(zip(h[off[i] : off[i + 1]].tolist(), w[off[i] : off[i + 1]])) for i in (0, 1))
    want = sum(min(a[k], b[k]) for k in a if k in b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs((keys[0] == keys[1]).mean() - want) < 0.05


def test_weights():
    x = Weights(np.array([5, 9]), np.array([10, 1000]), 1000)
    w = x(np.array([5, 9, 7]), np.array([1, 1, 2]))
    assert w[1] < w[0] < 1 < w[2]


def test_few_copies_leave_without_a_shuffle_of_the_sets(spark, monkeypatch):
    plans = {}
    keep = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, label="t": (plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()), keep(df, label))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = corpus()
        got = {r["id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(docs, "i string, t string"), "i", "t", n=3, weighted=0.4, plain=0.5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(dict(docs).items(), 3, 0.5) and "Exchange hashpartitioning" not in plans["sets"]
