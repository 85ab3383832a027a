"""Orphan references against a brute-force version."""

import datetime as dt

from pyspark.sql import functions as F

from biblyst.operators.orphans import corpus_orphans, orphan_report
from biblyst.operators.skew import salted_lookup

T = [dt.datetime(2024, m, 1) for m in range(1, 7)]


def tables(spark):
    works = [("P1", "H1", "paper", T[1]), ("p1 ", "h2", "article", T[1]), ("p2", "h1", None, T[0]), ("p9", "j:1", "editor-series", T[2]), ("p1", "j:2", "editor-series", T[2]), (None, "h1", "paper", T[3]), ("p1", None, "paper", T[3]), ("p1", "", "paper", T[3]), ("p1", "h3", "paper", T[4]), ("p1", "h3", "paper", T[4])]
    cits = [("h1", " H3 ", t) for t in T] + [("h1", "h1", T[0])] + [("h2", "hot", T[k % 6]) for k in range(600)]
    persons = [("p1", T[0], None), ("p1", T[0], None), ("P2", T[0], T[3])]
    arts = [("H1", T[1], None), ("h3", T[2], T[3]), ("h3", T[5], None), ("h2", T[0], None)]
    ts = "timestamp_ntz"
    return (
        spark.createDataFrame(works, f"short_id string, work_handle string, work_type string, loaded_at {ts}"),
        spark.createDataFrame(cits, f"citing string, cited string, loaded_at {ts}"),
        spark.createDataFrame(persons, f"short_id string, loaded_at {ts}, removed_at {ts}"),
        spark.createDataFrame(arts, f"Handle string, loaded_at {ts}, removed_at {ts}"),
        spark.createDataFrame([("j:1",)], "series_handle string"),
    ), (works, cits, persons, arts)


def brute(works, cits, persons, arts):
    low = lambda s: None if s is None or not s.strip() else s.strip().lower()
    alive = lambda rows, k, t: any(low(h) == k and a <= t and (b is None or b > t) for h, a, b in rows)
    out = []
    for s, h, kind, t in works:
        if low(s) and not alive(persons, low(s), t):
            out.append(("person_works", "short_id", f"{t:%Y-%m}", low(s)))
        if low(h) and not (low(h) == "j:1" if kind == "editor-series" else alive(arts, low(h), t)):
            out.append(("person_works", "work_handle", f"{t:%Y-%m}", low(h)))
    for _, h, t in cits:
        if low(h) and not alive(arts, low(h), t):
            out.append(("cit_internal", "cited", f"{t:%Y-%m}", low(h)))
    return sorted(out)


def test_against_brute_force(spark):
    dfs, rows = tables(spark)
    found = corpus_orphans(*dfs)
    assert sorted(tuple(r) for r in found.select("ref_table", "ref_column", "period", "fk").collect()) == brute(*rows)
    report = {tuple(r)[:3]: tuple(r)[3:] for r in orphan_report(found).collect()}
    assert report["cit_internal", "cited", "2024-01"] == (102, 3)


def test_empty_tables(spark):
    dfs, _ = tables(spark)
    assert corpus_orphans(*[d.limit(0) for d in dfs]).count() == 0
    assert corpus_orphans(dfs[0], dfs[1], *[d.limit(0) for d in dfs[2:]]).count() == sum(1 for r in dfs[0].collect() for v in (r[0], r[1]) if v) + dfs[1].count()


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(900)], "k string, v int")
    lookup = rows.groupBy("k").agg(F.count("*").alias("_n"), F.max(F.length("k")).alias("x"))
    out = salted_lookup(rows, lookup, ["k"])
    assert out.count() == 900 and out.where("x <> length(k)").count() == 0
