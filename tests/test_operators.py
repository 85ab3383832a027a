"""Snapshots, matching, taxonomy, guard, sources and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from biblyst.operators import graph, match, persons, search, snapshot, taxonomy, telemetry
from biblyst.plans.guard import Rejected, guarded_sql
from biblyst.sources import redif, reference_files
from biblyst.sources.citations import explode_edges, stream_edges
from biblyst.streaming import windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_diff_and_apply(spark):
    base = spark.createDataFrame([("h1", 10, 1), ("h2", 5, 1), ("h4", None, 1)], "handle string, total int, at int")
    new = spark.createDataFrame([("h1", 10, 2), ("h2", 7, 2), ("h3", 1, 2)], "handle string, total int, at int")
    d = snapshot.diff(base, new, ["handle"], ("at",))
    assert rows(d.select("handle", "total", "operation")) == [("h2", 7, "UPDATE"), ("h3", 1, "NEW"), ("h4", None, "DELETE")]
    assert rows(snapshot.apply_diff(base, d, ["handle"]).select("handle", "total")) == [("h1", 10), ("h2", 7), ("h3", 1)]
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()
    e1 = spark.createDataFrame([("a", "b"), ("a", "c")], "citing string, cited string")
    e2 = spark.createDataFrame([("a", "b"), ("a", "d")], "citing string, cited string")
    assert rows(snapshot.diff(e1, e2, ["citing", "cited"], edges=True)) == [("a", "c", "DELETE"), ("a", "d", "NEW")]
    with pytest.raises(ValueError):
        snapshot.diff(base, new.select("total", "handle", "at"), ["handle"])


def test_patches(spark, tmp_path):
    a = spark.createDataFrame([("x", "A", None), ("y", "B", "old")], "Handle string, title string, doi string")
    p = spark.createDataFrame([("x", "10.1/t"), ("y", None)], "Handle string, doi string")
    out = snapshot.apply_patch(a, p, "update_columns", ["Handle"])
    assert rows(out) == [("x", "A", "10.1/t"), ("y", "B", None)] == rows(snapshot.apply_patch(out, p, "update_columns", ["Handle"]))
    with pytest.raises(ValueError):
        snapshot.apply_patch(a, p.withColumn("nope", F.lit(1)), "update_columns", ["Handle"])
    with pytest.raises(ValueError):
        snapshot.check_patch(p.union(p), ["Handle"])
    snapshot.write_patch(p, str(tmp_path / "p"), "articles", "update_columns", ["Handle"])
    back, manifest = snapshot.read_patch(spark, str(tmp_path / "p"))
    assert rows(back) == rows(p) and manifest["keys"] == ["Handle"]
    s = snapshot.Snapshots(spark, str(tmp_path / "s"))
    s.dump({"articles": a}, "1")
    s.dump({"articles": out}, "2")
    assert s.current() == "2" and s.stamps() == ["1", "2"] and rows(s.table("articles", "1")) == rows(a)
    assert rows(s.counts(["articles"])) == [("articles", 2, 1.0)]
    assert snapshot.migrate(a, {"year": "int"}).columns[-1] == "year"


def test_title_match(spark):
    p = spark.createDataFrame([("P1", "s", "The effect of minimum wages on teenage employment", 2010), ("P3", "s", "A stochastic frontier analysis of banks: evidence from panel data", 2010), ("P4", "s", "Introduction", 2010)], "handle string, source string, title string, year int")
    w = spark.createDataFrame([("10.1017/exact", "s", "Effect of Minimum Wages on Teenage Employment", 2011), ("10.1017/trunc", "s", "A stochastic frontier analysis of banks", 2010), ("10.1017/intro", "s", "Introduction", 2010), ("10.5555/foreign", "s", "Effect of minimum wages on teenage employment", 2010)] + [(f"10.1017/{k}", "s", "x", 1990) for k in range(40)], "doi string, source string, title string, year int")
    trusted = match.trusted_prefixes(w)
    assert [r["prefix"] for r in trusted.collect()] == ["10.1017"]
    assert [(r["handle"], r["doi"]) for r in match.title_match(p, w, trusted, None).collect()] == [("P1", "10.1017/exact")]
    assert {(r["handle"], r["doi"], r["match_type"]) for r in match.title_match(p, w, trusted).collect()} == {("P1", "10.1017/exact", "exact"), ("P3", "10.1017/trunc", "fuzzy")}


def test_priority_and_freshest(spark):
    a = spark.createDataFrame([("h1", "1")], "handle string, doi string")
    b = spark.createDataFrame([("h1", "2"), ("h2", "3")], "handle string, doi string")
    assert rows(match.priority_union([a, b], "handle")) == [("h1", "1"), ("h2", "3")]
    w = spark.createDataFrame([("d", 1, 10), ("d", 2, 5), (None, 3, 1)], "doi string, day int, n int")
    assert rows(match.freshest(w, "doi", F.desc("day"))) == [("d", 2, 5)]


def test_percent_rank_plan_and_values(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(50)], "i int, n int")
    out = graph.percent_rank(df, "n", "p")
    want = df.withColumn("p", F.percent_rank().over(__import__("pyspark").sql.Window.orderBy("n")))
    assert rows(out.select("i", F.round("p", 9))) == rows(want.select("i", F.round("p", 9)))
    assert graph.percent_rank(df.limit(1), "n", "p").first()["p"] == 0.0


def test_years_stay_with_their_counts(spark):
    cite = spark.createDataFrame([("h", 2001), ("h", 2000), ("h", 2000)], "cited string, year int")
    assert graph.citations_by_year(cite).first()[1:] == ([2000, 2001], [2, 1])
    assert rows(graph.mode(cite.withColumnRenamed("cited", "k"), ["k"], "year", "m")) == [("h", 2000)]


def test_search_properties(spark):
    a = spark.createDataFrame([(f"h{k}", f"Wage {k}% of_x", 2000 + k, [float(k), 1.0]) for k in range(20)] + [("z", None, None, None)], "handle string, title string, year int, embeddings array<float>")
    v = [7.0, 1.0]
    full = search.semantic_search(a, v, 5)
    assert full.first()["handle"] == "h7" and full.count() == 5
    assert search.semantic_search(a, v, 5, search.paper_filters(2010), pool=3).count() <= 3
    assert search.keyword_search(a, ["%"]).count() == 20 and search.keyword_search(a, ["_"]).count() == 20 and search.keyword_search(a, ["wage", "zz"], match="all").count() == 0
    with pytest.raises(ValueError):
        search.keyword_search(a, [" "])
    assert not set(r[0] for r in search.page(a, [F.col("handle")], 5).collect()) & set(r[0] for r in search.page(a, [F.col("handle")], 5, 5).collect())


def test_person_search_weight_zero_is_overlap(spark):
    hits = spark.createDataFrame([("a", "T", 0.9), ("b", "t ", 0.8), ("c", None, 0.5)], "handle string, title string, similarity double")
    works = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "b")], "short_id string, work_handle string")
    stats = spark.createDataFrame([("p", 10, 2000)], "short_id string, total_citations long, last_year int")
    got = {r["short_id"]: (r["score"], r["n_hits"], r["evidence"]) for r in persons.person_search(hits, works, stats, "breadth", 0.0).collect()}
    assert got == {"p": (1.4, 2, "a|c"), "q": (0.8, 1, "b")}


def test_taxonomy(spark):
    t = spark.createDataFrame([("J", "Labour", 1, None), ("J3", "Wages", 2, "J"), ("J31", "Wage level", 3, "J3"), ("K", "Law", 1, None)], "code string, label string, level int, parent string")
    assert [r[0] for r in taxonomy.closure(t, "level").orderBy("code").collect()] == ["J", "J3", "J31"]
    with pytest.raises(ValueError):
        taxonomy.with_codes(t.withColumnRenamed("label", "handle"), t, ["bad!"], strict=True)


def test_guard(spark):
    t = {"articles": spark.createDataFrame([("a",), ("b",)], "Handle string"), "journals": spark.createDataFrame([(1,)], "id int")}
    ok = ["SELECT * FROM articles", "WITH x AS (SELECT * FROM articles) SELECT count(*) AS n FROM x", "SELECT a.* FROM articles a JOIN journals j ON true", "SELECT Handle FROM articles UNION ALL SELECT Handle FROM articles", "SELECT * FROM articles WHERE Handle IN (SELECT Handle FROM articles) LIMIT 1"]
    for q in ok:
        guarded_sql(spark, q, t).collect()
    bad = ["DROP TABLE articles", "INSERT INTO articles VALUES ('x')", "SELECT 1; SELECT 2", "SELECT * FROM secret", "SELECT * FROM other.articles", "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "SELECT * FROM articles WHERE Handle IN (SELECT s FROM secret)", "SELECT java_method('java.lang.System', 'exit', 1) FROM articles", "SELECT * FROM range(5)", "SELECT * FROM parquet.`/tmp/x`", "nonsense"]
    for q in bad:
        with pytest.raises(Rejected):
            guarded_sql(spark, q, t)
    big = {"articles": spark.range(6000).toDF("Handle")}
    assert guarded_sql(spark, "SELECT * FROM articles -- limit 9000", big).count() == 5000
    assert guarded_sql(spark, "SELECT * FROM articles LIMIT 5500", big).count() == 5500


def test_templates(spark, tmp_path):
    (tmp_path / "a.rdf").write_text("junk\nTemplate-Type: ReDIF-Article 1.0\nAuthor-Name: Ann Lee\nAuthor-Name: Bo Ek\nTitle: A long\n  title\nYear: 1999\nX-DOI: doi:10.1234/AB\nClassification-JEL: J31 K1\nHandle: RePEc:aaa:jour:v:1\n\nTemplate-Type: ReDIF-Person 1.0\nShort-Id: PX1\nWorkplace-Name: N\nWorkplace-Institution: RePEc:edi:X\nWorkplace-Share: n/a\nAuthor-Article: RePEc:AAA:jour:v:1\nHandle: RePEc:per:x\n")
    t = redif.read_templates(spark, str(tmp_path))
    e = redif.entries(t, 2026).first()
    assert (e["title"], e["year"], e["authors"], e["doi"], e["jel"], e["is_series"]) == ("A long title", 1999, "Ann Lee; Bo Ek", "10.1234/ab", ["J31", "K1"], False)
    assert rows(redif.person_works(t)) == [("px1", "repec:aaa:jour:v:1", "article")]
    w = redif.person_workplaces(t).first()
    assert (w["rank"], w["institution"], w["share"]) == (1, "repec:edi:x", None)


def test_reference_files(spark, tmp_path):
    good = spark.createDataFrame([("RePEc:aaa:ser%04d\t1.5\t1\t1\t1\t12\t1\t1\t1\tx" % k,) for k in range(1200)] + [("# note",)], "value string")
    f = reference_files.series_factors(good)
    assert f.count() == 1200 and f.first()["simple_if"] == 1.5 and f.first()["euclid"] is None
    with pytest.raises(ValueError):
        reference_files.series_factors(good.limit(1))
    with pytest.raises(ValueError):
        reference_files.series_factors(good.union(spark.createDataFrame([("RePEc:a\t1\t2",)], "value string")))
    r = spark.createDataFrame([('{"s": {"isversionof": {"t": "1", "u": "1"}}}',)], "value string")
    assert rows(reference_files.related_works(r)) == [("s", "t", "isversionof"), ("s", "u", "isversionof")]
    (tmp_path / "j.xml").write_text("<d><classification><code>J</code><description>Labour</description><classification><code>J3</code><description>Wages</description></classification></classification></d>")
    assert rows(reference_files.jel_tree(spark, str(tmp_path / "j.xml"), 2)) == [("J", "Labour", 1, None), ("J3", "Wages", 2, "J")]


def test_citation_lines_batch_and_stream(spark, tmp_path):
    lines = spark.createDataFrame([("RePEc:A:b  x#Y,,z",), ("alone",), ("",), (None,)], "value string")
    assert rows(explode_edges(lines)) == [("repec:a:b", "x"), ("repec:a:b", "y"), ("repec:a:b", "z")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("a b#c\n")
    for _ in range(2):  # the second run finds nothing new
        stream_edges(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", "b"), ("a", "c")]


def test_streamed_windows_and_timeouts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    ev = [(1, t0 + dt.timedelta(minutes=m), "view") for m in (0, 10, 70)] + [(2, t0, "done"), (9, t0 + dt.timedelta(days=3), "view")]
    spark.createDataFrame(ev, "user_id long, ts timestamp_ntz, type string").write.parquet(str(tmp_path / "in"))
    s = windows.read_events(spark, str(tmp_path / "in"), "user_id long, ts timestamp_ntz, type string")
    windows.run_to_table(windows.accepted(s, "1 hour", 1, "2 hours"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = rows(spark.read.parquet(str(tmp_path / "o")).select("user_id", "n", "accepted"))
    assert got[:3] == [(1, 1, True), (1, 2, False), (2, 1, True)]
    runs = windows.read_events(spark, str(tmp_path / "in"), "user_id long, ts timestamp_ntz, type string").withColumnRenamed("user_id", "run_id")
    windows.run_to_table(windows.timeouts(runs, 1), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert (2, "done") in rows(spark.read.parquet(str(tmp_path / "o2")))


def test_rate_limit_and_first_write(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(k, t0 + dt.timedelta(minutes=k), 1) for k in range(5)], "event_id long, ts timestamp_ntz, user_id long")
    assert telemetry.rate_limit(ev, 3600, 2).where("accepted").count() == 2
    store = spark.createDataFrame([("a", 1)], "h string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "h string, v int")
    assert rows(telemetry.first_write_wins(store, new, "h", F.col("v"))) == [("a", 1), ("b", 3)]


def test_coupling_counts_hubs(spark):
    from itertools import combinations

    # h1, h2, h3 are cited by more than ``hot`` articles, r by two of them; NULL ends and repeats occur
    refs = {f"a{i:02}": {"h1"} | ({"h2"} if i % 2 else set()) | ({"h3"} if i % 3 == 0 else set()) | ({"r"} if i in (2, 3) else set()) | {f"own{i}"} for i in range(24)}
    edges = [(a, r) for a, rs in refs.items() for r in rs]
    df = spark.createDataFrame([*edges, *edges[:9], (None, "h1"), ("a00", None)], "citing string, cited string")
    size = {a: len(r) + (a == "a00") for a, r in refs.items()}
    for least in (1, 2, 3):
        want = {(a, b, s, round(s / (size[a] + size[b] - s), 6)) for a, b in combinations(sorted(refs), 2) if (s := len(refs[a] & refs[b])) >= least}
        for hot in (2, 5, 50):
            got = [(r["a"], r["b"], r["shared"], round(r["strength"], 6)) for r in graph.coupling(df, least, hot).collect()]
            assert len(got) == len(set(got)) and set(got) == want, (least, hot)
