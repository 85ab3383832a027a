"""Ingest, enrichment, logs, events, guard and facade on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from biblyst.corpus import Corpus
from biblyst.functions import text as T
from biblyst.operators import dois, enrich, events, ingest, search, snapshot, taxonomy, telemetry
from biblyst.plans.catalogue import STATEMENTS
from biblyst.plans.guard import Rejected, guarded_sql
from biblyst.sources import reference_files as files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("name", "sql", "verdict"), STATEMENTS)
def test_guard(spark, name, sql, verdict):
    tables = {"journals": spark.createDataFrame([("a", "x")], "archive string, long_name string")}
    if not verdict:
        assert guarded_sql(spark, sql, tables).count() == 1
        return
    with pytest.raises(Rejected, match=verdict.replace(".", r"\.")):
        guarded_sql(spark, sql, tables)


def test_guard_keeps_outer_limits(spark):
    tables = {"t": spark.range(20).toDF("n")}
    assert guarded_sql(spark, "SELECT n FROM t LIMIT 12", tables, rows=5).count() == 12
    assert guarded_sql(spark, "SELECT n FROM (SELECT n FROM t LIMIT 12)", tables, rows=5).count() == 5
    assert guarded_sql(spark, "WITH x AS (SELECT n FROM t) SELECT n FROM x LIMIT 9", tables, rows=5).count() == 9
    with pytest.raises(Rejected):
        guarded_sql(spark, "SELECT identifier('java_method')('java.lang.System', 'getProperty', 'user.home')", tables)


def test_values(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "c string").select(f(F.col("c"))).first()[0]
    assert one(T.slugify, "Wage-setting: who's in, 2020!") == "wage-setting-whos-in-2020" and one(T.slugify, "!?") == "search" and one(T.slugify, None) is None
    assert one(T.journal_name, "The J(ABC)ournal & Co") == "journal and co"
    assert [one(lambda c, k=k: T.address(c, F.lit(k)), "repec:a:b") for k in ("software", "editor-book", "editor-series", "other")] == [f"https://ideas.example/{x}/a/b.html" for x in "ebsp"]
    assert one(T.content_key, "Note on what this New Case or their evidence does") == "does what"
    import hashlib
    import hmac

    long = "k" * 70
    assert [one(lambda c, k=k: T.hmac_sha256(k, c), "message") for k in ("key", long)] == [hmac.new(k.encode(), b"message", hashlib.sha256).hexdigest() for k in ("key", long)]
    assert one(T.guess_from_article_url, "https://www.nature.com/articles/S41586_x?y") == "10.1038/s41586_x"


def test_containing_finds_every_substring(spark):
    texts = spark.createDataFrame([(i, t, 1 + i % 2) for i, t in enumerate(["the effects of wages", "wages", "wage", "", None, "lost wagers and the rest"])], "id int, t string, y int")
    needles = spark.createDataFrame([("a", "wage", 1), ("b", "the", 2), ("c", "xyz", 1), ("d", None, 1), ("e", "ab", 1)], "n string, w string, y int")
    want = sorted((n.n, t.id) for n in needles.collect() for t in texts.collect() if n.w and t.t and len(n.w) >= 3 and n.y == t.y and n.w in t.t)
    assert sorted((r["n"], r["id"]) for r in search.containing(needles, texts, "w", "t", "y").collect()) == want


def test_verify_finds_other_authors(spark):
    a = spark.createDataFrame([("h1", "Minimum wages and prices", 2001, "Dube, A. and Lester, B.", "J of X")], "handle string, title string, year int, authors string, journal string")
    e = spark.createDataFrame([("1", None, "Minimum wage effects", 2001, "Lester; Reich", "X"), ("2", None, "Minimum wages here", 2002, "Dube", None), ("3", None, "Minimum wages", 2001, "Nobody", None), ("4", "H1 ", None, None, None, None)], "entry_id string, handle string, title string, year int, authors string, journal string")
    got = {r["entry_id"]: (r["status"], r["handle"]) for r in Corpus(spark, {"articles": a.withColumnRenamed("handle", "Handle")}).verify(e).collect()}
    assert got == {"1": ("fuzzy_match", "h1"), "2": ("loose_match", "h1"), "3": ("not_found", None), "4": ("handle_match", "h1")}


def test_identifiers(spark, tmp_path):
    q = spark.createDataFrame([("a", "Ann Lee; B", 2000, False), ("b", None, 2000, False)], "handle string, authors string, year int, is_series boolean")
    c = spark.createDataFrame([("a", 1, "10.1234/x", "t", 2000, "report", "lee", 90.0), ("a", 2, "10.1234/y", "t", 2001, "journal-article", "kim lee", 86.0), ("b", 1, "10.1234/z", "t", 2000, "journal-article", "lee", 99.0)], "handle string, rank int, doi string, c_title string, c_year int, c_type string, c_authors string, score double")
    assert rows(dois.guard_candidates(q, c).select("handle", "doi")) == [("a", "10.1234/y")]
    now = spark.createDataFrame([("a", "10.1/old"), ("b", None), ("c", "10.1/c")], "handle string, doi string")
    part = lambda *r: spark.createDataFrame(list(r), "handle string, doi string")
    got = dois.finalize(now, {"crossref": part(("a", "10.1/f"), ("b", "10.1/f")), "url": part(("a", "10.1/u"), ("c", "10.1/c"), ("z", "10.1/z")), "openalex": part(("b", "10.1/o"))})
    assert rows(got) == [("a", "10.1/u", "url"), ("b", "10.1/o", "openalex")]
    with pytest.raises(ValueError):
        dois.finalize(now, {"other": now})
    ledger = str(tmp_path / "ledger")
    todo = spark.createDataFrame([(f"h{k:02d}",) for k in range(10)], "handle string")
    seen = []

    def evaluate(df):
        seen.append(df.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return df.withColumn("doi", F.lit(None).cast("string"))

    with pytest.raises(RuntimeError):
        dois.attempt(todo, ledger, evaluate, 4)
    rest = todo.join(spark.read.parquet(ledger), "handle", "left_anti")
    assert rest.count() == 2 and dois.attempt(rest, ledger, evaluate, 4) == 1 and spark.read.parquet(ledger).select("handle").distinct().count() == 10
    assert dois.attempt(todo.limit(0), ledger, evaluate, 4) == 0


def test_ingest(spark):
    rec = spark.createDataFrame([("H1", "journal = {}", "x" * 101, "Forthcoming", False, "a", "j", "doi:10.1234/A", 2), ("H1", "other", "x" * 101, "2000", False, "a", "j", None, 1), ("H2", None, "short", "2000", False, "a", "j", None, 1), ("H3", None, "x" * 101, "2005", True, "a", "?", None, 1), ("H4", None, "x" * 101, None, False, None, None, None, 1)], "Handle string, bib_tex string, abstract string, year string, is_series boolean, archive string, journal_code string, doi string, src int")
    j = spark.createDataFrame([("a", "j", "Journal", "Cat")], "archive string, journal_code string, long_name string, category string")
    f = spark.createDataFrame([("H1", 2, "later"), ("H1", 1, "first"), ("H1", 0, None)], "Handle string, position int, url string")
    assert rows(ingest.load_cleaned(rec, j, f, 2026, F.desc("src")).select("Handle", "year", "journal", "doi", "doi_source", "bib_tex", "url")) == [("H1", 2026, "Journal", "10.1234/a", "redif", "journal = {Journal}", "first")]
    assert ingest.load_cleaned(rec.limit(0), j, None, 2026, F.col("src")).count() == 0

    def embed(texts):
        if len(texts) > 1 or len(texts[0]) > 300:
            raise RuntimeError("too much")
        if texts[0].startswith("bad"):
            raise RuntimeError("never")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a", "y" * 5000), ("b", "bad"), ("c", None)], "k string, t string").coalesce(1)
    assert {r["k"]: list(r["embeddings"]) for r in ingest.embed_missing(df, "t", embed, 2).collect()} == {"a": [300.0, 1.0], "c": [0.0, 1.0]}
    links = spark.createDataFrame([("H1", "h2", "t"), ("h1", "gone", "t"), (None, "h2", "t")], "source string, target string, type string")
    assert rows(ingest.version_links(links, rec.select("Handle"))) == [("H1", "H2", "t")]


def test_enrich(spark):
    a = spark.createDataFrame([("h1", "T"), ("h2", None)], "handle string, title string")
    m = spark.createDataFrame([("H1", "w1", 3, 1.5, False, True, None, "gold", None, None)] * 2, "handle string, openalex_id string, oa_cited_by_count long, fwci double, is_retracted boolean, is_oa boolean, oa_url string, oa_status string, primary_topic string, primary_field string")
    full = enrich.papers_with_metrics(a, m)
    assert rows(full.select("handle", "openalex_id")) == [("h1", "w1"), ("h2", None)] and full.columns == enrich.papers_with_metrics(a, None).columns
    rec = {r["handle"]: r for r in enrich.as_record(full).collect()}
    assert rec["h2"]["openalex"] is None and rec["h2"]["title"] == "" and rec["h1"]["openalex"]["fwci"] == 1.5
    x = spark.createDataFrame([(["a"], '{"k": 1}'), ([], "{broken"), (None, None)], "b array<string>, j string")
    assert rows(enrich.unboxed(x, ["b"], {"j": "k int"}).select("b", "j.k")) == [("a", 1), (None, None), (None, None)]


def test_events(spark):
    one = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(events.merge_bibtex(F.col("a"), F.col("b"))).first()[0]
    assert one("@a{k1,\n x}\n@b{k2, y}", "@c{k1, z}\n@d{k3, w}") == "@a{k1,\n x}\n@b{k2, y}\n@d{k3, w}" and one(None, None) == ""
    e = [(1, 1, "stage", "write", "begun"), (1, 2, "paper", "a", ""), (1, 3, "refine", None, "replace"), (1, 4, "stage", "write", "done"), (1, 5, "paper", "b", ""), (1, 6, "done", None, None), (1, 7, "paper", "c", ""), (2, 1, "error", None, "fatal")]
    got = {r["run_id"]: r for r in events.reduce_runs(spark.createDataFrame(e, "run_id int, seq int, type string, key string, payload string")).collect()}
    assert (got[1]["papers"], got[1]["stages"], got[1]["mode"], got[1]["status"]) == (1, ["write=done"], "replace", "done") and got[2]["status"] == "error"
    lines = ['{"type":"error","message":"m","recoverable":true}', '{"type":"error","message":"m","recoverable":"yes"}', '{"type":"section","title":"t","handles":[],"mode":"odd"}', '{"type":"section","title":"t","handles":["a"],"mode":null}', "", None, "[]"]
    assert rows(events.valid_events(spark.createDataFrame([(x,) for x in lines], "value string")).select("type", "mode", "handles")) == [("error", None, None), ("section", None, ["a"])]
    briefs = ["  one two three four  ", "short", "x " * 1500, "12 34 56 78 90 12 34", None]
    assert [r[0] for r in spark.createDataFrame([(b,) for b in briefs], "b string").select(events.preflight(F.col("b"))).collect()] == [None, "short", "long", "unreadable", "short"]


def test_logs(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    e = [(1, t(1), 7, "s", t(1, 30)), (2, t(1, 10), 7, "s", None), (3, t(1, 30), 7, "s", t(1, 40)), (4, t(1, 50), 7, "s", None), (5, t(2), 7, "s", None), (6, t(3), 7, "free", None)]
    df = spark.createDataFrame(e, "event_id int, ts timestamp, user_id int, class string, until timestamp")
    got = {r["event_id"]: r["reason"] for r in telemetry.rate_limits(df, {"s": 2}, {"s": 2}, {"s": 1}).collect()}
    assert got == {1: None, 2: "concurrent", 3: None, 4: "hour", 5: "day", 6: None}
    store = spark.createDataFrame([("a", "error", "x", "[1]"), ("b", "done", "y", "[2]")], "id string, status string, brief string, events string")
    after, mine = telemetry.claim(store, spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "n"), ("c", "m"), (None, "n")], "id string, brief string"))
    assert rows(after) == [("a", "running", "x", None), ("b", "done", "y", "[2]"), ("c", "running", "m", None)] and rows(mine) == [("a",), ("c",)]


def test_snapshots(spark, tmp_path):
    a = spark.createDataFrame([("x", "A"), ("y", "B")], "Handle string, title string")
    for n, v in (("p1", "C"), ("p2", "D")):
        (tmp_path / "in" / n).mkdir(parents=True)
        snapshot.write_patch(spark.createDataFrame([("x", v)], "Handle string, title string"), str(tmp_path / "in" / n), "articles", "update_columns", ["Handle"])
    out, done = snapshot.apply_pending({"articles": a}, str(tmp_path / "in"), {"p1"})
    assert done == ["p2"] and rows(out["articles"]) == [("x", "D"), ("y", "B")]
    (tmp_path / "in" / "p2" / "manifest.json").write_text(json.dumps({"table": "a; drop", "mode": "replace_table", "keys": []}))
    with pytest.raises(ValueError):
        snapshot.apply_pending({"articles": a}, str(tmp_path / "in"), set())
    s = snapshot.Snapshots(spark, str(tmp_path / "snap"))
    s.dump({"articles": a, "hidden": a}, "20240101", ["articles"])
    back = s.restore({"articles": {"title": "string", "year": "int"}, "absent": {}})
    assert list(back) == ["articles"] and back["articles"].schema["year"].dataType.simpleString() == "int" and not s.stale("20240105") and s.stale("20240110")
    for t in ("a", "b"):
        (tmp_path / f"diff_{t}_20240101_20240102.parquet").touch()
    (tmp_path / "diff_a_20240102_20240103.parquet").touch()
    assert snapshot.newest_diff(str(tmp_path), ["a", "b"])["a"].endswith("diff_a_20240101_20240102.parquet")
    both, following = snapshot.migrate_users({"log": spark.createDataFrame([(1, "a")], "id int, t string")}, {"log": spark.createDataFrame([(5, "b")], "id int, t string")}, {"log": "id"})
    assert both["log"].count() == 2 and following == {"log": 6}
    assert rows(snapshot.set_key(spark.createDataFrame([("k", "1"), ("m", "2")], "key string, value string"), "k", "3")) == [("k", "3"), ("m", "2")]


def test_sources(spark, tmp_path):
    plan = spark.createDataFrame([("/x/updated_date=2024-01-01/a",), ("/x/updated_date=2024-01-02/b",)], "path string")
    plan = ingest.plan_chunks(plan)
    calls = []

    def pull(paths):
        calls.append(paths)
        if len(calls) == 1:
            raise OSError("lost")
        return spark.createDataFrame([(p,) for p in paths], "p string")

    out = str(tmp_path / "out")
    assert files.pull_chunks(plan, out, pull) == ["2024-01-01", "2024-01-02"] and len(calls) == 3 and files.pull_chunks(plan, out, pull) == []
    paths = ["/m/aaa/bbb/x.rdf", "/m/cpd/conf/y.redif", "/m/aaa/bbb/z.txt"]
    assert rows(files.record_files(spark.createDataFrame([(p,) for p in paths], "path string"))) == [("/m/aaa/bbb/x.rdf", "aaa", "bbb", "aaa_bbb")]
    ripe = {"objects": {"object": [{"attributes": {"attribute": [{"name": "netname", "value": "NET"}, {"name": "country", "value": "DE"}]}}]}}
    arin = {"net": {"name": {"$": "N2"}, "orgRef": {"@name": "Org"}, "netBlocks": {"netBlock": {"startAddress": {"$": "1.0.0.0"}, "cidrLength": {"$": "8"}}}}}
    df = spark.createDataFrame([("1", json.dumps(ripe)), ("2", json.dumps(arin)), ("3", "broken"), ("4", None)], "ip string, value string")
    assert rows(files.network_owner(df)) == [("1", "NET", None, "DE", None), ("2", "N2", "Org", None, "1.0.0.0/8"), ("3", None, None, None, None), ("4", None, None, None, None)]
    files.attach(spark, "other", {"t": spark.range(3).toDF("n")})
    assert spark.sql("SELECT count(*) FROM other_t").first()[0] == 3


def test_closure_of_any_depth_and_cycles(spark):
    nodes = [(f"c{k}", "deep" if k == 6 else "x", k, f"c{k - 1}" if k else None) for k in range(7)] + [("p", "x", 1, "q"), ("q", "deep", 1, "p")]
    got = rows(taxonomy.closure(spark.createDataFrame(nodes, "code string, label string, level int, parent string"), "deep").select("code"))
    assert got == [(f"c{k}",) for k in range(7)] + [("p",), ("q",)]


def test_corpus(spark):
    a = [("H1", "Wage floors", 2001, "Cat", "J", "Ann Lee", "@a{1,}", [1.0, 0.0]), ("h1", "Wage floors", 2001, "Cat", "J", "Ann Lee", "@a{1,}", [1.0, 0.0]), ("H2", "Tariffs", None, None, "J", None, None, [0.0, 1.0])]
    c = Corpus(spark, {"articles": spark.createDataFrame(a, "Handle string, title string, year int, category string, journal string, authors string, bib_tex string, embeddings array<float>"), "cit_internal": spark.createDataFrame([("h2", "H1 "), ("h2", "gone")], "citing string, cited string")})
    assert [r["handle"] for r in c.semantic_search([1.0, 0.1], 5).orderBy(F.desc("similarity")).collect()] == ["h1", "h2"]
    page, total = c.keyword_search(["wage"], by_citations=True)
    assert [r["handle"] for r in page.collect()] == ["h1"] and total.first()["total"] == 1
    assert {r["handle"] for r in c.cites("H2").collect()} == {"h1", "gone"} and [r["handle"] for r in c.citedby("h1").collect()] == ["h2"]
    assert c.versions("h1").count() == 0 and c.overview("h1").first()["openalex"] is None and c.bib_for([" H1"]).first()["bib_tex"] == "@a{1,}"
    assert [tuple(r) for r in c.journals().collect()] == [("J", 2)] and c.person_lookup("x").count() == 0 and c.sql("SELECT count(*) AS n FROM articles").first()["n"] == 3
    assert c.person_search([1.0, 0.0], "blended").count() == 0
    with pytest.raises(ValueError):
        c.person_papers("p", "odd")
    with pytest.raises(ValueError):
        c.semantic_pool([1.0, 0.0], jel=["bad!"])
