"""Queries over ingest, enrichment, logs, events and the facade, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblyst.corpus import Corpus
from biblyst.functions import text as T
from biblyst.operators import dois as I
from biblyst.operators import enrich as N
from biblyst.operators import events as E
from biblyst.operators import ingest as G
from biblyst.operators import match as M
from biblyst.operators import persons as P
from biblyst.operators import search as S
from biblyst.operators import snapshot as D
from biblyst.operators import taxonomy as X
from biblyst.operators import telemetry as L
from biblyst.plans.core_problems import table
from biblyst.plans.guard import ROWS, Rejected, guarded_sql
from biblyst.plans.workload import AS_OF, NOW_YEAR, OA, TOP, A, C, PP, V, W, _doi, _events, _journal, _search_sql, _VEC, articles, edges, links, oa, people, probe, vectors, works
from biblyst.sources import reference_files as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- enrichment


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by handle, made of the freshest work of each identifier; some handles twice."""
    best = M.freshest(oa(spark, d), "doi", F.desc("updated_date"), F.col("work_id"))
    a = articles(spark, d, "doi").select("handle", T.normalize_doi(F.col("doi")).alias("doi")).join(best, "doi")
    n = F.length("title")
    m = a.select(F.upper("handle").alias("handle"), F.col("work_id").alias("openalex_id"), n.cast("long").alias("oa_cited_by_count"), (n / 8).alias("fwci"), (n % 2 == 0).alias("is_retracted"), (n % 3 == 0).alias("is_oa"), F.lit(None).cast("string").alias("oa_url"), F.lit("gold").alias("oa_status"), F.col("source").alias("primary_topic"), F.col("type").alias("primary_field"))
    return m.unionByName(m.where(F.length("handle") % 2 == 0))


_MET = f"{OA}, fr AS (SELECT * FROM o WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY updated_date DESC, work_id) = 1), me AS (SELECT a.handle, work_id AS openalex_id, length(fr.title)::BIGINT AS oa_cited_by_count, length(fr.title) / 8 AS fwci, length(fr.title) % 2 = 0 AS is_retracted, length(fr.title) % 3 = 0 AS is_oa, NULL::VARCHAR AS oa_url, 'gold' AS oa_status, fr.source AS primary_topic, fr.type AS primary_field FROM a JOIN fr ON {_doi('a.doi')} = fr.doi)"


@query(f"WITH {A}, {_MET} SELECT a.handle, a.title, a.year, a.journal, openalex_id, oa_cited_by_count, fwci, is_retracted, is_oa, oa_url, oa_status, primary_topic, primary_field FROM a LEFT JOIN me USING (handle)")
def papers_with_metrics(spark: SparkSession, d: str) -> DataFrame:
    return N.papers_with_metrics(articles(spark, d, "title", "year", "journal"), _metrics(spark, d))


@query(f"WITH {A}, {_MET} SELECT a.handle, coalesce(a.title, '') AS title, coalesce(a.journal, '') AS journal, openalex_id IS NULL AS without, openalex_id AS work FROM a LEFT JOIN me USING (handle)")
def paper_records(spark: SparkSession, d: str) -> DataFrame:
    rows = N.as_record(N.papers_with_metrics(articles(spark, d, "title", "year", "journal"), _metrics(spark, d)))
    return rows.select("handle", "title", "journal", F.col("openalex").isNull().alias("without"), F.col("openalex.openalex_id").alias("work"))


@query(f"WITH {A}, {_MET}, {C}, {V}, n AS (SELECT cited, count(*) AS n FROM c GROUP BY 1), b AS (SELECT DISTINCT source AS handle, target AS other, type FROM v UNION SELECT target, source, type FROM v) SELECT a.handle, a.title, coalesce(n, 0) AS cites, (SELECT count(*) FROM b WHERE b.handle = a.handle) AS n_versions, openalex_id AS work FROM a LEFT JOIN n ON n.cited = a.handle LEFT JOIN me USING (handle)")
def paper_overview(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "year")
    n = edges(spark, d).groupBy(F.col("cited").alias("handle")).agg(F.count("*").alias("total_citations"))
    from biblyst.operators.graph import versions_of

    full = N.overview(a, a.select("handle").join(n, "handle", "left").fillna(0), versions_of(links(spark, d), True), _metrics(spark, d))
    return full.select("handle", F.col("paper.title").alias("title"), F.col("stats.total_citations").alias("cites"), F.size("versions").cast("long").alias("n_versions"), F.col("openalex.openalex_id").alias("work"))


@query(f"WITH {A}, {C}, {_MET}, x AS (SELECT a.handle, year, (SELECT count(*) FROM c WHERE c.cited = a.handle) AS n, openalex_id, fwci FROM a LEFT JOIN me USING (handle)) SELECT handle, round(n / 100, 2) * 100 AS percentile, round(fwci, 2) AS fwci, n > 0 OR coalesce({NOW_YEAR} - year > 0, false) OR openalex_id IS NOT NULL AS covered FROM x")
def stats_badges(spark: SparkSession, d: str) -> DataFrame:
    n = edges(spark, d).groupBy(F.col("cited").alias("handle")).agg(F.count("*").alias("internal_citations"))
    x = N.papers_with_metrics(articles(spark, d, "year"), _metrics(spark, d)).join(n, "handle", "left").fillna(0, ["internal_citations"])
    x = x.withColumns({"citation_percentile": F.col("internal_citations") / 100, "years_since_pub": NOW_YEAR - F.col("year"), "total_references": F.lit(0)})
    return N.badges(x).withColumn("fwci", F.col("fwci").cast("double"))


@query(f"WITH {A}, {C}, n AS (SELECT c.cited AS handle, a.year, count(*) AS n FROM c JOIN a ON a.handle = c.citing WHERE a.year IS NOT NULL GROUP BY ALL) SELECT handle, year, n, round(n / max(n) OVER (PARTITION BY handle), 6) AS height FROM n")
def citation_bars(spark: SparkSession, d: str) -> DataFrame:
    y = articles(spark, d, "year").where("year is not null").withColumnRenamed("handle", "citing")
    n = edges(spark, d).join(y, "citing").groupBy(F.col("cited").alias("handle"), "year").agg(F.count("*").alias("n"))
    return N.bars(n).withColumn("height", F.round("height", 6))


@query("SELECT event_id, try_cast(json_extract(CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END, '$.k') AS INT) AS k, event_type AS kind FROM events")
def unboxed_json(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", F.array("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("p"))
    return N.unboxed(e, ["kind"], {"p": "k int"}).select("event_id", F.col("p.k").alias("k"), "kind")


@query("SELECT lower(trim(Handle)) AS handle, min(bib_tex) AS bib_tex FROM articles WHERE bib_tex <> '' AND archive = (SELECT min(archive) FROM articles) GROUP BY 1")
def bib_entries(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "bib_tex", "archive")
    first = a.agg(F.min("archive").alias("archive"))
    return N.bib_for(a, a.join(F.broadcast(first), "archive").select(F.upper("handle").alias("handle")))  # one row


# ---------------------------------------------------------------- search


@query(f"WITH {A} SELECT handle, title FROM a WHERE contains(lower(title), 'evidence') AND contains(lower(authors), 'an')")
def title_author_filter(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title", "authors").where(S.paper_filters(title="Evidence", author="AN")).select("handle", "title")


@query(f"WITH {A} SELECT handle, year FROM a ORDER BY year DESC NULLS LAST, handle LIMIT 40")
def newest_papers(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "year")
    return S.page(a, S.by_year(a), 40)


@query(f"WITH {A} SELECT count(*) AS total FROM a WHERE contains(lower(title), 'evidence')")
def keyword_total(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_page(articles(spark, d, "title", "year"), ["evidence"], 10, 20)[1]


@query(f"WITH {_VEC}, h AS (SELECT handle, sim FROM s ORDER BY sim DESC, handle LIMIT 60) SELECT handle, row_number() OVER (ORDER BY round(sim, 3) DESC, sim DESC, handle) AS place FROM h")
def rounded_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    hits = S.rounded(S.semantic_search(vectors(spark, d), probe(spark, d), 60).withColumn("exact", F.col("similarity")), 3)
    w = Window.orderBy(F.desc("similarity"), F.desc("exact"), "handle")  # 60 rows
    return hits.select("handle", F.row_number().over(w).alias("place"))


_JEL = "k AS (SELECT DISTINCT lower(trim(Handle)) AS handle, upper(left(journal_code, 1)) || (year % 100) AS code FROM articles WHERE journal_code IS NOT NULL AND year IS NOT NULL)"


def _codes(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "journal_code", "year").where("journal_code is not null and year is not null")
    return a.select("handle", F.concat(F.upper(F.substring("journal_code", 1, 1)), (F.col("year") % 100).cast("string")).alias("code"))


@query(f"WITH {_VEC}, {_JEL} SELECT handle, round(sim, 6) AS similarity FROM s WHERE handle IN (SELECT handle FROM k WHERE starts_with(code, 'J1') OR starts_with(code, 'B')) ORDER BY sim DESC, handle LIMIT 25")
def semantic_jel(spark: SparkSession, d: str) -> DataFrame:
    a = X.with_codes(vectors(spark, d).select("handle", "embeddings"), _codes(spark, d), ["j1", "b"])
    return S.semantic_search(a, probe(spark, d), 25).select("handle", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_VEC}, {_JEL}, p AS (SELECT * FROM s ORDER BY sim DESC, handle LIMIT 375) SELECT handle FROM p WHERE handle IN (SELECT handle FROM k WHERE starts_with(code, 'B')) ORDER BY sim DESC, handle LIMIT 25")
def corpus_semantic_pool(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, {"articles": table(spark, d, "articles"), "article_jel": _codes(spark, d).withColumnRenamed("code", "jel_code")})
    return c.semantic_pool(probe(spark, d), 25, jel=["b"]).select("handle")


@query("SELECT journal, count(DISTINCT lower(trim(Handle))) AS n FROM articles WHERE journal IS NOT NULL GROUP BY 1")
def corpus_journals(spark: SparkSession, d: str) -> DataFrame:
    return Corpus.read(spark, d, ["articles"]).journals()


@query(f"WITH {C}, h AS (SELECT cited FROM c GROUP BY 1 ORDER BY count(*) DESC, cited LIMIT 1), {A} SELECT DISTINCT citing AS handle, title, year FROM c JOIN a ON a.handle = citing WHERE cited = (SELECT cited FROM h) ORDER BY year DESC NULLS LAST, handle LIMIT 50")
def corpus_citedby(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus.read(spark, d, ["articles", "cit_internal"])
    most = c.edges().groupBy("cited").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cited").first()["cited"]  # one handle
    return c.citedby(most)


@query(f"WITH {W}, {A}, {C}, s AS (SELECT short_id FROM w GROUP BY 1 ORDER BY count(*) DESC, short_id LIMIT 1), n AS (SELECT cited, count(*) AS n FROM c GROUP BY 1) SELECT DISTINCT a.handle, journal, coalesce(n, 0) AS citations FROM w JOIN a ON a.handle = work_handle LEFT JOIN n ON n.cited = a.handle WHERE short_id = (SELECT short_id FROM s) ORDER BY citations DESC, a.handle LIMIT 20 OFFSET 2")
def corpus_person_papers(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus.read(spark, d, ["articles", "cit_internal", "person_works"])
    most = c.works().groupBy("short_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "short_id").first()["short_id"]  # one id
    return c.person_papers(most, "citations", limit=20, offset=2)[0].select("handle", "journal", "citations")


@query(_search_sql("overlap * qb").replace("SELECT o.*, ln(1 +", "SELECT o.*, last_year, coalesce(total_citations, 0) AS tc, ln(1 +").replace("LEFT JOIN ps USING (short_id))", "LEFT JOIN ps USING (short_id) WHERE total_citations >= 5 AND last_year >= 2015)"))
def person_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    from biblyst.operators.graph import handle_stats_first

    a = articles(spark, d, "year", "category")
    hits = S.semantic_search(vectors(spark, d), probe(spark, d), 600)
    hits = vectors(spark, d).select("handle", "title").join(F.broadcast(hits), "handle").distinct()  # 600 rows
    stats = P.person_stats(people(spark, d), works(spark, d), a, handle_stats_first(a, edges(spark, d), NOW_YEAR), TOP)
    return P.person_search(hits, works(spark, d), stats, "breadth", min_citations=5, min_last_year=2015)


# ---------------------------------------------------------------- identifiers


@query(f"WITH {A} SELECT handle, '10.1038/' || regexp_extract(lower(replace(url, 'papers.example/', 'www.nature.com/articles/s1')), 'nature\\.com/articles/([^/?#]+)', 1) AS doi FROM a WHERE doi IS NULL AND contains(lower(url), 'papers.example/')")
def article_page_dois(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "url", "doi").withColumn("url", F.replace("url", F.lit("papers.example/"), F.lit("www.nature.com/articles/s1")))
    return I.from_article_pages(a, "nature.com", "10.1038", ["nature", "srep"]).select("handle", "doi")


@query(f"WITH {A}, u AS (SELECT handle, nullif(regexp_extract('https://host.example/p/' || doi, '10\\.\\d{{4,9}}/[^\\s?#&]+'), '') AS x FROM a) SELECT handle, min({_doi('x')}) AS doi FROM u WHERE {_doi('x')} IS NOT NULL GROUP BY 1")
def dois_in_urls(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "doi").select("handle", F.concat(F.lit("https://host.example/p/"), "doi").alias("url"))
    return I.from_urls(a).select("handle", "doi")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "authors", "year").where("title is not null")
    w = oa(spark, d).select("work_id", F.col("doi"), "title", F.col("year").alias("c_year"), "type")
    kind = F.when(F.length("work_id") % 2 == 0, "report").otherwise("journal-article")
    return a.join(w, "title").select("handle", F.dense_rank().over(_by("handle", "work_id")).alias("rank"), "doi", F.col("title").alias("c_title"), "c_year", kind.alias("c_type"), F.col("authors").alias("c_authors"), (82 + F.length("title") % 10).cast("double").alias("score"))


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


_CAND = "cd AS (SELECT a.handle, a.authors, a.is_series, a.year, o.doi, o.work_id, a.title, o.year AS c_year, CASE WHEN length(o.work_id) % 2 = 0 THEN 'report' ELSE 'journal-article' END AS c_type, 82 + length(a.title) % 10 AS score FROM a JOIN o ON o.title = a.title)"


@query(f"WITH {A}, {OA}, {_CAND}, ok AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY work_id, doi NULLS LAST) AS r FROM cd WHERE score >= 85 AND (c_type = 'report') = is_series AND abs(c_year - year) <= 1 AND contains(lower(authors), nullif(lower(string_split_regex(trim(string_split(authors, ';')[1]), '\\s+')[-1]), ''))) SELECT handle, doi, c_year, c_type, score::DOUBLE AS score FROM ok WHERE r = 1 AND doi IS NOT NULL")
def guarded_candidates(spark: SparkSession, d: str) -> DataFrame:
    q = articles(spark, d, "authors", "year", "is_series")
    return I.guard_candidates(q, _candidates(spark, d)).select("handle", "doi", "c_year", "c_type", "score")


@query(f"WITH {A}, {OA}, {_CAND}, ok AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY length(title) % 7 + length(work_id) % 2 DESC, work_id, doi) AS r FROM cd WHERE doi IS NOT NULL AND c_type IN ('journal-article', 'report') AND abs(c_year - year) <= 1) SELECT handle, doi FROM ok WHERE r = 1")
def picked_candidates(spark: SparkSession, d: str) -> DataFrame:
    sim = (F.length("c_title") % 7 + F.when(F.col("c_type") == "report", 0).otherwise(1)).cast("double")
    c = _candidates(spark, d).join(articles(spark, d, "year"), "handle").withColumn("sim", sim)
    return I.pick_in_container(c, ["journal-article", "report"], least=0.0).select("handle", "doi")


@query(f"WITH {A}, {OA}, src AS (SELECT handle, {_doi('doi')} AS doi, 0 AS n FROM a WHERE length(handle) % 3 = 0 UNION ALL SELECT a.handle, o.doi, 3 FROM a JOIN o ON o.title = a.title WHERE a.doi IS NULL), c AS (SELECT * FROM src WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY handle ORDER BY n, doi) = 1) SELECT handle, doi, CASE n WHEN 0 THEN 'redif' ELSE 'openalex' END AS doi_source FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.handle = c.handle AND a.doi = c.doi)")
def doi_patch(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "doi", "title")
    redif = a.where(F.length("handle") % 3 == 0).select("handle", T.normalize_doi(F.col("doi")).alias("doi"))
    return I.finalize(a.select("handle", "doi"), {"redif": redif, "openalex": a.join(oa(spark, d).select("title", F.col("doi").alias("d")), "title").select("handle", F.col("d").alias("doi"))})


@query(f"WITH {A} SELECT handle, min({_doi('doi')}) AS doi, 'crossref' AS doi_source FROM a WHERE {_doi('doi')} IS NOT NULL GROUP BY 1")
def ledger_hits(spark: SparkSession, d: str) -> DataFrame:
    return I.ledger_hits(articles(spark, d, "doi"), "crossref")


@query(f"WITH {A}, t AS (SELECT handle FROM a WHERE doi IS NULL AND title IS NOT NULL AND year IS NOT NULL AND journal IS NOT NULL AND NOT is_series AND length(handle) % 4 <> 0 ORDER BY handle LIMIT 500) SELECT handle, ceil(row_number() OVER (ORDER BY handle) / 40)::BIGINT AS chunk FROM t")
def attempt_queue(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "doi", "title", "year", "journal", "is_series")
    tried = a.where(F.length("handle") % 4 == 0).select("handle")
    return I.chunked(I.work_queue(a, tried, 500).select("handle"), 40)


@query(f"WITH {A} SELECT handle, sha256('[\"' || handle || '\",\"x\"]')[1:8] AS short, sha256(from_hex('{''.join(f'{b ^ 0x5C:02X}' for b in b'key'.ljust(64, bytes(1)))}') || from_hex(upper(sha256(from_hex('{''.join(f'{b ^ 0x36:02X}' for b in b'key'.ljust(64, bytes(1)))}') || encode('[\"' || handle || '\"]')))))[1:16] AS run FROM a")
def keyed_hashes(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("handle", T.short_hash(F.col("handle"), F.lit("x")).alias("short"), T.run_key("key", F.col("handle")).alias("run"))


# ---------------------------------------------------------------- ingest


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 2026 WHEN event_id % 5 <> 0 THEN 2024 END AS year FROM events")
def years_read(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("event_id") % 7 == 0, "Forthcoming").when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM")).otherwise("n.d.")
    return _events(spark, d).select("event_id", T.parse_year(t, 2026).alias("year"))


@query("WITH r AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY Handle ORDER BY loaded_at, title) = 1) SELECT Handle AS h, r.year, j.long_name AS journal, j.category, regexp_replace(replace('journal = {}' || chr(10) || ' ' || chr(10) || 'x', 'journal = {}', 'journal = {' || coalesce(j.long_name, 'NA') || '}'), '\\n\\s*\\n', chr(10), 'g') AS bib, r.url FROM r LEFT JOIN journals j ON j.archive = r.archive AND j.journal_code = r.journal_code WHERE ((r.year >= 1995 AND NOT is_series) OR (r.year >= 2010 AND is_series)) AND length(abstract) > 100")
def load_cleaned_whole(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").withColumn("bib_tex", F.lit("journal = {}\n \nx"))
    files = a.select("Handle", F.lit(2).alias("position"), F.lit("later").alias("url")).unionByName(a.select("Handle", F.lit(1).alias("position"), "url")).where("url <> 'later' or Handle in ('')")
    out = G.load_cleaned(a.drop("embeddings"), table(spark, d, "journals"), files, 2026, F.col("loaded_at"), F.col("title"))
    return out.select(F.col("Handle").alias("h"), "year", "journal", "category", F.col("bib_tex").alias("bib"), "url")


@query(f"WITH {A}, {C} SELECT handle FROM a WHERE handle NOT IN (SELECT citing FROM c WHERE citing IS NOT NULL)")
def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return G.unprocessed(articles(spark, d), edges(spark, d).select(F.col("citing").alias("handle")), "handle")


@query("WITH k AS (SELECT lower(Handle) AS k, min(Handle) AS h FROM articles WHERE Handle IS NOT NULL GROUP BY 1) SELECT s.h AS source, t.h AS target, type FROM version_links v JOIN k s ON s.k = lower(v.source) JOIN k t ON t.k = lower(v.target)")
def version_links_ingest(spark: SparkSession, d: str) -> DataFrame:
    return G.version_links(table(spark, d, "version_links"), table(spark, d, "articles"))


@query("WITH r AS (SELECT lower(Handle) AS handle, unnest(string_split(left(journal_code, 1) || (year % 100) || ' ' || left(archive, 1) || ' X999', ' ')) AS c FROM articles) SELECT DISTINCT handle, upper(trim(c)) AS jel_code FROM r WHERE regexp_full_match(upper(trim(c)), '[A-Z]\\d{0,2}')")
def jel_table(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    codes = F.concat(F.substring("journal_code", 1, 1), (F.col("year") % 100).cast("string"), F.lit(" "), F.substring("archive", 1, 1), F.lit(" X999"))
    return G.jel_table(a.select("Handle", codes.alias("jel")).where("jel is not null"), a)


@query("SELECT series_handle, length(long_name) / 4 AS simple_if, length(archive) AS h_index, CASE WHEN length(long_name) % 2 = 0 THEN length(long_name) / 8 END AS simple_if_10y, CASE WHEN length(long_name) % 2 = 0 THEN 1 END AS h_index_10y FROM journals")
def journal_quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("long_name")
    j = table(spark, d, "journals")
    recent = j.where(n % 2 == 0).select("series_handle", (n / 8).alias("simple_if"), F.lit(0.0).alias("recursive_if"), F.lit(1).alias("h_index"))
    return G.journal_quality(j.select("series_handle", (n / 4).alias("simple_if"), F.length("archive").alias("h_index")), recent, F.lit(AS_OF).cast("timestamp_ntz")).select("series_handle", "simple_if", "h_index", "simple_if_10y", "h_index_10y")


@query(f"WITH {A}, {OA}, s AS (SELECT source AS id, source AS nm, count(*) AS works FROM o WHERE source IS NOT NULL GROUP BY 1), n AS (SELECT id, nm, works, {_journal('nm')} AS n FROM s UNION ALL SELECT id, nm, works, {_journal(chr(39) + 'The ' + chr(39) + ' || nm || ' + chr(39) + ' (Online)' + chr(39))} FROM s WHERE length(id) % 2 = 0), js AS (SELECT DISTINCT journal FROM a WHERE journal IS NOT NULL) SELECT journal, id AS src_id, works AS works_count, CASE WHEN id IS NOT NULL THEN 'name/alt' END AS via FROM (SELECT journal, {_journal('journal')} AS n FROM js) LEFT JOIN n USING (n) QUALIFY row_number() OVER (PARTITION BY journal ORDER BY works DESC NULLS LAST, id NULLS LAST) = 1")
def sources_by_names(spark: SparkSession, d: str) -> DataFrame:
    s = oa(spark, d).where("source is not null").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("works_count"))
    s = s.withColumn("display_name", F.col("id")).withColumn("alternate_titles", F.when(F.length("id") % 2 == 0, F.array(F.concat(F.lit("The "), "id", F.lit(" (Online)")))))
    return G.resolve_by_names(articles(spark, d, "journal"), s).select("journal", "src_id", "works_count", "via")


@query(f"WITH {PP}, f AS (SELECT DISTINCT short_id, CASE WHEN length(coalesce(name_full, '')) % 3 = 0 THEN DATE '2023-01-01' ELSE DATE '2024-01-20' END AS at FROM pp WHERE length(coalesce(name_full, '')) % 4 <> 0) SELECT DISTINCT pp.short_id FROM pp LEFT JOIN f USING (short_id) WHERE (f.at IS NULL OR f.at < DATE '2024-01-01') AND pp.short_id IN (SELECT lower(trim(short_id)) FROM person_works)")
def stale_persons(spark: SparkSession, d: str) -> DataFrame:
    p = people(spark, d)
    n = F.length(F.coalesce("name_full", F.lit("")))
    seen = p.where(n % 4 != 0).select("short_id", F.when(n % 3 == 0, F.lit("2023-01-01")).otherwise("2024-01-20").cast("date").alias("fetched_date"))
    return G.stale(p, seen, F.lit("2024-01-01").cast("date"), works(spark, d).select("short_id"))


@query(f"WITH {OA}, q AS (SELECT work_id, doi, updated_date, NULL::VARCHAR AS type FROM o WHERE length(work_id) % 2 = 0 UNION ALL SELECT work_id, doi, updated_date, type FROM o) SELECT doi, work_id, type FROM q WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY updated_date DESC, work_id, type NULLS LAST) = 1")
def quarters(spark: SparkSession, d: str) -> DataFrame:
    o = oa(spark, d).select("work_id", "doi", "updated_date", "type")
    return G.union_quarters([o.drop("type").where(F.length("work_id") % 2 == 0), o], "doi", F.desc("updated_date"), F.col("work_id"), F.col("type").asc_nulls_last()).select("doi", "work_id", "type")


@query(f"WITH {A}, {W}, t AS (SELECT handle FROM a WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY year DESC NULLS LAST, handle) <= 120) SELECT handle FROM t UNION SELECT handle FROM a WHERE handle IN (SELECT work_handle FROM w WHERE short_id = (SELECT min(short_id) FROM w)) UNION SELECT handle FROM a WHERE contains(title, '%')")
def fixture_slice(spark: SparkSession, d: str) -> DataFrame:
    a, w = articles(spark, d, "title", "category", "year"), works(spark, d)
    one = w.agg(F.min("short_id")).first()[0]  # one id
    return G.fixture_slice(a, w, [one], a.where(F.contains("title", F.lit("%"))))


@query("SELECT path, day || CASE WHEN count(*) OVER (PARTITION BY day) > 60 THEN '-b' || ceil(row_number() OVER (PARTITION BY day ORDER BY path) / 60)::INT ELSE '' END AS chunk FROM (SELECT 's3://x/updated_date=' || strftime(ts, '%Y-%m-%d') || '/part_' || lpad(event_id::VARCHAR, 9, '0') AS path, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 5 = 0 OR ts < TIMESTAMP '2024-01-10')")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("event_id % 5 = 0 or ts < timestamp_ntz '2024-01-10 00:00:00'")
    path = F.concat(F.lit("s3://x/updated_date="), F.date_format("ts", "yyyy-MM-dd"), F.lit("/part_"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    return G.plan_chunks(e.select(path.alias("path")))


@query(f"WITH {A}, {PP}, r AS (SELECT 'articles' AS table_name, count(*) AS n_rows FROM a UNION ALL SELECT 'persons', count(*) FROM pp) SELECT table_name, n_rows, round(n_rows / sum(n_rows) OVER (), 6) AS share FROM r")
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from biblyst.session import shared_dir

    where = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    s = D.Snapshots(spark, f"{where}/snapshots-{uuid.uuid4().hex}")
    s.dump({"articles": articles(spark, d, "title"), "persons": people(spark, d), "left_out": people(spark, d)}, "20240101", ["articles", "persons"])
    return s.counts(["articles", "persons"]).withColumn("share", F.round("share", 6))


@query(f"WITH {A} SELECT count(*) AS n, 4 AS parts FROM a")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    return D.split_rows(articles(spark, d), ["handle"], 4).groupBy("part").agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.count("*").cast("int").alias("parts"))


@query(f"WITH {A} SELECT handle, handle || ',' || CASE WHEN regexp_matches(coalesce(title, ''), '[\",\\n\\r]') THEN '\"' || replace(title, '\"', '\"\"') || '\"' ELSE coalesce(title, '') END || ',,' || coalesce(year::VARCHAR, '') || ',,,,,,,,,,,,,' AS line FROM a")
def search_csv(spark: SparkSession, d: str) -> DataFrame:
    return R.search_rows(articles(spark, d, "title", "year"))


@query(f"WITH {A}, x AS (SELECT handle, title, year, row_number() OVER (ORDER BY handle) AS rank FROM a) SELECT rank::INT AS rank, rank || '. ' || ' (' || coalesce(year::VARCHAR, 'n.d.') || '). ' || coalesce(title, '') || '. ' || handle AS line FROM x WHERE rank <= 2000")
def markdown_sources(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    a = R.export_rows(articles(spark, d, "title", "year").withColumn("rank", F.lit(0)))
    top = a.withColumn("rank", F.row_number().over(Window.orderBy("handle")))  # at most EXPORT_ROWS rows
    return R.markdown_list(top)


# ---------------------------------------------------------------- logs


def _runs_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 9 == 0, "error").when(k % 5 == 0, "awaiting_clarification").otherwise("done")
    return _events(spark, d).select(k.cast("string").alias("id"), F.col("ts").alias("created_at"), status.alias("status"), F.col("event_type").alias("brief"), (k % 3 == 0).alias("refine"), F.when(k % 4 == 0, F.lit("which?")).alias("clarify_question"), F.when(k % 6 != 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).alias("events"), F.when(k % 2 == 0, "x").otherwise("").alias("synthesis"))


_RUNS = "rt AS (SELECT event_id::VARCHAR AS id, ts AS created_at, CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'awaiting_clarification' ELSE 'done' END AS status, event_type AS brief, event_id % 3 = 0 AS refine, CASE WHEN event_id % 4 = 0 THEN 'which?' END AS clarify_question, CASE WHEN event_id % 6 <> 0 THEN 2 ELSE 0 END AS n_events, event_id % 2 = 0 AS has_synthesis FROM events)"


@query(f"WITH {_RUNS} SELECT NULL AS status, count(*) AS n, count(clarify_question) AS clarified, count(*) FILTER (refine) AS refined FROM rt UNION ALL SELECT status, count(*), NULL, NULL FROM rt GROUP BY 1")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.run_stats(_runs_table(spark, d))


@query(f"WITH {_RUNS} SELECT id, status, brief, refine, clarify_question IS NOT NULL AS clarified, n_events, has_synthesis FROM rt WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16'")
def run_day_log(spark: SparkSession, d: str) -> DataFrame:
    return L.run_log(L.day_log(_runs_table(spark, d), F.lit("2024-01-15"), "created_at")).drop("created_at")


@query("SELECT * FROM (SELECT user_id AS k, min(event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1) UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type <> 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY 1")
def first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "event_type")
    store = e.where("event_type = 'view'").groupBy("k").agg(F.min("v").alias("v"))
    return L.first_write_wins(store, e.where("event_type <> 'view'").select("k", "v"), "k", F.col("v"))


@query("WITH s AS (SELECT event_id AS search_id, event_id % 100 AS hits, [event_type, props]::VARCHAR[] AS top3_handles FROM events WHERE event_id < 100) SELECT * FROM s UNION ALL SELECT (SELECT max(search_id) FROM s) + row_number() OVER (ORDER BY event_id), event_id % 100, [event_type, props, event_type] FROM events WHERE event_id BETWEEN 100 AND 150")
def log_append(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    log = e.where("event_id < 100").select(F.col("event_id").alias("search_id"), (F.col("event_id") % 100).alias("hits"), F.array("event_type", "props").alias("top3_handles"))
    new = e.where("event_id between 100 and 150").select("event_id", (F.col("event_id") % 100).alias("hits"), F.array("event_type", "props", "event_type", "props").alias("handles"))
    return L.append_log(log, new, F.col("event_id"))


@query(f"WITH {_RUNS}, w AS (SELECT DISTINCT (event_id * 3)::VARCHAR AS id FROM events) SELECT coalesce(rt.id, w.id) AS id, CASE WHEN w.id IS NOT NULL AND (rt.id IS NULL OR rt.status = 'error') THEN 'running' ELSE rt.status END AS status, coalesce(brief, 'new') AS brief FROM rt FULL JOIN w ON w.id = rt.id")
def claimed_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs_table(spark, d)
    want = _events(spark, d).select((F.col("event_id") * 3).cast("string").alias("id"), F.lit("new").alias("brief"))
    return L.claim(runs, want)[0].select("id", "status", "brief")


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rh FROM events), f AS (SELECT *, CASE WHEN event_type = 'view' THEN rh > 1 ELSE false END AS ful FROM h), g AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ful, ts::DATE ORDER BY ts, event_id) AS rd FROM f) SELECT event_id, NOT ful AND NOT (event_type IN ('view', 'click') AND rd > 1) AS accepted, CASE WHEN ful THEN 'hour' WHEN event_type IN ('view', 'click') AND rd > 1 THEN 'day' END AS reason FROM g")
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "ts", "user_id", F.col("event_type").alias("class"), F.lit(None).cast("timestamp_ntz").alias("until"))
    return L.rate_limits(e, {"view": 1}, {"view": 1, "click": 1})


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS hosts FROM events GROUP BY 1")
def daily_hosts(spark: SparkSession, d: str) -> DataFrame:
    return L.daily_hosts(_events(spark, d).withColumn("ip", F.col("user_id"))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ---------------------------------------------------------------- events


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Run events made of the events table: papers with distances, sections of two papers, stages, rounds."""
    kinds = F.create_map(*[F.lit(x) for p in (("purchase", "paper"), ("signup", "person"), ("click", "section"), ("view", "stage"), ("error", "synthesis")) for x in p])
    e = _events(spark, d).select(F.col("user_id").alias("run_id"), "ts", "event_id", kinds[F.col("event_type")].alias("type"), F.col("props").alias("key"), F.col("event_type").alias("payload"), F.col("value").alias("similarity"))
    return E.assign_seq(e, ["ts", "event_id"])


_LOG = "lg AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'purchase' THEN 'paper' WHEN 'signup' THEN 'person' WHEN 'click' THEN 'section' WHEN 'view' THEN 'stage' ELSE 'synthesis' END AS type, props AS key, event_type AS payload, value AS similarity FROM events)"


def _log_sections(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d)
    return E.sections(e.select("run_id", "seq", "type", F.col("key").alias("handle"), F.when(F.col("type") == "paper", F.col("similarity")).alias("similarity"), F.col("payload").alias("title"), F.lit(None).cast("string").alias("mode"), F.when(F.col("type") == "section", F.array("key", F.lit('{"k": 1}'))).alias("handles")))


_SEC = f"{_LOG}, sc AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n, unnest([{{'r': 1, 'h': key}}, {{'r': 2, 'h': '{{\"k\": 1}}'}}]) AS x FROM lg WHERE type = 'section'), se AS (SELECT run_id, 'section-' || n AS section, n, 'click' AS title, 'custom' AS mode, 2 AS n_total, x.r AS rank, x.h AS handle, (SELECT arg_max(similarity, p.seq) FROM lg p WHERE p.run_id = sc.run_id AND p.type = 'paper' AND p.key = x.h AND p.seq < sc.seq) AS similarity FROM sc)"


@query(f"WITH {_SEC} SELECT run_id, section, title, mode, n_total, rank, handle, similarity FROM se")
def event_sections(spark: SparkSession, d: str) -> DataFrame:
    return _log_sections(spark, d)


@query(f"WITH {_SEC} SELECT run_id, handle, min(similarity) AS max_similarity, string_agg(DISTINCT section, '|' ORDER BY n) AS sections FROM (SELECT DISTINCT run_id, handle, section, n, similarity FROM se) GROUP BY ALL".replace("string_agg(DISTINCT section, '|' ORDER BY n)", "array_to_string(list_transform(list_sort(list_distinct(list({'n': n, 's': section}))), lambda y: y.s), '|')"))
def best_similarities(spark: SparkSession, d: str) -> DataFrame:
    return E.best_similarities(_log_sections(spark, d))


@query(f"WITH {_LOG} SELECT run_id, count(DISTINCT key) FILTER (type = 'paper') AS papers, count(DISTINCT key) FILTER (type = 'person') AS persons, count(*) FILTER (type = 'section') AS n_sections, NULL::VARCHAR AS bibtex, coalesce(string_agg(payload, '' ORDER BY seq) FILTER (type = 'synthesis'), '') AS synthesis FROM lg GROUP BY 1")
def event_bundle(spark: SparkSession, d: str) -> DataFrame:
    return E.bundle(_log(spark, d)).drop("strategy", "script")


@query(f"WITH {_LOG}, c AS (SELECT run_id, max(seq) AS cut FROM lg WHERE type = 'stage' AND seq % 10 = 0 GROUP BY 1) SELECT lg.run_id, count(DISTINCT key) FILTER (type = 'paper' AND (cut IS NULL OR seq > cut)) AS papers, count(*) FILTER (type = 'section' AND (cut IS NULL OR seq > cut)) AS sections, 'running' AS status FROM lg LEFT JOIN c USING (run_id) GROUP BY 1")
def reduced_runs(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d)
    again = (F.col("type") == "stage") & (F.col("seq") % 10 == 0)
    e = e.withColumn("payload", F.when(again, "replace").otherwise(F.col("payload"))).withColumn("type", F.when(again, "refine").otherwise(F.col("type")))
    return E.reduce_runs(e).select("run_id", "papers", "sections", "status")


@query(f"WITH {_LOG}, r AS (SELECT DISTINCT run_id, run_id % 40 AS prior FROM lg), s AS (SELECT run_id, count(*) AS s, arg_max(floor(similarity)::INT % 4, seq) AS last, max((floor(similarity)::INT % 4 > 0)::INT) AS any_some FROM lg WHERE type = 'section' GROUP BY 1), k AS (SELECT run_id, count(DISTINCT key) FILTER (type = 'paper') + count(DISTINCT key) FILTER (type = 'person') AS n FROM lg GROUP BY 1) SELECT run_id, n, n = 0 AS all_empty, coalesce(s > 1 AND last = 0 AND any_some = 1, false) AS headline_empty, n > 0 AND n < 5 AS thin, n <= prior AS no_new FROM r JOIN k USING (run_id) LEFT JOIN s USING (run_id)")
def result_flags(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d)
    of = lambda t, c: e.where(F.col("type") == t).select("run_id", F.col("key").alias(c))
    sec = e.where("type = 'section'").select("run_id", "seq", (F.floor("similarity").cast("int") % 4).alias("n_total"))
    return E.result_flags(e.select("run_id", (F.col("run_id") % 40).alias("prior_count")).distinct(), of("paper", "handle"), of("person", "short_id"), sec)


@query(f"WITH {_LOG}, s AS (SELECT run_id, string_agg('- \"' || payload || '\": ' || (seq % 3) || ' paper(s)', chr(10) ORDER BY seq) AS s FROM lg WHERE type = 'section' GROUP BY 1), p AS (SELECT run_id, seq, key, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS r FROM lg WHERE type = 'paper'), f AS (SELECT run_id, string_agg('- ' || key || ' (?, 2024)', chr(10) ORDER BY seq) FILTER (r <= 5) AS f, count(*) AS n FROM p GROUP BY 1) SELECT run_id, 'Sections:' || chr(10) || coalesce(s, '(no sections emitted)') || chr(10) || chr(10) || 'Distinct papers: ' || coalesce(n, 0) || chr(10) || chr(10) || 'Sample:' || chr(10) || coalesce(f, '(none)') AS summary FROM s FULL JOIN f USING (run_id)")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d)
    papers = e.where("type = 'paper'").select("run_id", "seq", F.col("key").alias("title"), F.lit("").alias("journal"), F.lit(2024).alias("year"))
    return E.summarize(papers, e.where("type = 'section'").select("run_id", "seq", F.col("payload").alias("title"), F.lit("papers").alias("kind"), (F.col("seq") % 3).alias("n_total")))


@query(f"WITH {A}, t AS (SELECT handle, trim(coalesce(CASE WHEN length(handle) % 3 = 0 THEN abstract ELSE title END, '')) AS t FROM a) SELECT handle, CASE WHEN length(t) < 15 THEN 'short' WHEN length(t) > 2000 THEN 'long' WHEN len(regexp_extract_all(t, '[a-zA-ZÀ-öø-ÿ]{{3,}}')) < 3 THEN 'unreadable' END AS verdict FROM t")
def brief_preflight(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "abstract")
    return a.select("handle", E.preflight(F.when(F.length("handle") % 3 == 0, F.col("abstract")).otherwise(F.col("title"))).alias("verdict"))


@query("WITH l AS (SELECT event_id, event_id % 6 AS m FROM events) SELECT event_id, CASE m WHEN 0 THEN 'paper' WHEN 1 THEN 'section' ELSE 'progress' END AS type, CASE WHEN m = 0 THEN '' END AS title, CASE WHEN m = 0 THEN 0.0 END AS year FROM l WHERE m IN (0, 1, 2)")
def valid_events(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 6
    line = F.when(m == 0, '{"type":"paper","handle":"h","url":"u","title":null}').when(m == 1, '{"type":"section","title":null,"handles":[]}').when(m == 2, '{"type":"progress","label":"x","current":null}').when(m == 3, '{"type":"paper","handle":7,"url":"u"}').when(m == 4, "{broken").otherwise('{"type":"other"}')
    line = F.when(m == 1, '{"type":"section","title":"t","handles":["a"]}').otherwise(line)
    return E.valid_events(_events(spark, d).select("event_id", line.alias("value"))).select("event_id", "type", F.when(F.col("type") == "paper", F.col("title")).alias("title"), "year")


# ---------------------------------------------------------------- guard

# Statements and what the guard makes of them.
STATEMENTS = [
    ("backquoted", "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home')", "Blocked function: java_method"),
    ("after dashes in a string", "SELECT '--', java_method('java.lang.System', 'getProperty', 'user.home')", "Blocked function: java_method"),
    ("between comment marks in strings", "SELECT '/*', java_method('java.lang.System', 'getProperty', 'user.home'), '*/'", "Blocked function: java_method"),
    ("two statements", "SELECT 1; SELECT 2", "Only SELECT queries are allowed."),
    ("command", "DROP TABLE journals", "Only SELECT queries are allowed."),
    ("unknown table", "SELECT * FROM secret", "Table not in allowlist"),
    ("table in a CTE", "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "Table not in allowlist"),
    ("table in a subquery", "SELECT * FROM journals WHERE archive IN (SELECT a FROM secret)", "Table not in allowlist"),
    ("qualified name", "SELECT * FROM main.journals", "Table not in allowlist"),
    ("file", "SELECT * FROM parquet.`/tmp/x`", "Table not in allowlist"),
    ("table function", "SELECT * FROM range(3)", "Blocked function"),
    ("parse error", "SELEC 1", "Only SELECT queries are allowed."),
    ("accepted", "SELECT count(*) AS n FROM journals", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(a, c.replace("'", "''")) for a, _, c in STATEMENTS) + ") t(name, verdict)")
def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    def verdict(sql: str) -> str:
        try:
            guarded_sql(spark, sql, {"journals": table(spark, d, "journals")})
            return ""
        except Rejected as e:
            return str(e)

    return spark.createDataFrame([(name, verdict(sql)) for name, sql, _ in STATEMENTS], "name string, verdict string")


@query(f"SELECT least(count(*), {ROWS}) AS n FROM lineitem")
def guard_row_cap(spark: SparkSession, d: str) -> DataFrame:
    return guarded_sql(spark, "SELECT l_orderkey FROM lineitem", {"lineitem": table(spark, d, "lineitem")}).agg(F.count("*").alias("n"))


@query("SELECT series_handle FROM journals WHERE length(long_name) > 30 AND category = 'Methods'")
def guard_parameters(spark: SparkSession, d: str) -> DataFrame:
    return guarded_sql(spark, "SELECT series_handle FROM journals WHERE length(long_name) > ? AND category = ?", {"journals": table(spark, d, "journals")}, args=[30, "Methods"])

