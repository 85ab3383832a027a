"""The engine's operators as queries over the corpus tables, each with the same query in SQL.

Clock-dependent operators take the fixed moments below instead of the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblyst.functions import text as T
from biblyst.operators import events as E
from biblyst.operators import graph as G
from biblyst.operators import match as M
from biblyst.operators import persons as P
from biblyst.operators import search as S
from biblyst.operators import snapshot as D
from biblyst.operators import taxonomy as X
from biblyst.operators import telemetry as L
from biblyst.plans.core_problems import table
from biblyst.plans.guard import guarded_sql
from biblyst.session import small

NOW_YEAR = 2026
AS_OF = "2024-01-30 00:00:00"
TOP = "General Interest"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- views


def articles(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """(handle, *cols): an article once, with its lower-case handle; repeated rows differ only in loaded_at.

    Only the columns asked for are read and shuffled, by the handle, so joins on it need no further exchange.
    """
    a = table(spark, d, "articles").select(T.handle_lc(F.col("Handle")).alias("handle"), *cols)
    return a.repartition("handle").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Articles as they stand, with vectors; searches count repeated rows once after the distance is known."""
    return table(spark, d, "articles").withColumn("handle", T.handle_lc(F.col("Handle")))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cit_internal").select(T.handle_lc(F.col("citing")).alias("citing"), T.handle_lc(F.col("cited")).alias("cited"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "version_links").select(T.handle_lc(F.col("source")).alias("source"), T.handle_lc(F.col("target")).alias("target"), "type")


def works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_works").select(T.handle_lc(F.col("short_id")).alias("short_id"), T.handle_lc(F.col("work_handle")).alias("work_handle"), "work_type").distinct()


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persons").select(T.handle_lc(F.col("short_id")).alias("short_id"), "name_first", "name_last", "name_full", "workplace_name").distinct()


def oa(spark: SparkSession, d: str) -> DataFrame:
    """Works with a bare DOI; the resolver's name does not matter."""
    return table(spark, d, "oa_works").select("work_id", T.normalize_doi(F.col("doi")).alias("doi"), "title", F.col("publication_year").alias("year"), "type", F.col("source_name").alias("source"), "updated_date").distinct()


def probe(spark: SparkSession, d: str) -> list[float]:
    """A fixed query vector: the first of the embeddings table."""
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


A = "a AS (SELECT DISTINCT lower(trim(Handle)) AS handle, title, abstract, year, is_series, archive, journal_code, journal, category, url, authors, doi FROM articles)"
C = "c AS (SELECT lower(trim(citing)) AS citing, lower(trim(cited)) AS cited FROM cit_internal)"
W = "w AS (SELECT DISTINCT lower(trim(short_id)) AS short_id, lower(trim(work_handle)) AS work_handle, work_type FROM person_works)"
V = "v AS (SELECT lower(trim(source)) AS source, lower(trim(target)) AS target, type FROM version_links WHERE trim(source) <> '' AND trim(target) <> '')"
PP = "pp AS (SELECT DISTINCT lower(trim(short_id)) AS short_id, name_first, name_last, name_full, workplace_name FROM persons)"


def _doi(c: str) -> str:
    x = f"regexp_replace(trim({c}), '(?i)^(https?://)?(dx\\.)?doi\\.(org|example)/', '')"
    x = f"regexp_replace({x}, '(?i)^doi:\\s*', '')"
    x = f"lower(regexp_replace({x}, '[!-/:-@\\[-`{{-~]+$', ''))"
    return f"(CASE WHEN regexp_matches({x}, '^10\\.\\d{{4,9}}/\\S+$') THEN {x} END)"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(c: str) -> str:
    return f"list_filter(list_distinct(string_split(coalesce({_norm(c)}, ''), ' ')), lambda x: x <> '')"


# Words without content in titles, typed here so that the SQL does not depend on the operator.
_STOP = ", ".join(f"'{w}'" for w in "the a an of and or in on for to from with by at as is are be its their this that new evidence case using some note".split())


def _content(c: str) -> str:
    return f"list_filter({_tokens(c)}, lambda x: x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '\\d+'))"


def _journal(c: str) -> str:
    x = f"regexp_replace(lower({c}), '&', ' and ', 'g')"
    x = f"regexp_replace({x}, '\\([^)]*\\)', '', 'g')"
    x = f"regexp_replace({x}, 'behaviour', 'behavior', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'), '^the ', ''))"


OA = f"o AS (SELECT DISTINCT work_id, {_doi('doi')} AS doi, title, publication_year AS year, type, source_name AS source, updated_date FROM oa_works)"

# ---------------------------------------------------------------- graph


@query(f"WITH {A}, {C} SELECT citing, cited FROM c WHERE citing IN (SELECT handle FROM a) AND cited IN (SELECT handle FROM a)")
def cit_internal(spark: SparkSession, d: str) -> DataFrame:
    return G.internal_edges(edges(spark, d), articles(spark, d))


_B = f"{A}, {C}, b AS (SELECT * FROM a WHERE year IS NOT NULL), i AS (SELECT * FROM c WHERE citing IN (SELECT handle FROM b) AND cited IN (SELECT handle FROM b))"
_FIRST = f"""{_B}, f AS (
  SELECT b.handle, b.year, coalesce(tc, 0) AS total_citations, coalesce(ic, 0) AS internal_citations, coalesce(tr, 0) AS total_references, coalesce(ir, 0) AS internal_references,
    {NOW_YEAR} - b.year AS years_since_pub, CASE WHEN {NOW_YEAR} - b.year > 0 THEN coalesce(tc, 0) / ({NOW_YEAR} - b.year) ELSE 0.0 END AS citations_per_year,
    percent_rank() OVER (ORDER BY coalesce(tc, 0)) AS citation_percentile
  FROM b LEFT JOIN (SELECT cited, count(*) AS tc FROM c GROUP BY 1) x1 ON x1.cited = b.handle LEFT JOIN (SELECT cited, count(*) AS ic FROM i GROUP BY 1) x2 ON x2.cited = b.handle
  LEFT JOIN (SELECT citing, count(*) AS tr FROM c GROUP BY 1) x3 ON x3.citing = b.handle LEFT JOIN (SELECT citing, count(*) AS ir FROM i GROUP BY 1) x4 ON x4.citing = b.handle)"""
_CITERS = f"{_FIRST}, z AS (SELECT i.cited, b.category, b.journal, b.year, f.citation_percentile FROM i JOIN b ON b.handle = i.citing JOIN f ON f.handle = i.citing)"


@query(f"WITH {_FIRST} SELECT handle, year, total_citations, internal_citations, total_references, internal_references, years_since_pub, round(citations_per_year, 6) AS citations_per_year, round(citation_percentile, 6) AS citation_percentile FROM f")
def handle_stats_first(spark: SparkSession, d: str) -> DataFrame:
    out = G.handle_stats_first(articles(spark, d, "year"), edges(spark, d), NOW_YEAR)
    return out.withColumns({c: F.round(c, 6) for c in ("citations_per_year", "citation_percentile")})


def _citers(spark: SparkSession, d: str) -> DataFrame:
    a, e = articles(spark, d, "year", "category", "journal"), edges(spark, d)
    return G.citers(a, e, G.handle_stats_first(a, e, NOW_YEAR))


@query(f"""WITH {_CITERS} SELECT cited AS handle, round(median(citation_percentile), 6) AS median_citer_percentile, round(avg(citation_percentile), 6) AS mean_citer_percentile,
  round(max(citation_percentile), 6) AS max_citer_percentile, round(sum(citation_percentile), 4) AS weighted_citations, round(count(*) FILTER (category = '{TOP}') / count(*), 6) AS top_category_share FROM z GROUP BY cited""")
def handle_stats_second(spark: SparkSession, d: str) -> DataFrame:
    out = G.handle_stats_second(_citers(spark, d), TOP)
    return out.withColumns({c: F.round(c, 4 if c == "weighted_citations" else 6) for c in out.columns if c != "handle"})


@query(f"WITH {_CITERS} SELECT cited AS handle, year, count(*) AS n FROM z GROUP BY ALL")
def citations_by_year(spark: SparkSession, d: str) -> DataFrame:
    return G.citations_by_year(_citers(spark, d)).select("handle", F.explode(F.arrays_zip("years", "counts")).alias("x")).select("handle", F.col("x.years").alias("year"), F.col("x.counts").alias("n"))


@query(f"WITH {_CITERS} SELECT cited AS handle, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cited), 6) AS share FROM z WHERE category IS NOT NULL GROUP BY cited, category")
def citer_categories(spark: SparkSession, d: str) -> DataFrame:
    return G.citer_categories(_citers(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {_CITERS}, n AS (SELECT cited, journal, count(*) AS n FROM z WHERE journal IS NOT NULL GROUP BY ALL) SELECT cited AS handle, journal AS top_citing_journal FROM n QUALIFY row_number() OVER (PARTITION BY cited ORDER BY n DESC, journal) = 1")
def top_citing_journal(spark: SparkSession, d: str) -> DataFrame:
    return G.mode(_citers(spark, d).withColumnRenamed("cited", "handle"), ["handle"], "journal", "top_citing_journal")


@query(f"WITH {A}, {C} SELECT citing, cited, title, year FROM c LEFT JOIN a ON a.handle = c.cited")
def cites(spark: SparkSession, d: str) -> DataFrame:
    return G.with_article(edges(spark, d), "cited", articles(spark, d, "title", "year")).select("citing", "cited", "title", "year")


@query(f"WITH {A}, {C} SELECT cited, citing, title, year FROM c JOIN a ON a.handle = c.citing")
def citedby(spark: SparkSession, d: str) -> DataFrame:
    return G.with_article(edges(spark, d), "citing", articles(spark, d, "title", "year"), "inner").select("cited", "citing", "title", "year")


@query(f"WITH {C} SELECT cited AS handle, count(*) AS n, count(DISTINCT citing) AS distinct_citers FROM c GROUP BY 1")
def citation_counts(spark: SparkSession, d: str) -> DataFrame:
    # distinct edges first: the hot handle's citers are never gathered
    return edges(spark, d).groupBy("cited", "citing").agg(F.count("*").alias("k")).groupBy(F.col("cited").alias("handle")).agg(F.sum("k").alias("n"), F.count("*").alias("distinct_citers"))


@query(f"WITH {V} SELECT source AS handle, target AS other, type FROM v")
def versions_directed(spark: SparkSession, d: str) -> DataFrame:
    return G.versions_of(links(spark, d), False)


@query(f"WITH {A}, {V}, b AS (SELECT source AS handle, target AS other, type FROM v UNION ALL SELECT target, source, type FROM v) SELECT b.handle, other, type, title FROM b LEFT JOIN a ON a.handle = b.other")
def versions_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    both = G.versions_of(links(spark, d), True)
    return both.join(articles(spark, d, "title").select(F.col("handle").alias("other"), "title"), "other", "left").select("handle", "other", "type", "title")


@query(f"""WITH {C}, e AS (SELECT DISTINCT citing, cited FROM c), x AS (SELECT * FROM e), r AS (SELECT citing, count(*) AS n FROM e GROUP BY 1),
  p AS (SELECT x.citing AS a, y.citing AS b, count(*) AS shared FROM x JOIN x y ON x.cited = y.cited AND x.citing < y.citing GROUP BY ALL HAVING count(*) >= 2)
  SELECT a, b, shared, round(shared / (ra.n + rb.n - shared), 6) AS strength FROM p JOIN r ra ON ra.citing = a JOIN r rb ON rb.citing = b""")
def bibliographic_coupling(spark: SparkSession, d: str) -> DataFrame:
    return G.coupling(edges(spark, d), 2, 50).withColumn("strength", F.round("strength", 6))


# ---------------------------------------------------------------- persons


_PSTATS = f"""{_B}, {W}, {PP}, tot AS (SELECT cited, count(*) AS tc FROM c GROUP BY 1),
  ins AS (SELECT w.short_id, a.year, a.category, CASE WHEN a.year IS NOT NULL THEN coalesce(tc, 0) END AS tc FROM w JOIN a ON a.handle = w.work_handle LEFT JOIN tot ON tot.cited = a.handle),
  g AS (SELECT short_id, count(*) AS n_works_in_corpus, coalesce(sum(tc), 0)::BIGINT AS total_citations, count(*) FILTER (category = '{TOP}') AS a_count, min(year) AS first_year, max(year) AS last_year FROM ins GROUP BY 1),
  m AS (SELECT short_id, category FROM ins GROUP BY short_id, category QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY count(*) DESC, category ASC NULLS LAST) = 1),
  ps AS (SELECT p.short_id, coalesce(n, 0) AS n_works_total, coalesce(n_works_in_corpus, 0) AS n_works_in_corpus, coalesce(total_citations, 0) AS total_citations, coalesce(a_count, 0) AS a_count, first_year, last_year, m.category AS primary_category
    FROM (SELECT DISTINCT short_id FROM pp) p LEFT JOIN (SELECT short_id, count(*) AS n FROM w GROUP BY 1) t USING (short_id) LEFT JOIN g USING (short_id) LEFT JOIN m USING (short_id))"""


@query(f"WITH {_PSTATS} SELECT * FROM ps")
def person_stats(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "year", "category")
    return P.person_stats(people(spark, d), works(spark, d), a, G.handle_stats_first(a, edges(spark, d), NOW_YEAR), TOP)


_VEC = "qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT lower(trim(Handle)) AS handle, any_value(title) AS title, any_value(year) AS year, any_value(journal) AS journal, any_value(category) AS category, any_value(embeddings) AS v FROM articles GROUP BY 1), ok AS (SELECT e.* FROM e WHERE len(v) = 64 AND len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0), s AS (SELECT handle, title, year, journal, category, list_cosine_similarity(v::DOUBLE[], q::DOUBLE[]) AS sim FROM ok, qv)"


def _search(spark: SparkSession, d: str, mode: str) -> DataFrame:
    a = articles(spark, d, "year", "category")
    hits = S.semantic_search(vectors(spark, d), probe(spark, d), 600)
    hits = vectors(spark, d).select("handle", "title").join(F.broadcast(hits), "handle").distinct()  # 600 rows
    stats = P.person_stats(people(spark, d), works(spark, d), a, G.handle_stats_first(a, edges(spark, d), NOW_YEAR), TOP)
    return P.person_search(hits, works(spark, d), stats, mode)


def _search_sql(score: str) -> str:
    return f"""WITH {_PSTATS}, {_VEC}, h AS (SELECT * FROM s ORDER BY sim DESC, handle LIMIT 600),
  r AS (SELECT w.short_id, h.handle, h.sim FROM h JOIN (SELECT DISTINCT short_id, work_handle FROM w) w ON w.work_handle = h.handle QUALIFY row_number() OVER (PARTITION BY w.short_id, lower(trim(coalesce(title, handle))) ORDER BY sim DESC, handle) = 1),
  o AS (SELECT short_id, sum(sim) AS overlap, count(*) AS n_hits, max(sim) AS best, array_to_string((list(handle ORDER BY sim DESC, handle))[1:5], '|') AS evidence FROM r GROUP BY 1),
  k AS (SELECT o.*, ln(1 + coalesce(total_citations, 0)) AS lc FROM o LEFT JOIN ps USING (short_id)),
  q AS (SELECT *, 1 + 0.3 * CASE WHEN max(lc) OVER () > 0 THEN lc / max(lc) OVER () ELSE 0 END AS qb, overlap / max(overlap) OVER () AS onorm FROM k)
  SELECT short_id, round({score}, 6) AS score, n_hits, round(best, 6) AS best, evidence FROM q ORDER BY score DESC, short_id LIMIT 25"""


@query(_search_sql("overlap * qb"))
def person_search_breadth(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "breadth")


@query(_search_sql("best * qb"))
def person_search_best(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "best_match")


@query(_search_sql("(0.5 * onorm + 0.5 * best) * qb"))
def person_search_blended(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "blended")


@query(f"WITH {A}, {W} SELECT short_id, category, count(*) AS n FROM w JOIN a ON a.handle = work_handle GROUP BY ALL")
def person_profile_categories(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_counts(works(spark, d), articles(spark, d, "category"), "category")


@query(f"WITH {A}, {W} SELECT short_id, journal, count(*) AS n, row_number() OVER (PARTITION BY short_id ORDER BY count(*) DESC, journal ASC NULLS LAST) AS rank FROM w JOIN a ON a.handle = work_handle GROUP BY short_id, journal QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY count(*) DESC, journal ASC NULLS LAST) <= 5")
def person_profile_journals(spark: SparkSession, d: str) -> DataFrame:
    return P.top_per_key(P.profile_counts(works(spark, d), articles(spark, d, "journal"), "journal"), "short_id", "journal", "n", 5)


@query(f"WITH {A}, {W}, {C} SELECT short_id, work_handle, work_type, title, year, coalesce(n, 0) AS citations FROM w JOIN a ON a.handle = work_handle LEFT JOIN (SELECT cited, count(*) AS n FROM c GROUP BY 1) x ON x.cited = work_handle")
def person_papers(spark: SparkSession, d: str) -> DataFrame:
    n = edges(spark, d).groupBy(F.col("cited").alias("work_handle")).agg(F.count("*").alias("citations"))
    a = articles(spark, d, "title", "year").select(F.col("handle").alias("work_handle"), "title", "year")
    return works(spark, d).join(a, "work_handle").join(n, "work_handle", "left").select("short_id", "work_handle", "work_type", "title", "year", F.coalesce("citations", F.lit(0)).alias("citations"))


@query(f"WITH {A}, {W} SELECT short_id, work_handle, work_type FROM w WHERE work_handle IS NOT NULL AND work_handle NOT IN (SELECT handle FROM a)")
def out_of_corpus(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).where("work_handle is not null").join(articles(spark, d).select(F.col("handle").alias("work_handle")), "work_handle", "left_anti").select("short_id", "work_handle", "work_type")


@query(f"WITH {W} SELECT short_id, j.series_handle, j.long_name FROM w JOIN journals j ON j.series_handle = w.work_handle WHERE work_type = 'editor-series'")
def editor_roles(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "journals").select("series_handle", "long_name")
    return works(spark, d).where("work_type = 'editor-series'").join(small(j), F.col("work_handle") == F.col("series_handle")).select("short_id", "series_handle", "long_name")


@query(f"WITH {PP} SELECT short_id, name_full, workplace_name FROM pp WHERE contains(lower(name_full), 'nova')")
def person_lookup(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).where(S.contains_ci(F.col("name_full"), "nova")).select("short_id", "name_full", "workplace_name")


@query(f"WITH {W}, {A} SELECT DISTINCT short_id, work_handle, 'https://ideas.example/' || coalesce(CASE work_type WHEN 'article' THEN 'a' WHEN 'paper' THEN 'p' WHEN 'chapter' THEN 'h' WHEN 'book' THEN 'b' WHEN 'software' THEN 'e' WHEN 'editor-book' THEN 'b' WHEN 'editor-series' THEN 's' END, 'p') || '/' || replace(regexp_replace(work_handle, '^repec:', ''), ':', '/') || '.html' AS address FROM w WHERE work_handle IS NOT NULL")
def work_addresses(spark: SparkSession, d: str) -> DataFrame:
    return works(spark, d).where("work_handle is not null").select("short_id", "work_handle", T.address(F.col("work_handle"), F.col("work_type")).alias("address")).distinct()


# ---------------------------------------------------------------- search


@query(f"WITH {_VEC} SELECT handle, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, handle LIMIT 50")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.semantic_search(vectors(spark, d), probe(spark, d), 50).select("handle", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_VEC} SELECT handle, round(sim, 6) AS similarity FROM s WHERE year >= 2010 AND year <= 2020 AND category IN ('Working Papers', 'Methods') AND (contains(lower(journal), 'paper') OR contains(lower(journal), 'quarterly')) ORDER BY sim DESC, handle LIMIT 20")
def semantic_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = S.paper_filters(2010, 2020, ["Working Papers", "Methods"], ["paper", "Quarterly"])
    return S.semantic_search(vectors(spark, d), probe(spark, d), 20, f).select("handle", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_VEC}, p AS (SELECT * FROM s ORDER BY sim DESC, handle LIMIT 300) SELECT handle, round(sim, 6) AS similarity FROM p WHERE year >= 2015 ORDER BY sim DESC, handle LIMIT 20")
def semantic_pool(spark: SparkSession, d: str) -> DataFrame:
    return S.semantic_search(vectors(spark, d), probe(spark, d), 20, S.paper_filters(2015), pool=300).select("handle", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A} SELECT handle, title, year FROM a WHERE contains(lower(title), 'tariff') OR contains(lower(title), 'auction')")
def keyword_any(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(articles(spark, d, "title", "year"), ["tariff", " auction ", ""]).select("handle", "title", "year")


@query(f"WITH {A} SELECT handle, title, year FROM a WHERE (contains(lower(title), 'wage') OR contains(lower(abstract), 'wage')) AND (contains(lower(title), 'percent') OR contains(lower(abstract), 'percent')) AND year >= 2000")
def keyword_all(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_search(articles(spark, d, "title", "abstract", "year"), ["Wage", "percent"], ("title", "abstract"), "all", F.col("year") >= 2000).select("handle", "title", "year")


@query(f"WITH {A}, {C} SELECT handle, year, coalesce(n, 0) AS citations FROM a LEFT JOIN (SELECT cited, count(*) AS n FROM c GROUP BY 1) x ON x.cited = handle WHERE contains(lower(title), 'lessons') ORDER BY citations DESC, year DESC NULLS LAST, handle LIMIT 20 OFFSET 10")
def keyword_citations_order(spark: SparkSession, d: str) -> DataFrame:
    n = edges(spark, d).groupBy(F.col("cited").alias("handle")).agg(F.count("*").alias("citations"))
    hit = S.keyword_search(articles(spark, d, "title", "year"), ["lessons"]).select("handle", "year").join(n, "handle", "left").fillna(0, ["citations"])
    return S.page(hit, [F.desc("citations"), *S.by_year(hit)], 20, 10)


_REFS = f"{A}, r AS (SELECT handle AS entry_id, CASE WHEN length(handle) % 3 = 0 THEN handle END AS e_handle, title, year + CASE WHEN length(handle) % 5 = 0 THEN 1 ELSE 0 END AS e_year, authors, journal AS e_journal FROM a)"


def _author(c: str) -> str:
    return f"nullif(lower(string_split_regex(trim(string_split({c}, ';')[1]), '\\s+')[-1]), '')"


def _keyword(c: str) -> str:
    # Words that make no good title keyword.
    weak = ", ".join(f"'{w}'" for w in "their which these those about between through".split())
    return f"coalesce(list_filter(regexp_extract_all({c}, '[A-Za-z]{{5,}}'), lambda x: lower(x) NOT IN ({weak}))[1], nullif(regexp_extract({c}, '[A-Za-z0-9_]{{4,}}'), ''))"


@query(f"""WITH {_REFS}, e AS (SELECT *, nullif(lower(trim(string_split(authors, ';')[1])), '') AS au, lower({_keyword("title")}) AS kw, nullif(regexp_extract(lower(trim(title)), '^\\S+\\s+\\S+'), '') AS two FROM r), b AS (SELECT handle, lower(title) AS t, year, journal, lower(authors) AS au FROM a),
  x AS (SELECT entry_id, 1 AS tier, b.handle, e_year, b.year, e_journal, b.journal FROM e JOIN b ON e.e_handle = b.handle UNION ALL SELECT entry_id, 2, b.handle, e_year, b.year, e_journal, b.journal FROM e JOIN b ON e_year = b.year AND contains(b.au, e.au) AND contains(b.t, kw)
    UNION ALL SELECT entry_id, 3, b.handle, e_year, b.year, e_journal, b.journal FROM e JOIN b ON b.year BETWEEN e_year - 1 AND e_year + 1 AND contains(b.au, e.au) AND contains(b.t, two))
  SELECT entry_id, tier, handle, coalesce(abs(e_year - year) > 1, false) AS year_mismatch, coalesce(NOT contains(lower(e_journal), lower(journal)) AND NOT contains(lower(journal), lower(e_journal)), false) AS journal_mismatch
  FROM x QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY tier, year DESC NULLS LAST, handle) = 1""")
def verify_refs(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "year", "authors", "journal")
    n = F.length("handle")
    entries = a.select(F.col("handle").alias("entry_id"), F.when(n % 3 == 0, F.col("handle")).alias("handle"), "title", (F.col("year") + F.when(n % 5 == 0, 1).otherwise(0)).alias("year"), "authors", "journal")
    return S.verify_references(entries, a)


@query(f"WITH {A} SELECT category, journal, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, journal ASC NULLS LAST) AS rank FROM a GROUP BY category, journal QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, journal ASC NULLS LAST) <= 8")
def corpus_guide_top8(spark: SparkSession, d: str) -> DataFrame:
    return P.top_per_key(articles(spark, d, "category", "journal").groupBy("category", "journal").agg(F.count("*").alias("n")), "category", "journal", "n", 8)


@query(f"WITH {A} SELECT journal, count(*) AS n FROM a GROUP BY 1")
def stats_journals(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(articles(spark, d, "journal"), "journal")


@query(f"WITH {A} SELECT category, count(*) AS n FROM a GROUP BY 1")
def stats_categories(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(articles(spark, d, "category"), "category")


@query(f"WITH {A}, {C} SELECT count(*) AS papers, count(DISTINCT journal) AS journals, count(DISTINCT category) AS categories, (SELECT count(*) FROM c) AS citations, count(*) FILTER (doi IS NOT NULL) AS with_doi FROM a")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    one = articles(spark, d, "journal", "category", "doi").agg(F.count("*").alias("papers"), F.countDistinct("journal").alias("journals"), F.countDistinct("category").alias("categories"), F.count("doi").alias("with_doi"))
    return one.join(F.broadcast(edges(spark, d).agg(F.count("*").alias("citations"))))


# ---------------------------------------------------------------- text and matching


@query(f"WITH {A} SELECT handle, {_doi('doi')} AS doi FROM a")
def normalize_doi(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "doi").select("handle", T.normalize_doi(F.col("doi")).alias("doi"))


@query(f"WITH {A} SELECT handle, {_doi('x')} AS doi FROM (SELECT handle, nullif(regexp_extract(doi, '10\\.\\d{{4,9}}/[^\\s?#&]+'), '') AS x FROM a) WHERE {_doi('x')} IS NOT NULL")
def doi_from_url(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "url", "doi").select("handle", T.doi_from_url(F.col("doi")).alias("doi")).where("doi is not null")


@query(f"WITH {A} SELECT handle, url FROM a WHERE contains(lower(url), 'papers.example') OR contains(lower(url), 'wp.example')")
def host_filter(spark: SparkSession, d: str) -> DataFrame:
    hosts = ["papers.example", "wp.example"]
    return articles(spark, d, "url").where(F.coalesce(S.contains_ci(F.col("url"), hosts[0]) | S.contains_ci(F.col("url"), hosts[1]), F.lit(False))).select("handle", "url")


@query(f"WITH {A} SELECT journal, {_journal('journal')} AS name FROM a GROUP BY 1")
def journal_names(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "journal").select("journal").distinct().withColumn("name", T.journal_name(F.col("journal")))


@query(f"WITH {A} SELECT handle, array_to_string(list_sort({_content('title')}), ' ') AS content_key, {_keyword('title')} AS keyword, {_author('authors')} AS author, nullif(trim(string_split(authors, ';')[1]), '') AS lastname FROM a WHERE title IS NOT NULL")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "authors").where("title is not null")
    return a.select("handle", T.content_key(F.col("title")).alias("content_key"), T.title_keyword(F.col("title")).alias("keyword"), T.first_author_token(F.col("authors")).alias("author"), T.first_author_lastname(F.col("authors")).alias("lastname"))


@query(f"WITH {A}, {V} SELECT source, target, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS sim FROM (SELECT DISTINCT source, target, {_tokens('p.title')} AS x, {_tokens('q.title')} AS y FROM v JOIN a p ON p.handle = source JOIN a q ON q.handle = target)")
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title").select("handle", "title")
    pairs = links(spark, d).select("source", "target").distinct().join(a.toDF("source", "t1"), "source").join(a.toDF("target", "t2"), "target")
    return pairs.select("source", "target", F.round(T.title_sim(F.col("t1"), F.col("t2")), 6).alias("sim"))


@query(f"WITH {PP} SELECT short_id, trim(CASE WHEN regexp_extract(coalesce(workplace_name, ''), '\\(([^()]*)\\)\\s*$', 1) <> '' THEN regexp_extract(workplace_name, '\\(([^()]*)\\)\\s*$', 1) ELSE regexp_extract(coalesce(workplace_name, ''), ',([^,]*)$', 1) END) AS country FROM pp")
def country(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("short_id", T.country(F.col("workplace_name")).alias("country"))


@query(f"WITH {A} SELECT handle, coalesce(nullif(substr(array_to_string(list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '\\s+'), lambda x: x <> '')[1:6], '-'), 1, 60), ''), 'search') AS slug FROM a WHERE title IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title").where("title is not null").select("handle", T.slugify(F.col("title")).alias("slug"))


_TRUST = "t AS (SELECT source, prefix, n / sum(n) OVER (PARTITION BY source) AS share FROM (SELECT source, regexp_extract(doi, '^(10\\.\\d{4,9})/', 1) AS prefix, count(*) AS n FROM o WHERE doi IS NOT NULL AND source IS NOT NULL GROUP BY ALL) WHERE prefix <> ''), tr AS (SELECT * FROM t WHERE share >= 0.05)"


@query(f"WITH {OA}, {_TRUST} SELECT source, prefix, round(share, 6) AS share FROM tr")
def trusted_prefix(spark: SparkSession, d: str) -> DataFrame:
    return M.trusted_prefixes(oa(spark, d)).withColumn("share", F.round("share", 6))


_SRC = f"src AS (SELECT source, count(*) AS works FROM o WHERE source IS NOT NULL GROUP BY 1), js AS (SELECT DISTINCT journal FROM a WHERE journal IS NOT NULL), rs AS (SELECT journal, source, works FROM (SELECT journal, {_journal('journal')} AS n FROM js) LEFT JOIN (SELECT source, works, {_journal('source')} AS n FROM src) USING (n) QUALIFY row_number() OVER (PARTITION BY journal ORDER BY works DESC NULLS LAST, source ASC NULLS LAST) = 1)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    s = oa(spark, d).where("source is not null").groupBy("source").agg(F.count("*").alias("works"))
    return M.resolve_sources(articles(spark, d, "journal").select("journal").where("journal is not null").distinct(), s)


@query(f"WITH {A}, {OA}, {_SRC} SELECT journal, source, works FROM rs")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d)


_PAPERS = f"pa AS (SELECT handle, rs.source, a.title, a.year, list_sort({_content('a.title')}) AS tok FROM a JOIN rs USING (journal) WHERE rs.source IS NOT NULL AND len({_content('a.title')}) >= 3), wo AS (SELECT DISTINCT o.doi, o.source, o.year AS w_year, list_sort({_content('o.title')}) AS w_tok FROM o JOIN tr ON tr.source = o.source AND tr.prefix = regexp_extract(o.doi, '^(10\\.\\d{{4,9}})/', 1) WHERE o.doi IS NOT NULL AND len({_content('o.title')}) >= 3), ex AS (SELECT handle, doi FROM pa JOIN wo ON wo.source = pa.source AND tok = w_tok AND abs(year - w_year) <= 1 QUALIFY row_number() OVER (PARTITION BY handle ORDER BY doi) = 1)"


def _match(spark: SparkSession, d: str, fuzzy: float | None) -> DataFrame:
    a = articles(spark, d, "title", "year", "journal")
    papers = a.join(_sources(spark, d).where("source is not null").select("journal", "source"), "journal").select("handle", "source", "title", "year")
    o = oa(spark, d)
    w = o.where("doi is not null").select("doi", "source", "title", "year")
    return M.title_match(papers, w, M.trusted_prefixes(o), fuzzy).withColumn("content_sim", F.round("content_sim", 6))


@query(f"WITH {A}, {OA}, {_TRUST}, {_SRC}, {_PAPERS} SELECT handle, doi, 1.0::DOUBLE AS content_sim, 'exact' AS match_type FROM ex")
def content_key_match(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, None)


@query(f"""WITH {A}, {OA}, {_TRUST}, {_SRC}, {_PAPERS}, rest AS (SELECT * FROM pa WHERE handle NOT IN (SELECT handle FROM ex)), pairs AS (SELECT handle, doi, len(list_intersect(tok, w_tok)) / least(len(tok), len(w_tok)) AS sim FROM rest JOIN wo ON wo.source = rest.source AND abs(year - w_year) <= 1)
  SELECT handle, doi, 1.0::DOUBLE AS content_sim, 'exact' AS match_type FROM ex UNION ALL
  (SELECT handle, doi, round(sim, 6), 'fuzzy' FROM pairs WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY handle ORDER BY sim DESC, doi) = 1)""")
def fuzzy_containment(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, 0.9)


_FRESH = "fr AS (SELECT * FROM o WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY updated_date DESC, work_id) = 1)"


@query(f"WITH {A}, {OA}, {_FRESH} SELECT a.handle, fr.work_id, fr.doi, fr.type, fr.updated_date::VARCHAR AS updated FROM a JOIN fr ON {_doi('a.doi')} = fr.doi")
def openalex_freshest(spark: SparkSession, d: str) -> DataFrame:
    best = M.freshest(oa(spark, d), "doi", F.desc("updated_date"), F.col("work_id"))
    a = articles(spark, d, "doi").select("handle", T.normalize_doi(F.col("doi")).alias("doi"))
    return M.enrich(a, best.select("doi", "work_id", "type", F.col("updated_date").cast("string").alias("updated"))).select("handle", "work_id", "doi", "type", "updated")


@query(f"WITH {A} SELECT journal, count(*) AS n FROM a WHERE doi IS NULL AND title IS NOT NULL AND year IS NOT NULL AND journal IS NOT NULL AND NOT is_series GROUP BY 1 HAVING count(*) >= 2")
def doiless_journals(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "doi", "title", "year", "journal", "is_series").where("doi is null and title is not null and year is not null and journal is not null and not is_series")
    return L.histogram(a, "journal").where("n >= 2")


@query(f"WITH {A} SELECT a.handle, a.year, coalesce(j.long_name, a.journal) AS journal, j.category FROM a LEFT JOIN journals j ON j.archive = a.archive AND j.journal_code = a.journal_code WHERE ((a.year >= 1995 AND NOT is_series) OR (a.year >= 2010 AND is_series)) AND length(abstract) > 100")
def load_cleaned(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "year", "is_series", "abstract", "archive", "journal_code", "journal").where("((year >= 1995 and not is_series) or (year >= 2010 and is_series)) and length(abstract) > 100")
    j = table(spark, d, "journals").select("archive", "journal_code", "long_name", "category")
    return a.join(small(j), ["archive", "journal_code"], "left").select("handle", "year", F.coalesce("long_name", "journal").alias("journal"), "category")


# ---------------------------------------------------------------- snapshots


def _base(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "title", "year", "doi").select("handle", "title", "year", "doi")


def _update(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic edit: some rows gone, some changed, some new."""
    n = F.length("handle")
    b = _base(spark, d).where(n % 7 != 0).withColumn("year", F.when(n % 5 == 0, F.col("year") + 1).otherwise(F.col("year")))
    return b.unionByName(_base(spark, d).where(n % 11 == 0).withColumn("handle", F.concat("handle", F.lit(":new"))))


_BU = f"{A}, ba AS (SELECT handle, title, year, doi FROM a), up AS (SELECT handle, title, CASE WHEN length(handle) % 5 = 0 THEN year + 1 ELSE year END AS year, doi FROM ba WHERE length(handle) % 7 <> 0 UNION ALL SELECT handle || ':new', title, year, doi FROM ba WHERE length(handle) % 11 = 0)"


@query(f"WITH {_BU} SELECT up.*, 'NEW' AS operation FROM up WHERE handle NOT IN (SELECT handle FROM ba) UNION ALL SELECT ba.*, 'DELETE' FROM ba WHERE handle NOT IN (SELECT handle FROM up) UNION ALL SELECT up.*, 'UPDATE' FROM up JOIN ba USING (handle) WHERE ba.title IS DISTINCT FROM up.title OR ba.year IS DISTINCT FROM up.year OR ba.doi IS DISTINCT FROM up.doi")
def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.diff(_base(spark, d), _update(spark, d), ["handle"])


@query(f"WITH {_BU} SELECT * FROM up")
def diff_apply(spark: SparkSession, d: str) -> DataFrame:
    return D.apply_diff(_base(spark, d), D.diff(_base(spark, d), _update(spark, d), ["handle"]), ["handle"])


@query(f"WITH {_BU} SELECT handle, title, year, CASE WHEN length(handle) % 4 = 0 THEN NULL ELSE doi END AS doi FROM ba")
def patch_update(spark: SparkSession, d: str) -> DataFrame:
    patch = _base(spark, d).where(F.length("handle") % 4 == 0).select("handle", F.lit(None).cast("string").alias("doi"))
    return D.apply_patch(_base(spark, d), patch, "update_columns", ["handle"])


@query(f"WITH {_BU} SELECT * FROM ba WHERE handle NOT IN (SELECT handle FROM up) UNION ALL SELECT * FROM up")
def patch_upsert(spark: SparkSession, d: str) -> DataFrame:
    return D.apply_patch(_base(spark, d), _update(spark, d), "upsert_rows", ["handle"])


# ---------------------------------------------------------------- telemetry and events


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query(f"SELECT count(*) AS total, round(avg(value), 6) AS avg_value, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (value > 50) AS large FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}'")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    e = L.since(_events(spark, d), F.lit(AS_OF).cast("timestamp_ntz"), 7)
    counters = {"purchases": F.col("event_type") == "purchase", "errors": F.col("event_type") == "error", "clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view", "large": F.col("value") > 50}
    return L.log_stats(e, {"avg_value": "value"}, counters).withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def log_modes(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(_events(spark, d), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) - lag(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS change FROM events GROUP BY 1")
def day_trend(spark: SparkSession, d: str) -> DataFrame:
    return L.daily(_events(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT event_id, floor(epoch(ts) / 3600)::BIGINT AS slot, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS in_window, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return L.rate_limit(_events(spark, d), 3600, 2).select("event_id", F.col("slot").cast("bigint").alias("slot"), "in_window", "accepted")


@query(f"SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 'error' ELSE event_type END AS status FROM events")
def stale_sweep(spark: SparkSession, d: str) -> DataFrame:
    runs = _events(spark, d).select("event_id", F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return L.sweep(runs, F.lit(AS_OF).cast("timestamp_ntz"), 48, "view", "error").select("event_id", "status")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("type"), F.col("props").alias("payload"))
    return E.assign_seq(e, ["ts", "event_id"])


_EV = "ev AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS type, props AS payload FROM events)"


@query(f"WITH {_EV} SELECT run_id, string_agg(payload, '' ORDER BY seq) AS text FROM ev WHERE type = 'click' GROUP BY 1")
def synthesis_concat(spark: SparkSession, d: str) -> DataFrame:
    return E.concat_deltas(_runs(spark, d), "click")


@query(f"WITH {_EV} SELECT run_id, type, arg_max(payload, seq) AS payload, max(seq) AS seq FROM ev GROUP BY ALL")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return E.last_wins(_runs(spark, d))


@query(f"WITH {_EV} SELECT run_id, payload, min(seq) AS seq FROM ev GROUP BY ALL")
def first_emission(spark: SparkSession, d: str) -> DataFrame:
    return E.first_emission(_runs(spark, d), "payload")


@query(f"WITH {_EV} SELECT run_id, seq, type FROM ev WHERE seq >= 20")
def replay_from_seq(spark: SparkSession, d: str) -> DataFrame:
    return E.replay(_runs(spark, d), 20).select("run_id", "seq", "type")


@query(f"WITH {_EV}, s AS (SELECT *, sum(length(payload)) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS x FROM ev) SELECT run_id, seq FROM s WHERE x <= 500")
def size_cap(spark: SparkSession, d: str) -> DataFrame:
    return E.capped(_runs(spark, d).withColumn("size", F.length("payload")), "size", 500).select("run_id", "seq")


# ---------------------------------------------------------------- taxonomy, guard, parsing


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("label"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("label"), F.lit(2).alias("level"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    return r.unionByName(n)


@query("WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS code, r_name AS label, 1 AS level, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 2, 'R' || n_regionkey FROM nation), h AS (SELECT code, parent FROM t WHERE code LIKE 'N1%' OR contains(lower(label), 'n1') UNION SELECT t.code, t.parent FROM t JOIN h ON t.code = h.parent) SELECT code, label, level, parent FROM t WHERE code IN (SELECT code FROM h)")
def jel_closure(spark: SparkSession, d: str) -> DataFrame:
    return X.closure(_tree(spark, d), "n1")


@query("WITH k AS (SELECT DISTINCT lower(trim(Handle)) AS handle, upper(left(journal_code, 1)) || (year % 100) AS code FROM articles WHERE journal_code IS NOT NULL AND year IS NOT NULL) SELECT DISTINCT handle FROM k WHERE starts_with(code, 'J1') OR starts_with(code, 'B2')")
def jel_semi(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "journal_code", "year")
    codes = a.where("journal_code is not null and year is not null").select("handle", F.concat(F.upper(F.substring("journal_code", 1, 1)), (F.col("year") % 100).cast("string")).alias("code"))
    return X.with_codes(a, codes, ["j1", " B2 ", "bad!"]).select("handle").distinct()


@query("SELECT category, count(*) AS n FROM journals WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 5000")
def guarded_sql_accept(spark: SparkSession, d: str) -> DataFrame:
    return guarded_sql(spark, "WITH x AS (SELECT category FROM journals WHERE category IS NOT NULL) SELECT category, count(*) AS n FROM x GROUP BY category ORDER BY n DESC, category", {"journals": table(spark, d, "journals")})


@query("SELECT cited, citing FROM (SELECT lower(trim(cited)) AS cited, unnest(string_split(string_agg(lower(trim(citing)), '#'), '#')) AS citing FROM cit_internal GROUP BY 1)")
def iscited_explode(spark: SparkSession, d: str) -> DataFrame:
    from biblyst.sources.citations import explode_edges

    e = edges(spark, d)
    lines = e.select(F.concat_ws(" ", "cited", "citing").alias("value"))
    return explode_edges(lines).select("cited", "citing")


@query(f"WITH {A} SELECT handle, list_filter(list_transform(string_split_regex(authors, '\\s+and\\s+|,\\s*'), lambda x: trim(x)), lambda x: x <> '')[1] AS first_part, len(list_filter(list_transform(string_split_regex(authors, '\\s+and\\s+|,\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS parts FROM a WHERE authors IS NOT NULL")
def author_list_split(spark: SparkSession, d: str) -> DataFrame:
    parts = T.split_author_list(F.col("authors"))
    return articles(spark, d, "authors").where("authors is not null").select("handle", F.get(parts, F.lit(0)).alias("first_part"), F.size(parts).alias("parts"))


@query(f"WITH {A} SELECT archive, journal_code, count(*) AS n, row_number() OVER (PARTITION BY archive ORDER BY count(*) DESC, journal_code) AS rank, round(count(*) / sum(count(*)) OVER (PARTITION BY archive), 6) AS share FROM a GROUP BY archive, journal_code")
def archive_shares(spark: SparkSession, d: str) -> DataFrame:
    n = articles(spark, d, "archive", "journal_code").groupBy("archive", "journal_code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("archive")
    return n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), F.col("journal_code").asc_nulls_last()))).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))
