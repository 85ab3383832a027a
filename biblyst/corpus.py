"""One object that ties the operators to a corpus: its verbs are the queries a user runs.

Tables are DataFrames by name; one that is missing behaves as empty. Nothing
runs until a result is collected, except for limits and broken arguments,
which are dealt with at the call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblyst.functions import text as T
from biblyst.operators import enrich, graph, persons, search, taxonomy
from biblyst.operators.match import first_by
from biblyst.plans.guard import guarded_sql

# Columns by which a missing table is stood in for.
SHAPES = {
    "articles": "Handle string, title string, abstract string, year int, is_series boolean, archive string, journal_code string, journal string, category string, url string, authors string, bib_tex string, doi string, embeddings array<float>",
    "journals": "archive string, journal_code string, long_name string, category string, series_handle string",
    "cit_all": "citing string, cited string",
    "cit_internal": "citing string, cited string",
    "version_links": "source string, target string, type string",
    "persons": "short_id string, name_first string, name_last string, name_full string, workplace_name string, homepage string",
    "person_works": "short_id string, work_handle string, work_type string",
    "handle_stats": "handle string, year int, total_citations long, internal_citations long, total_references long, internal_references long, citation_percentile double",
    "person_stats": "short_id string, n_works_total long, n_works_in_corpus long, total_citations long, a_count long, first_year int, last_year int, primary_category string",
    "article_jel": "handle string, jel_code string",
    "jel_codes": "code string, label string, level int, parent string",
    "person_wikidata": "short_id string, image_url string, wikipedia_url string, orcid string, birth_year int, birth_place string",
}
MAX_K, MAX_PAPERS = 1000, 5000


class Corpus:
    """Verbs over the tables of a corpus."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark, self.tables = spark, dict(tables)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str]) -> Corpus:
        """Tables <folder>/<name>.parquet."""
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def has(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str) -> DataFrame:
        """A table, or an empty one of its shape if the corpus has none."""
        if name in self.tables:
            return self.tables[name]
        if name not in SHAPES:
            raise KeyError(name)
        return self.spark.createDataFrame([], SHAPES[name])

    def articles(self, *cols: str) -> DataFrame:
        """(handle, *cols), an article once."""
        a = self.table("articles").select(T.handle_lc(F.col("Handle")).alias("handle"), *cols)
        return a.repartition("handle").distinct()

    def edges(self) -> DataFrame:
        name = "cit_all" if self.has("cit_all") else "cit_internal"
        return self.table(name).select(T.handle_lc(F.col("citing")).alias("citing"), T.handle_lc(F.col("cited")).alias("cited"))

    def works(self) -> DataFrame:
        return self.table("person_works").select(T.handle_lc(F.col("short_id")).alias("short_id"), T.handle_lc(F.col("work_handle")).alias("work_handle"), "work_type").distinct()

    def _filters(self, a: DataFrame, filters: Column | None, jel: list[str] | None, strict: bool) -> DataFrame:
        a = a if filters is None else a.where(filters)
        return a if not jel else taxonomy.with_codes(a, self.table("article_jel").select(T.handle_lc(F.col("handle")).alias("handle"), F.upper("jel_code").alias("code")), jel, strict)

    def _papers(self, hits: DataFrame) -> DataFrame:
        """Result rows with the columns of a paper and, if known, the metrics of its work."""
        cols = [c for c in enrich.PAPER if c != "handle" and c in self.table("articles").columns]
        a = self.table("articles").select(T.handle_lc(F.col("Handle")).alias("handle"), *cols).join(F.broadcast(hits.select("handle")), "handle", "left_semi")  # a page of hits
        a = first_by(a, ["handle"], *[F.col(c) for c in cols])
        full = enrich.papers_with_metrics(a, self.tables.get("article_openalex"))
        return hits.join(full, "handle")

    # ------------------------------------------------------------ search

    def semantic_search(self, query: list[float], k: int | None = None, filters: Column | None = None, jel: list[str] | None = None) -> DataFrame:
        """The k nearest papers; filters and codes act before the ranking. Codes that are malformed are dropped."""
        a = self._filters(self.table("articles").withColumn("handle", T.handle_lc(F.col("Handle"))), filters, jel, False)
        return self._papers(search.rounded(search.semantic_search(a, query, search.clamp(k, 1, MAX_K))))

    def semantic_pool(self, query: list[float], k: int = 20, filters: Column | None = None, jel: list[str] | None = None) -> DataFrame:
        """The k nearest papers of a pool of the max(15 k, 300) nearest: filters and codes act on the pool, so fewer may come out. Only malformed codes are an error."""
        k = search.clamp(k, 1, MAX_K)
        a = self.table("articles").withColumn("handle", T.handle_lc(F.col("Handle")))
        near = search.semantic_search(a, query, max(15 * k, 300))
        kept = self._filters(a.join(F.broadcast(near.select("handle")), "handle", "left_semi"), filters, jel, True).select("handle").distinct()
        return self._papers(near.join(kept, "handle", "left_semi").orderBy(F.desc("similarity"), "handle").limit(k))

    def keyword_search(self, words: list[str], fields: tuple[str, ...] = ("title",), match: str = "any", filters: Column | None = None, limit: int | None = None, offset: int = 0, by_citations: bool = False) -> tuple[DataFrame, DataFrame]:
        """(page of papers, one row with the total): the total counts every hit, whatever the page."""
        cols = sorted({"title", "year", *fields, *(["category", "journal", "authors"] if filters is not None else [])})
        a = self.articles(*cols)
        order = None
        if by_citations:
            n = self.edges().groupBy(F.col("cited").alias("handle")).agg(F.count("*").alias("citations"))
            a = a.join(n, "handle", "left").fillna(0, ["citations"])
            order = [F.desc("citations"), F.desc_nulls_last("year"), F.col("handle")]
        return search.keyword_page(a, words, limit, offset, order, fields=fields, match=match, filters=filters)

    def verify(self, entries: DataFrame) -> DataFrame:
        """(entry_id, status, handle, year_mismatch, journal_mismatch): every entry, found or not."""
        hit = search.verify_references(entries, self.articles("title", "year", "authors", "journal"))
        names = F.create_map(F.lit(1), F.lit("handle_match"), F.lit(2), F.lit("fuzzy_match"), F.lit(3), F.lit("loose_match"))
        out = entries.select("entry_id").distinct().join(hit, "entry_id", "left")
        return out.select("entry_id", F.coalesce(names[F.col("tier")], F.lit("not_found")).alias("status"), "handle", "year_mismatch", "journal_mismatch")

    # ------------------------------------------------------------ papers

    def cites(self, handle: str, limit: int | None = None) -> DataFrame:
        """What a paper cites, newest first; works outside the corpus have no title."""
        e = self.edges().where(F.col("citing") == handle.strip().lower()).select("cited").distinct()
        out = graph.with_article(e, "cited", self.articles("title", "year")).withColumnRenamed("cited", "handle")
        return out.orderBy(*search.by_year(out)).limit(search.clamp(limit))

    def citedby(self, handle: str, limit: int | None = None) -> DataFrame:
        """Papers of the corpus that cite a work, newest first."""
        e = self.edges().where(F.col("cited") == handle.strip().lower()).select("citing").distinct()
        out = graph.with_article(e, "citing", self.articles("title", "year"), "inner").withColumnRenamed("citing", "handle")
        return out.orderBy(*search.by_year(out)).limit(search.clamp(limit))

    def versions(self, handle: str, both: bool = True) -> DataFrame:
        links = self.table("version_links").select(T.handle_lc(F.col("source")).alias("source"), T.handle_lc(F.col("target")).alias("target"), "type")
        h = handle.strip().lower()
        return graph.versions_of(links.where((F.col("source") == h) | (F.col("target") == h)), both).where(F.col("handle") == h).distinct()

    def handle_stats(self, handle: str) -> DataFrame:
        return enrich.lookup(self.table("handle_stats"), handle)

    def overview(self, handle: str) -> DataFrame:
        """One row with all that is known of a paper, if it exists."""
        h = handle.strip().lower()
        cols = [c for c in enrich.PAPER if c != "handle" and c in self.table("articles").columns]
        paper = first_by(self.table("articles").where(T.handle_lc(F.col("Handle")) == h).select(F.lit(h).alias("handle"), *cols), ["handle"], *[F.col(c) for c in cols])
        metrics = self.tables.get("article_openalex")
        return enrich.overview(paper, self.handle_stats(h), self.versions(h), None if metrics is None else enrich.lookup(metrics, h))

    def bib_for(self, handles: list[str]) -> DataFrame:
        want = self.spark.createDataFrame([(h,) for h in handles], "handle string")
        return enrich.bib_for(self.articles("bib_tex"), want)

    def journals(self) -> DataFrame:
        """(journal, n), the largest first."""
        return self.articles("journal").where("journal is not null").groupBy("journal").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "journal")

    def categories(self) -> DataFrame:
        return self.articles("category").where("category is not null").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")

    def codes(self, text: str) -> DataFrame:
        """Classification nodes that match a text, with their ancestors."""
        return taxonomy.closure(self.table("jel_codes"), text).orderBy("code")

    # ------------------------------------------------------------ persons

    def person_search(self, query: list[float], mode: str = "breadth", k: int = 25, papers: int = 600, offset: int = 0, filters: Column | None = None, pool: bool = False, **limits: object) -> DataFrame:
        """The persons whose works match best. With ``pool`` the filters act on the max(3 papers, 1500) nearest works only."""
        papers = search.clamp(papers, 1, MAX_PAPERS)
        a = self.table("articles").withColumn("handle", T.handle_lc(F.col("Handle")))
        hits = search.semantic_search(a, query, papers, filters, max(3 * papers, 1500) if pool else None)
        hits = a.select("handle", "title").join(F.broadcast(hits), "handle").distinct()  # at most MAX_PAPERS rows
        people = self.table("persons").select(T.handle_lc(F.col("short_id")).alias("short_id"), "name_full", "workplace_name", "homepage")
        people = first_by(people, ["short_id"], F.col("name_full"), F.col("workplace_name"), F.col("homepage"))
        return persons.person_search(hits, self.works(), self.table("person_stats"), mode, k=search.clamp(k, 1, MAX_K), offset=offset, people=people, wikidata=self.table("person_wikidata"), **limits)

    def person_lookup(self, name: str, limit: int | None = None) -> DataFrame:
        people = self.table("persons").select(T.handle_lc(F.col("short_id")).alias("short_id"), "name_full", "workplace_name").distinct()
        return people.where(search.contains_ci(F.col("name_full"), name.strip())).orderBy("name_full", "short_id").limit(search.clamp(limit))

    def person_profile(self, short_id: str) -> dict[str, DataFrame]:
        """The person with statistics, works by category, the five main journals, and series edited."""
        s = short_id.strip().lower()
        mine = self.works().where(F.col("short_id") == s)
        a = self.articles("category", "journal")
        person = self.table("persons").where(T.handle_lc(F.col("short_id")) == s).dropDuplicates(["short_id"])
        roles = mine.where(F.col("work_type").startswith("editor")).join(self.table("journals").select(F.col("series_handle").alias("work_handle"), "long_name", "category"), "work_handle")
        return {
            "person": person.drop("short_id").join(self.table("person_stats").where(F.lower("short_id") == s), how="left"),
            "categories": persons.profile_counts(mine, a, "category").orderBy(F.desc("n"), F.col("category").asc_nulls_last()),
            "journals": persons.top_per_key(persons.profile_counts(mine, a, "journal"), "short_id", "journal", "n", 5).orderBy("rank"),
            "roles": roles.select("work_handle", "work_type", "long_name", "category").distinct(),
        }

    def person_papers(self, short_id: str, sort: str = "year", descending: bool = True, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """(papers of the corpus, works outside it): sorted by year, citations or journal, NULLs last."""
        if sort not in ("year", "citations", "journal"):
            raise ValueError(f"unknown order {sort}")
        mine = self.works().where(F.col("short_id") == short_id.strip().lower())
        n = self.edges().groupBy(F.col("cited").alias("handle")).agg(F.count("*").alias("citations"))
        inside = mine.select(F.col("work_handle").alias("handle")).distinct().join(self.articles("title", "year", "journal"), "handle").join(n, "handle", "left").fillna(0, ["citations"])
        order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
        out = mine.join(self.articles().withColumnRenamed("handle", "work_handle"), "work_handle", "left_anti").where("work_handle is not null")
        return inside.orderBy(order, "handle").offset(max(offset, 0)).limit(search.clamp(limit)), out.select("work_handle", "work_type", T.address(F.col("work_handle"), F.col("work_type")).alias("address"))

    # ------------------------------------------------------------ SQL

    def sql(self, query: str, tables: list[str] | None = None, args: list | None = None) -> DataFrame:
        """A guarded query over the corpus' tables."""
        names = tables if tables is not None else list(self.tables)
        return guarded_sql(self.spark, query, {n: self.table(n) for n in names}, args=args)
