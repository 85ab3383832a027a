"""Finding identifiers for articles: candidate guards, attempt ledgers, one patch from every source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblyst.functions.text import doi_from_url, first_author_token, guess_from_article_url, normalize_doi, safe_article_id
from biblyst.operators.match import first_by

# Sources of identifiers, the most trusted first.
PRIORITY = ["redif", "url", "nature_transform", "openalex", "crossref_container", "crossref"]
#: Of these, the ones that may replace an identifier; the others only fill gaps.
AUTHORITATIVE = 2
# Kinds of records that agree with an article and with a series paper.
ARTICLE_TYPES = ["journal-article"]
SERIES_TYPES = ["report", "posted-content"]


def from_urls(articles: DataFrame) -> DataFrame:
    """(handle, doi, doi_source): identifiers inside the URLs of articles, one per handle."""
    hit = articles.where(F.col("url").contains("10.")).select("handle", doi_from_url(F.col("url")).alias("doi")).where("doi is not null")
    return first_by(hit, ["handle"], F.col("doi")).withColumn("doi_source", F.lit("url"))


def from_article_pages(articles: DataFrame, host: str, prefix: str, portfolio: list[str]) -> DataFrame:
    """(handle, doi, doi_source): identifiers spelled by article pages of a host, in shapes that are always registered."""
    todo = articles.where("doi is null").select("handle", guess_from_article_url(F.col("url"), host, prefix).alias("doi"))
    return first_by(todo.where(F.col("doi").isNotNull() & safe_article_id(F.col("doi"), portfolio)), ["handle"], F.col("doi")).withColumn("doi_source", F.lit("nature_transform"))


def guard_candidates(queries: DataFrame, candidates: DataFrame, least_score: float = 85) -> DataFrame:
    """(handle, doi, c_title, c_year, c_type, score): the first candidate per query that passes all guards.

    queries: (handle, authors, year, is_series); candidates: (handle, rank,
    doi, c_title, c_year, c_type, c_authors, score), ranked by the remote
    search. Guards: score, type in accord with is_series, years at most one
    apart, last word of the first author among the candidate's authors. A first
    survivor without a usable identifier gives no row; NULLs fail their guard.
    """
    q = queries.select("handle", "year", "is_series", first_author_token(F.col("authors")).alias("_author"))
    c = candidates.join(q, "handle")
    kind = F.when(F.col("is_series"), F.col("c_type").isin(SERIES_TYPES)).otherwise(F.col("c_type").isin(ARTICLE_TYPES))
    ok = (F.col("score") >= least_score) & kind & (F.abs(F.col("c_year") - F.col("year")) <= 1) & F.lower("c_authors").contains(F.col("_author"))
    best = first_by(c.where(ok), ["handle"], F.col("rank"), F.col("doi"))
    return best.select("handle", normalize_doi(F.col("doi")).alias("doi"), "c_title", "c_year", "c_type", "score").where("doi is not null")


def pick_in_container(scored: DataFrame, types: list[str], least: float = 0.5, year_slack: int = 1) -> DataFrame:
    """One row per handle: the candidate of highest sim among those with identifier, type and year in order; the first of equal ones."""
    ok = F.col("doi").isNotNull() & F.col("c_type").isin(types) & (F.abs(F.col("c_year") - F.col("year")) <= year_slack) & (F.col("sim") >= least)
    return first_by(scored.where(ok), ["handle"], F.desc("sim"), F.col("rank"))


def work_queue(articles: DataFrame, ledger: DataFrame, limit: int | None = None, series: bool = False) -> DataFrame:
    """Articles without identifier but with title, year and journal that the ledger has not tried, by handle."""
    todo = articles.where("doi is null and title is not null and year is not null and journal is not null")
    todo = todo if series else todo.where(~F.col("is_series"))
    todo = todo.join(ledger.select("handle").distinct(), "handle", "left_anti")
    return todo if limit is None else todo.orderBy("handle").limit(limit)


def chunked(todo: DataFrame, size: int, order: str = "handle") -> DataFrame:
    """``todo`` with the number of its chunk of ``size`` rows in the order given, without gathering the rows.

    Rows are range-partitioned, counted per partition, and numbered within it.
    """
    from biblyst.session import materialize

    parts = materialize(todo.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "queue")
    n = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per partition
    before = n.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_p").orderBy(order)) + F.col("_before")
    return parts.join(F.broadcast(before), "_p").withColumn("chunk", F.ceil(row / size).cast("long")).drop("_p", "_before")


def attempt(todo: DataFrame, ledger_path: str, evaluate: Callable[[DataFrame], DataFrame], size: int = 400) -> int:
    """Run ``evaluate`` over the queue chunk by chunk, appending its rows (handle, doi, ...) to the ledger.

    Every chunk is committed on its own, so a run that dies loses at most one;
    the next one leaves out all handles of the ledger. Returns the chunks run.
    """
    spark = todo.sparkSession
    rows = chunked(todo, size)
    last = rows.agg(F.max("chunk")).first()[0] or 0
    for k in range(1, last + 1):
        evaluate(rows.where(F.col("chunk") == k).drop("chunk")).withColumn("attempted_chunk", F.lit(k)).write.mode("append").parquet(ledger_path)
    spark.catalog.refreshByPath(ledger_path) if last else None
    return int(last)


def ledger_hits(ledger: DataFrame, source: str) -> DataFrame:
    """(handle, doi, doi_source): usable identifiers of a ledger, one per handle."""
    hits = ledger.select("handle", normalize_doi(F.col("doi")).alias("doi")).where("doi is not null")
    return first_by(hits, ["handle"], F.col("doi")).withColumn("doi_source", F.lit(source))


def finalize(current: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(handle, doi, doi_source): what a patch of identifiers has to change.

    ``parts``: (handle, doi) by source. The most trusted source wins a handle.
    Authoritative sources may replace an identifier, the others count only for
    articles without one. Handles outside ``current`` and rows that would
    change nothing are left out.
    """
    known = [s for s in PRIORITY if s in parts]
    unknown = set(parts) - set(known)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}")
    if not known:
        return current.select("handle", "doi", F.lit(None).cast("string").alias("doi_source")).limit(0)
    without = current.where("doi is null").select("handle").distinct()
    rows = None
    for n, s in enumerate(PRIORITY):
        if s not in parts:
            continue
        p = parts[s].select("handle", "doi").where("doi is not null")
        p = p if n < AUTHORITATIVE else p.join(without, "handle", "left_semi")
        p = p.select("handle", "doi", F.lit(s).alias("doi_source"), F.lit(n).alias("_n"))
        rows = p if rows is None else rows.unionByName(p)
    best = first_by(rows, ["handle"], F.col("_n"), F.col("doi")).drop("_n")
    best = best.join(current.select("handle").distinct(), "handle", "left_semi")
    return best.join(current.where("doi is not null").select("handle", "doi").distinct(), ["handle", "doi"], "left_anti")


def host_filter(url: Column, hosts: list[str]) -> Column:
    """Whether a URL holds one of the hosts, without regard to case; NULL holds none."""
    hit = F.lit(False)
    for h in hosts:
        hit = hit | F.lower(url).contains(h.lower())
    return F.coalesce(hit, F.lit(False))
