"""Vector and keyword search with composable filters, and reference verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblyst.functions.text import first_author_lastname, title_keyword
from biblyst.functions.vector import cosine_distance, usable
from biblyst.session import materialize


def contains_ci(c: Column, text: str) -> Column:
    """Literal substring without regard to case: no wildcards, so nothing to escape."""
    return F.lower(c).contains(text.lower())


def paper_filters(min_year: int | None = None, max_year: int | None = None, categories: list[str] | None = None, journals: list[str] | None = None, title: str | None = None, author: str | None = None) -> Column:
    """Conjunction of the filters given; NULL values fail the filters on them."""
    parts = [F.lit(True)]
    if min_year is not None:
        parts.append(F.col("year") >= min_year)
    if max_year is not None:
        parts.append(F.col("year") <= max_year)
    if categories:
        parts.append(F.col("category").isin(categories))
    if journals:
        parts.append(reduce(lambda a, b: a | b, [contains_ci(F.col("journal"), j) for j in journals]))
    if title:
        parts.append(contains_ci(F.col("title"), title))
    if author:
        parts.append(contains_ci(F.col("authors"), author))
    return reduce(lambda a, b: a & b, parts)


def semantic_search(articles: DataFrame, query: list[float], k: int, filters: Column | None = None, pool: int | None = None) -> DataFrame:
    """The k nearest articles by cosine: (handle, similarity).

    Filters act before the ranking, at the scan; with ``pool`` they act on the
    nearest ``pool`` articles only, so fewer than k may come out. Articles that
    stand in several rows count once, with their nearest one; only handles and
    distances are shuffled for that.
    """
    near = articles.where(usable(F.col("embeddings"), len(query)))
    if pool is None and filters is not None:
        near = near.where(filters)
    near = near.select("handle", cosine_distance(F.col("embeddings"), query).alias("_d")).groupBy("handle").agg(F.min("_d").alias("_d"))
    if pool is not None:
        near = near.orderBy("_d", "handle").limit(pool)
        if filters is not None:
            # the pool is a bounded list
            near = near.join(articles.where(filters).join(F.broadcast(near.select("handle")), "handle", "left_semi").select("handle").distinct(), "handle", "left_semi")
    return near.orderBy("_d", "handle").limit(k).select("handle", (1 - F.col("_d")).alias("similarity"))


def keyword_search(articles: DataFrame, words: list[str], fields: tuple[str, ...] = ("title",), match: str = "any", filters: Column | None = None) -> DataFrame:
    """Articles whose fields hold any or all of the words; blank words are ignored, none left is an error."""
    words = [w.strip() for w in words if w.strip()]
    if not words:
        raise ValueError("no keyword given")
    each = [reduce(lambda a, b: a | b, [F.coalesce(contains_ci(F.col(f), w), F.lit(False)) for f in fields]) for w in words]
    found = reduce((lambda a, b: a | b) if match == "any" else (lambda a, b: a & b), each)
    return articles.where(found if filters is None else found & filters)


def by_year(df: DataFrame) -> list[Column]:
    return [F.desc_nulls_last("year"), F.col("handle").asc()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def _trigrams(c: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: str) -> DataFrame:
    """Inner join of ``needles`` to ``texts`` of equal ``on`` that hold the needle as a substring.

    A text holds a needle only if it holds all its trigrams, so the two meet at
    the needle's rarest one: an equi-join with a small block in place of a
    comparison of all pairs. Needles of fewer than three characters match nothing.
    """
    each = texts.select("*", F.explode(_trigrams(F.col(text))).alias("_g"))
    n = texts.select(F.explode(_trigrams(F.col(text))).alias("_g")).groupBy("_g").agg(F.count("*").alias("_n"))
    mine = needles.where(F.length(needle) >= 3).withColumn("_id", F.monotonically_increasing_id())
    mine = materialize(mine, "needles")  # the numbers must not change between the two uses
    rare = mine.select("_id", F.explode(_trigrams(F.col(needle))).alias("_g")).join(n, "_g").groupBy("_id").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    return mine.join(rare, "_id").join(each, [on, "_g"]).where(F.col(text).contains(F.col(needle))).drop("_id", "_g")


def verify_references(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """(entry_id, tier, handle, year_mismatch, journal_mismatch): entries found in the corpus.

    ``entries``: (entry_id, handle, title, year, authors, journal). Tier 1 is
    the handle; tier 2 year, first author and a title keyword; tier 3 the year
    give or take one, first author and the first two title words. The first
    author's name may stand anywhere in an article's authors. The lowest tier
    counts, then the latest year, then the smallest handle. Tiers are joins over
    all entries; NULLs in what a tier compares leave it out.
    """
    author = F.lower(first_author_lastname(F.col("authors")))
    two = F.regexp_extract(F.lower(F.trim("title")), r"^\S+\s+\S+", 0)
    e = entries.select("entry_id", F.lower(F.trim("handle")).alias("e_handle"), F.col("year").alias("e_year"), author.alias("author"), F.col("journal").alias("e_journal"), F.lower(title_keyword(F.col("title"))).alias("keyword"), two.alias("two"))
    a = articles.select("handle", F.lower("title").alias("a_title"), "year", "journal", F.lower("authors").alias("a_authors"))
    cols = ["entry_id", "tier", "handle", "e_year", "year", "e_journal", "journal"]
    one = e.join(a, e["e_handle"] == a["handle"]).withColumn("tier", F.lit(1)).select(*cols)
    held = F.col("a_authors").contains(F.col("author"))
    found2 = containing(e.withColumn("year", F.col("e_year")), a, "keyword", "a_title", "year").where(held)
    near = e.where("two <> ''").withColumn("year", F.explode(F.array(F.col("e_year") - 1, F.col("e_year"), F.col("e_year") + 1)))
    found3 = containing(near, a, "two", "a_title", "year").where(held)
    best = Window.partitionBy("entry_id").orderBy("tier", F.desc_nulls_last("year"), "handle")
    found = one.unionByName(found2.withColumn("tier", F.lit(2)).select(*cols)).unionByName(found3.withColumn("tier", F.lit(3)).select(*cols))
    found = found.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    ej, aj = F.lower("e_journal"), F.lower("journal")
    return found.select("entry_id", "tier", "handle", F.coalesce(F.abs(F.col("e_year") - F.col("year")) > 1, F.lit(False)).alias("year_mismatch"), F.coalesce(~ej.contains(aj) & ~aj.contains(ej), F.lit(False)).alias("journal_mismatch"))


def clamp(n: int | None, least: int = 1, most: int = 1000, default: int = 50) -> int:
    """A limit as a request may give it: missing ones take the default, others are moved into the range."""
    return default if n is None else max(least, min(int(n), most))


def keyword_page(articles: DataFrame, words: list[str], limit: int | None = None, offset: int = 0, order: list[Column] | None = None, **search: object) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with the total): the total counts all hits, whatever the page."""
    hit = keyword_search(articles, words, **search)
    return page(hit, order or by_year(hit), clamp(limit), max(offset, 0)), hit.agg(F.count("*").alias("total"))


def rounded(hits: DataFrame, digits: int = 5) -> DataFrame:
    """Similarities rounded for display, best first; equal ones keep the order of the exact values."""
    exact = F.col("similarity")
    return hits.withColumn("_s", exact).withColumn("similarity", F.round(exact, digits)).orderBy(F.desc("similarity"), F.desc("_s"), "handle").drop("_s")
