"""Author roll-ups, profiles and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biblyst.operators.graph import mode


def person_stats(persons: DataFrame, works: DataFrame, articles: DataFrame, stats: DataFrame, top_category: str) -> DataFrame:
    """Works, citations, years and main category per person; a work under two roles counts twice."""
    total = works.groupBy("short_id").agg(F.count("*").alias("n_works_total"))
    inside = works.join(articles.select(F.col("handle").alias("work_handle"), "year", "category"), "work_handle")
    inside = inside.join(stats.select(F.col("handle").alias("work_handle"), "total_citations"), "work_handle", "left")
    agg = inside.groupBy("short_id").agg(
        F.count("*").alias("n_works_in_corpus"),
        F.coalesce(F.sum("total_citations"), F.lit(0)).alias("total_citations"),
        F.count(F.when(F.col("category") == top_category, 1)).alias("a_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    main = mode(inside, ["short_id"], "category", "primary_category", nulls=True)
    out = persons.select("short_id").distinct().join(total, "short_id", "left").join(agg, "short_id", "left").join(main, "short_id", "left")
    return out.fillna(0, ["n_works_total", "n_works_in_corpus", "total_citations", "a_count"])


def person_search(hits: DataFrame, works: DataFrame, stats: DataFrame, mode_: str, weight: float = 0.3, k: int = 25, min_citations: int | None = None, min_last_year: int | None = None, institution: str | None = None, offset: int = 0, people: DataFrame | None = None, wikidata: DataFrame | None = None) -> DataFrame:
    """The k persons whose works match best.

    ``hits``: (handle, title, similarity), a bounded list. A title counts once
    per person. Modes: breadth sums similarities, best_match takes the highest,
    blended means both; each is raised by the person's citations. Filters (the
    institution by equality without case, via ``people``) act before the maxima
    are taken. With ``people`` (short_id, ...) its columns come along, and only
    persons in it; those of ``wikidata`` come along where there are any.
    """
    rows = hits.join(works.select("short_id", F.col("work_handle").alias("handle")).distinct(), "handle")
    same = Window.partitionBy("short_id", F.lower(F.trim(F.coalesce("title", "handle")))).orderBy(F.desc("similarity"), "handle")
    rows = rows.withColumn("_r", F.row_number().over(same)).where("_r = 1")
    best5 = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("similarity"), F.col("handle")))), 1, 5)
    rolled = rows.groupBy("short_id").agg(F.sum("similarity").alias("overlap"), F.count("*").alias("n_hits"), F.max("similarity").alias("best"), best5.alias("e"))
    rolled = rolled.join(stats.select("short_id", "total_citations", "last_year"), "short_id", "left")
    # filters act before the maxima are taken; unknown values fail them
    if min_citations is not None:
        rolled = rolled.where(F.col("total_citations") >= min_citations)
    if min_last_year is not None:
        rolled = rolled.where(F.col("last_year") >= min_last_year)
    if institution is not None or people is not None:
        if people is None:
            raise ValueError("an institution needs the table of people")
        rolled = rolled.join(people, "short_id")
    if institution is not None:
        rolled = rolled.where(F.lower(F.trim("workplace_name")) == institution.strip().lower())
    cit = F.log1p(F.coalesce("total_citations", F.lit(0)).cast("double"))
    top = rolled.agg(F.max(cit).alias("_mc"), F.max("overlap").alias("_mo"))
    x = rolled.join(F.broadcast(top))  # one row
    quality = 1 + weight * F.when(F.col("_mc") > 0, cit / F.col("_mc")).otherwise(F.lit(0.0))
    scores = {"breadth": F.col("overlap") * quality, "best_match": F.col("best") * quality, "blended": (0.5 * F.col("overlap") / F.col("_mo") + 0.5 * F.col("best")) * quality}
    x = x.withColumn("score", F.round(scores[mode_], 6))
    more = [c for c in people.columns if c != "short_id"] if people is not None else []
    out = x.orderBy(F.desc("score"), "short_id").offset(offset).limit(k).select("short_id", "score", "n_hits", F.round("best", 6).alias("best"), F.array_join(F.col("e.handle"), "|").alias("evidence"), *more)
    return out if wikidata is None else out.join(wikidata, "short_id", "left").orderBy(F.desc("score"), "short_id")


def profile_counts(works: DataFrame, articles: DataFrame, by: str) -> DataFrame:
    """(short_id, by, n) over works in the corpus."""
    return works.join(articles.select(F.col("handle").alias("work_handle"), by), "work_handle").groupBy("short_id", by).agg(F.count("*").alias("n"))


def top_per_key(df: DataFrame, key: str, value: str, n: str, k: int) -> DataFrame:
    """The k largest rows per key, ties by value."""
    w = Window.partitionBy(key).orderBy(F.desc(n), F.col(value).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
