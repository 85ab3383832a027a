"""Metrics beside result rows: lookups, overviews, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblyst.operators.match import first_by
from biblyst.session import small

# Metrics of a work that travel with an article.
METRICS = ["openalex_id", "oa_cited_by_count", "fwci", "is_retracted", "is_oa", "oa_url", "oa_status", "primary_topic", "primary_field"]
# Columns of a paper in a result.
PAPER = ["handle", "title", "year", "authors", "journal", "category", "url", "abstract", "doi", "bib_tex"]


def papers_with_metrics(articles: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """The ten columns of a paper and, if there is a table of metrics, its nine; exactly one row per article row.

    A handle that stands twice among the metrics counts once, so rows never
    multiply. Without a match, or without the table, all nine are NULL.
    """
    a = articles.select(*[c for c in PAPER if c in articles.columns])
    if metrics is None:
        return a.withColumns({c: F.lit(None).cast(METRIC_TYPES[c]) for c in METRICS})
    m = metrics.select(F.lower("handle").alias("_h"), *METRICS)
    m = first_by(m, ["_h"], *[F.col(c) for c in METRICS])
    return a.withColumn("_h", F.lower("handle")).join(m, "_h", "left").drop("_h")


METRIC_TYPES = {"openalex_id": "string", "oa_cited_by_count": "long", "fwci": "double", "is_retracted": "boolean", "is_oa": "boolean", "oa_url": "string", "oa_status": "string", "primary_topic": "string", "primary_field": "string"}


def as_record(rows: DataFrame) -> DataFrame:
    """The nine metrics as one struct ``openalex``, NULL where there is no work; text fields NULL become ''."""
    block = F.when(F.col("openalex_id").isNotNull(), F.struct(*METRICS)).alias("openalex")
    rest = [c for c in rows.columns if c not in METRICS]
    text = ("title", "authors", "journal", "category", "url")
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in rest], block)


def lookup(table: DataFrame | None, handle: str, key: str = "handle") -> DataFrame | None:
    """Rows of one handle in any case; None if the table does not exist."""
    return None if table is None else table.where(F.lower(key) == handle.strip().lower())


def overview(papers: DataFrame, stats: DataFrame, versions: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """(handle, paper, stats, versions, openalex): all that is known of each paper, one row per paper.

    ``versions``: (handle, other, type). Parts that are missing are NULL, no
    versions an empty list.
    """
    p = papers.select("handle", F.struct(*[c for c in papers.columns if c != "handle"]).alias("paper"))
    s = stats.select("handle", F.struct(*[c for c in stats.columns if c != "handle"]).alias("stats"))
    v = versions.groupBy("handle").agg(F.sort_array(F.collect_set(F.struct("other", "type"))).alias("versions"))
    out = p.join(s, "handle", "left").join(v, "handle", "left").withColumn("versions", F.coalesce("versions", F.array().cast(v.schema["versions"].dataType)))
    if metrics is None:
        return out.withColumn("openalex", F.lit(None).cast("string"))
    m = first_by(metrics.select(F.lower("handle").alias("handle"), *METRICS), ["handle"], *[F.col(c) for c in METRICS])
    return out.join(m.select("handle", F.struct(*METRICS).alias("openalex")), "handle", "left")


def badges(stats: DataFrame) -> DataFrame:
    """(handle, percentile, fwci, covered): how statistics are shown; without an impact, fwci is NULL.

    The percentile in whole hundredths, the field-weighted impact with two
    decimals; covered if there are internal citations, years or references, or
    a work of the catalogue.
    """
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    covered = some("internal_citations") | some("years_since_pub") | some("total_references") | F.col("openalex_id").isNotNull()
    return stats.select("handle", F.round(F.col("citation_percentile") * 100).cast("int").alias("percentile"), F.when(F.col("fwci").isNotNull(), F.format_string("%.2f", F.col("fwci"))).alias("fwci"), covered.alias("covered"))


def bars(by_year: DataFrame) -> DataFrame:
    """(handle, year, n, height): yearly counts with their share of the highest of the handle."""
    top = by_year.groupBy("handle").agg(F.max("n").alias("_m"))
    return by_year.join(top, "handle").select("handle", "year", "n", F.when(F.col("_m") > 0, F.col("n") / F.col("_m")).otherwise(F.lit(0.0)).alias("height"))


def unboxed(rows: DataFrame, boxed: list[str], json: dict[str, str]) -> DataFrame:
    """First elements of one-element lists, and JSON columns parsed by the schemas given; broken JSON is NULL."""
    new: dict[str, Column] = {c: F.get(c, F.lit(0)) for c in boxed}
    for c, schema in json.items():
        ok = F.try_parse_json(c)
        new[c] = F.when(ok.isNotNull(), F.from_json(c, schema))
    return rows.withColumns(new)


def bib_for(articles: DataFrame, handles: DataFrame) -> DataFrame:
    """(handle, bib_tex) of a list of handles in any case, each once; those without an entry are left out."""
    want = handles.select(F.lower(F.trim("handle")).alias("handle")).distinct()
    hit = articles.where("bib_tex is not null and bib_tex <> ''").select("handle", "bib_tex").join(small(want), "handle", "left_semi")
    return hit.groupBy("handle").agg(F.min("bib_tex").alias("bib_tex"))
