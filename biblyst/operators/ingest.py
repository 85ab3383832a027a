"""From parsed records to corpus tables: cleaning, increments, links, codes, journal quality, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblyst.functions.text import fill_bibtex_journal, journal_name, normalize_doi, parse_year
from biblyst.operators.match import first_by
from biblyst.session import small


def load_cleaned(records: DataFrame, journals: DataFrame, files: DataFrame | None, forthcoming: int, *priority: Column) -> DataFrame:
    """The articles table from parsed records.

    The first record of a handle counts, in the order of ``priority`` (a total
    order; sources come first there). Years are read from text; series papers
    count from 2010, others from 1995, and abstracts must be longer than 100
    characters; NULLs fail these tests. Journals give name and category, which
    also fill an empty journal in bib_tex. ``files`` (Handle, position, url)
    gives the first URL, NULL without one.
    """
    one = first_by(records, ["Handle"], *priority)
    doi = normalize_doi(F.col("doi")) if "doi" in records.columns else F.lit(None).cast("string")
    year = parse_year(F.col("year").cast("string"), forthcoming)
    rows = one.withColumns({"doi": doi, "year": year}).withColumn("doi_source", F.when(F.col("doi").isNotNull(), "redif"))
    rows = rows.where("((year >= 1995 and not is_series) or (year >= 2010 and is_series)) and length(abstract) > 100")
    j = journals.select("archive", "journal_code", F.col("long_name").alias("journal"), "category")
    rows = rows.drop("journal", "category").join(small(j), ["archive", "journal_code"], "left")
    if "bib_tex" in rows.columns:
        rows = rows.withColumn("bib_tex", fill_bibtex_journal(F.col("bib_tex"), F.coalesce("journal", F.lit("NA"))))
    if files is None:
        return rows
    urls = files.where("url is not null").groupBy("Handle").agg(F.min_by("url", F.struct("position", "url")).alias("url"))
    return rows.drop("url").join(urls, "Handle", "left")


def unprocessed(records: DataFrame, done: DataFrame, key: str = "Handle") -> DataFrame:
    """Records whose key is not in ``done``; records without a key are left out."""
    return records.where(F.col(key).isNotNull()).join(done.select(key).distinct(), key, "left_anti")


def version_links(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(source, target, type) whose both ends are articles, in the spelling of the articles table.

    ``links`` may spell handles in any case, ``articles`` has Handle; an article
    in several spellings comes out in the smallest.
    """
    known = articles.select(F.lower("Handle").alias("k"), "Handle").where("k is not null").groupBy("k").agg(F.min("Handle").alias("Handle"))
    out = links.select(F.lower("source").alias("s"), F.lower("target").alias("t"), "type")
    out = out.join(known.toDF("s", "source"), "s").join(known.toDF("t", "target"), "t")
    return out.select("source", "target", "type")


def jel_table(records: DataFrame, articles: DataFrame, codes: str = "jel") -> DataFrame:
    """(handle, jel_code): well-formed codes of the corpus, each once. ``records``: (Handle, codes separated by blanks, or an array)."""
    kind = records.schema[codes].dataType.typeName()
    each = F.explode(codes) if kind == "array" else F.explode(F.split(F.col(codes), r"\s+"))
    out = records.select(F.lower("Handle").alias("handle"), each.alias("c")).select("handle", F.upper(F.trim("c")).alias("jel_code"))
    out = out.where(F.col("jel_code").rlike(r"^[A-Z]\d{0,2}$")).distinct()
    return out.join(articles.select(F.lower("Handle").alias("handle")).distinct(), "handle", "left_semi")


def journal_quality(factors: DataFrame, recent: DataFrame | None, fetched_at: Column) -> DataFrame:
    """Series factors with the ten-year ones beside them; without a ten-year file those are NULL."""
    new = {"simple_if_10y": "double", "recursive_if_10y": "double", "h_index_10y": "int"}
    if recent is None:
        out = factors.withColumns({c: F.lit(None).cast(t) for c, t in new.items()})
    else:
        ten = recent.select("series_handle", *[F.col(c.removesuffix("_10y")).cast(t).alias(c) for c, t in new.items()])
        out = factors.join(ten, "series_handle", "left")
    return out.withColumn("fetched_at", fetched_at)


def source_names(sources: DataFrame) -> DataFrame:
    """(id, name, works, n): normalised names of sources (id, display_name, alternate_titles, works_count), the alternates as well."""
    cols = ["id", F.col("display_name").alias("name"), F.col("works_count").alias("works")]
    own = sources.select(*cols, journal_name(F.col("display_name")).alias("n"))
    other = sources.where("alternate_titles is not null").select(*cols, F.explode("alternate_titles").alias("a")).select("id", "name", "works", journal_name(F.col("a")).alias("n"))
    return own.unionByName(other)


def resolve_by_names(journals: DataFrame, sources: DataFrame) -> DataFrame:
    """(journal, src_id, oa_name, works_count, via): the source of an equal name or alternate name, the largest of several."""
    j = journals.where("journal is not null").select("journal").distinct().withColumn("n", journal_name(F.col("journal")))
    m = j.join(source_names(sources), "n", "left")
    best = first_by(m, ["journal"], F.desc_nulls_last("works"), F.col("id").asc_nulls_last())
    return best.select("journal", F.col("id").alias("src_id"), F.col("name").alias("oa_name"), F.col("works").alias("works_count"), F.when(F.col("id").isNotNull(), "name/alt").alias("via"))


def stale(persons: DataFrame, fetched: DataFrame, cutoff: Column, index: DataFrame | None = None) -> DataFrame:
    """(short_id): persons never fetched or fetched before the cutoff; with an index only those in it."""
    out = persons.select("short_id").distinct().join(fetched.select("short_id", "fetched_date"), "short_id", "left")
    out = out.where(F.col("fetched_date").isNull() | (F.col("fetched_date") < cutoff)).select("short_id").distinct()
    return out if index is None else out.intersect(index.select("short_id"))


def union_quarters(parts: list[DataFrame], key: str, *order: Column) -> DataFrame:
    """All rows ever pulled, nothing deleted: the freshest row per key over all pulls; columns that a pull lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_by(out.where(F.col(key).isNotNull()), [key], *order)


def fixture_slice(articles: DataFrame, works: DataFrame, short_ids: list[str], handles: DataFrame, per_category: int = 120) -> DataFrame:
    """(handle): a small coherent part of the corpus: given handles, works of given persons, the newest of each category."""
    of = works.where(F.col("short_id").isin(short_ids)).select(F.col("work_handle").alias("handle")).join(articles.select("handle"), "handle", "left_semi")
    new = top_of_category(articles, per_category).select("handle")
    return handles.select("handle").join(articles.select("handle"), "handle", "left_semi").union(of).union(new).distinct()


def top_of_category(articles: DataFrame, k: int) -> DataFrame:
    """The k newest articles of each category, by handle within a year; without category none."""
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy(F.desc_nulls_last("year"), F.col("handle"))
    return articles.where("category is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def plan_chunks(files: DataFrame, most: int = 60) -> DataFrame:
    """(path, chunk) of (path): part files grouped by their updated_date folder, at most ``most`` files a chunk; a split day is named day-b1, day-b2."""
    from pyspark.sql import Window

    day = F.regexp_extract("path", r"updated_date=(\d{4}-\d{2}-\d{2})", 1)
    f = files.select("path", day.alias("day")).where("day <> ''")
    n = f.withColumn("b", F.ceil(F.row_number().over(Window.partitionBy("day").orderBy("path")) / most)).withColumn("c", F.count("*").over(Window.partitionBy("day")))
    return n.select("path", F.when(F.col("c") > most, F.concat("day", F.lit("-b"), F.col("b").cast("string"))).otherwise(F.col("day")).alias("chunk"))


def embed_missing(records: DataFrame, text: str, embed: object, dim: int, ladder: tuple[int, ...] = (1_000_000, 2000, 800, 300)) -> DataFrame:
    """``records`` with embeddings of their text; those no attempt succeeds on are left out.

    ``embed`` maps a list of texts to a list of vectors and may raise. A batch
    is tried at once; if that fails, each text alone, cut shorter step by step.
    NULL texts are read as empty. Vectors of another length are failures.
    """
    from collections.abc import Iterator

    import pandas as pd

    def one(t: str) -> list[float] | None:
        for n in ladder:
            try:
                v = embed([t[:n]])[0]
                if len(v) == dim:
                    return [float(x) for x in v]
            except Exception:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf[text]]
            try:
                out = [[float(x) for x in v] for v in embed(texts)]
                if len(out) != len(texts) or any(len(v) != dim for v in out):
                    raise ValueError("vectors of another shape")
            except Exception:
                out = [one(t) for t in texts]
            yield pdf.assign(embeddings=out)[[v is not None for v in out]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name != "embeddings")
    return records.drop("embeddings").mapInPandas(run, f"{schema}, embeddings array<float>")
