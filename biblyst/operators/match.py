"""Identifier and title matching between a corpus and a catalogue of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblyst.functions.text import content_key, content_tokens, doi_prefix, journal_name, title_sim
from biblyst.session import materialize


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order given. Give a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def trusted_prefixes(works: DataFrame, share: float = 0.05) -> DataFrame:
    """(source, prefix, share): DOI prefixes that hold at least ``share`` of a source's DOIs."""
    n = works.where("doi is not null and source is not null").select("source", doi_prefix(F.col("doi")).alias("prefix")).where("prefix <> ''").groupBy("source", "prefix").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    return n.where(F.col("share") >= share).select("source", "prefix", "share")


def resolve_sources(journals: DataFrame, sources: DataFrame) -> DataFrame:
    """(journal, source, works): the source with an equal normalised name, the largest on ties; unmatched journals stay."""
    j = journals.select("journal", journal_name(F.col("journal")).alias("n"))
    s = sources.select("source", "works", journal_name(F.col("source")).alias("n"))
    return first_by(j.join(s, "n", "left"), ["journal"], F.desc_nulls_last("works"), F.col("source").asc_nulls_last()).select("journal", "source", "works")


def _rarest(rows: DataFrame, tokens: str, freq: DataFrame, part: float) -> DataFrame:
    """``rows`` once per word w of their n - ceil(part * n) + 1 rarest words; ``_id`` tells the rows apart and is dropped."""
    each = rows.select("_id", F.explode(tokens).alias("w")).join(freq, "w", "left")
    order = F.array_sort(F.collect_set(F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.col("w").alias("w"))))
    n = F.size("_o")
    few = each.groupBy("_id").agg(order.alias("_o")).select("_id", F.explode(F.slice("_o", F.lit(1), n - F.ceil(n * part - 1e-9).cast("int") + 1)).alias("x")).select("_id", F.col("x.w").alias("w"))
    return rows.join(few, "_id").drop("_id")


def title_match(papers: DataFrame, works: DataFrame, trusted: DataFrame | None = None, fuzzy: float | None = 0.9, year_slack: int = 1, least: int = 3) -> DataFrame:
    """(handle, doi, content_sim, match_type): papers and works of one source with the same content words.

    papers, works: (source, title, year, handle / doi). Exact: equal sets of
    content words. Fuzzy, for papers without an exact match: shared words over
    the smaller set at least ``fuzzy``. Titles of fewer than ``least`` content
    words never match, nor do DOIs outside the trusted prefixes.
    """
    p = papers.select("handle", "source", "year", content_key(F.col("title")).alias("key"), content_tokens(F.col("title")).alias("tok")).where(F.size("tok") >= least)
    w = works.select("doi", "source", F.col("year").alias("w_year"), content_key(F.col("title")).alias("key"), content_tokens(F.col("title")).alias("w_tok")).where(F.size("w_tok") >= least)
    if trusted is not None:
        w = w.withColumn("prefix", doi_prefix(F.col("doi"))).join(trusted.select("source", "prefix"), ["source", "prefix"], "left_semi").drop("prefix")
    near = F.abs(F.col("year") - F.col("w_year")) <= year_slack
    exact = first_by(p.join(w, ["source", "key"]).where(near), ["handle"], F.col("doi")).select("handle", "doi", F.lit(1.0).alias("content_sim"), F.lit("exact").alias("match_type"))
    if fuzzy is None:
        return exact
    # both are read several times below
    rest, w = materialize(p.join(exact, "handle", "left_anti"), "unmatched"), materialize(w, "works")
    # a title that shares ``fuzzy`` of its words with a longer one shares one of its rarest few: only those are looked up
    freq = w.select(F.explode("w_tok").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    a = rest.select("handle", "source", "year", "tok")
    b = w.select("doi", "source", "w_year", "w_tok")
    few_a = _rarest(a.withColumn("_id", F.xxhash64("handle", "source", "year")), "tok", freq, fuzzy).join(b.select("doi", "source", "w_year", "w_tok", F.explode("w_tok").alias("w")), ["source", "w"]).where(F.size("tok") <= F.size("w_tok"))
    few_b = _rarest(b.withColumn("_id", F.xxhash64("doi", "source", "w_year", F.array_join("w_tok", " "))), "w_tok", freq, fuzzy).join(a.select("handle", "source", "year", "tok", F.explode("tok").alias("w")), ["source", "w"]).where(F.size("w_tok") < F.size("tok"))
    cols = ["handle", "doi", "tok", "w_tok"]
    pairs = few_a.where(near).select(*cols).unionByName(few_b.where(near).select(*cols))
    sim = F.size(F.array_intersect("tok", "w_tok")) / F.least(F.size("tok"), F.size("w_tok"))
    scored = pairs.select("handle", "doi", sim.alias("content_sim")).where(F.col("content_sim") >= fuzzy)
    best = first_by(scored, ["handle"], F.desc("content_sim"), F.col("doi")).select("handle", "doi", "content_sim", F.lit("fuzzy").alias("match_type"))
    return exact.unionByName(best)


def freshest(works: DataFrame, key: str, *order: Column) -> DataFrame:
    """Newest row per key."""
    return first_by(works.where(F.col(key).isNotNull()), [key], *order)


def enrich(articles: DataFrame, works: DataFrame) -> DataFrame:
    """Articles with the freshest work of their DOI; several articles may share one."""
    return articles.join(works, "doi")


def priority_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first part that knows the key, in the order of the list."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("_p", F.lit(n))
        out = p if out is None else out.unionByName(p)
    return first_by(out, [key], F.col("_p"), *[F.col(c) for c in parts[0].columns if c != key]).drop("_p")


def pick_candidate(rows: DataFrame, entry_title: str, title: str, least: float = 0.5, year_slack: int = 1) -> DataFrame:
    """The candidate per entry with the most similar title, among those of a fitting year and with a DOI."""
    ok = rows.withColumn("sim", title_sim(F.col(entry_title), F.col(title))).where(F.col("doi").isNotNull() & (F.abs(F.col("entry_year") - F.col("year")) <= year_slack) & (F.col("sim") >= least))
    return first_by(ok, ["entry_id"], F.desc("sim"), F.col("doi"))
