"""Queries p3 to p10 over the corpus tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblyst.llm.components import connected_components
from biblyst.llm.leaks import leaks, similar_passages
from biblyst.llm.matching import match_records
from biblyst.llm.mixing import mix_sources
from biblyst.llm.names import link_names
from biblyst.llm.near_dup import near_duplicates
from biblyst.llm.sentences import sentences
from biblyst.llm.vectors import nearest
from biblyst.operators.orphans import handle
from biblyst.plans.core_problems import author_values, table
from biblyst.session import materialize


def article_texts(articles: DataFrame) -> DataFrame:
    """(handle, text) of articles whose abstract has at least 20 words, an article once."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("authors", F.lit("")))
    words = F.size(F.filter(F.split("abstract", r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return articles.select(handle("Handle").alias("handle"), text.alias("text"), words.alias("n")).where("handle is not null and n >= 20").groupBy("handle").agg(F.min("text").alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "articles").select(handle("Handle").alias("handle"), "embeddings")
    near = nearest(vectors, "handle", "embeddings", 64, 5)
    return near.select(F.least("id", "near_id").alias("handle_a"), F.greatest("id", "near_id").alias("handle_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = article_texts(table(spark, sf_dir, "articles"))
    return near_duplicates(docs, "handle", "text", n=3, weighted=0.15, plain=0.5).select(F.col("id").alias("handle"), F.col("group_id").alias("group_handle"))


def _links(spark: SparkSession, sf_dir: str, claims: bool = True) -> DataFrame:
    values = materialize(author_values(table(spark, sf_dir, "articles")), "authors")
    persons = table(spark, sf_dir, "persons").select(handle("short_id").alias("sid"), F.col("name_first").alias("first"), F.col("name_last").alias("last"), F.col("name_full").alias("full"))
    works = table(spark, sf_dir, "person_works").where("work_type is null or lower(trim(work_type)) not like 'editor%'").select(handle("short_id").alias("sid"), handle("work_handle").alias("handle"))
    return link_names(values, "author_name", ["handle", "author_pos"], persons, works if claims else None, "handle").withColumnRenamed("sid", "short_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "version_links").select(handle("source").alias("a"), handle("target").alias("b"))
    return connected_components(links, "a", "b", "handle", "group_handle")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "articles").select(handle("Handle").alias("id"), "title", "year", "journal", "doi")
    right = table(spark, sf_dir, "oa_works").select(F.col("work_id").alias("id"), "title", F.col("publication_year").alias("year"), F.col("source_name").alias("journal"), "doi")
    return match_records(left, right).withColumnsRenamed({"left_id": "handle", "right_id": "work_id"})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("handle", "work_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold whole items with edits: windows of the items' sizes, five-word shingles, similarity 0.8."""
    return similar_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the corpus: scarce sources reach their limits, so the exponent is bisected below 1."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total=1.0)[1]


def p9_entropy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the corpus at an entropy of 2 nats instead of the targets."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total=0.5, target_entropy=2.0)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_matches": p7_matches, "p8_found": p8_found, "p8_similar": p8_similar, "p9_plan": p9_plan, "p9_report": p9_report, "p9_whole_report": p9_whole_report, "p9_entropy_report": p9_entropy_report, "p10_found": p10_found}
ORACLE = {
    "p6_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT lower(trim(source)) AS a, lower(trim(target)) AS b FROM version_links WHERE trim(source) <> '' AND trim(target) <> ''),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach)
SELECT node AS handle, min(reach) AS group_handle FROM r GROUP BY node""",
}
