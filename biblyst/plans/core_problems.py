"""Queries p1 and p2 over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblyst.operators.orphans import corpus_orphans, handle, orphan_report
from biblyst.operators.packed import split_packed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_authors(articles: DataFrame) -> DataFrame:
    """(handle, authors): an article once; its repeated rows differ at most in loaded_at.

    Should repeated rows differ in authors after all, the first in string
    order that is not NULL counts.
    """
    return articles.select(handle("Handle").alias("handle"), "authors").where("handle is not null and authors is not null").groupBy("handle").agg(F.min("authors").alias("authors"))


def author_values(articles: DataFrame) -> DataFrame:
    """(handle, author_pos, author_name) of all articles."""
    return split_packed(distinct_authors(articles), "authors", ["handle"], "author_pos", "author_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_values(table(spark, sf_dir, "articles"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_orphans(*[table(spark, sf_dir, t) for t in ("person_works", "cit_internal", "persons", "articles", "journals")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).drop("fk").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report}

_CASES = """
  refs AS (
    SELECT 'person_works' AS ref_table, 'short_id' AS ref_column, 'persons' AS target, lower(trim(short_id)) AS fk, loaded_at AS t, lower(trim(short_id)) AS row_key_1, lower(trim(work_handle)) AS row_key_2 FROM person_works
    UNION ALL
    SELECT 'person_works', 'work_handle', CASE WHEN lower(trim(work_type)) = 'editor-series' THEN 'journals' ELSE 'articles' END, lower(trim(work_handle)), loaded_at, lower(trim(short_id)), lower(trim(work_handle)) FROM person_works
    UNION ALL
    SELECT 'cit_internal', 'cited', 'articles', lower(trim(cited)), loaded_at, lower(trim(citing)), lower(trim(cited)) FROM cit_internal),
  parents AS (
    SELECT 'persons' AS target, lower(trim(short_id)) AS fk, loaded_at, removed_at FROM persons
    UNION ALL SELECT 'articles', lower(trim(Handle)), loaded_at, removed_at FROM articles
    UNION ALL SELECT 'journals', lower(trim(series_handle)), TIMESTAMP '0001-01-01', NULL FROM journals),
  cases AS (
    SELECT ref_table, ref_column, strftime(t, '%Y-%m') AS period, row_key_1, row_key_2, fk FROM refs r
    WHERE fk IS NOT NULL AND fk <> '' AND NOT EXISTS (
      SELECT 1 FROM parents p WHERE p.target = r.target AND p.fk = r.fk AND p.loaded_at <= r.t AND (p.removed_at IS NULL OR p.removed_at > r.t)))
"""

ORACLE = {
    "p2_found": f"WITH {_CASES} SELECT DISTINCT ref_table, ref_column, period, row_key_1, row_key_2 FROM cases",
    "p2_report": f"WITH {_CASES} SELECT ref_table, ref_column, period, count(*) AS orphan_rows, count(DISTINCT fk) AS orphan_keys FROM cases GROUP BY 1, 2, 3",
}
