"""References to records that do not exist when the reference is loaded.

Plan: the distinct non-null foreign keys (pre-aggregated, with their row
counts) meet the parents' lifetimes once; rows are then joined back to the
verdict of their key. Keys absent altogether are the left anti-join part;
keys that exist at some time carry their lifetimes so that each row is judged
at its own time. The join back salts hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblyst.operators.skew import salted_lookup
from biblyst.session import materialize


def handle(c: str | Column) -> Column:
    """Comparison form of a handle or short id; empty reads as NULL."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def lifetimes(parents: DataFrame, key: str, loaded: str = "loaded_at", removed: str = "removed_at") -> DataFrame:
    """(key, lives): spans in which a parent with this key is present.

    Repeated parent rows that end at one time collapse to the earliest start,
    so ``lives`` has one entry per distinct removal time.
    """
    one = parents.select(handle(key).alias("fk"), F.col(loaded).alias("born"), F.col(removed).alias("gone")).where("fk is not null and born is not null")
    one = one.groupBy("fk", "gone").agg(F.min("born").alias("born"))
    return one.groupBy("fk").agg(F.collect_list(F.struct("born", "gone")).alias("lives"))


def orphan_rows(refs: DataFrame, parents: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """Rows of ``refs`` whose key has no living parent at the row's time.

    ``refs``: (target, fk, at, ...); ``parents``: (target, fk, lives), unique by
    (target, fk); ``always``: (target, fk) of parents without a lifetime, which
    exist at any time. NULL keys are no references. A row without a time is
    an orphan only if its key never exists. Duplicate rows stay.
    """
    refs = refs.where(F.col("fk").isNotNull())
    if always is not None:
        parents = parents.unionByName(always.distinct().withColumn("lives", F.array(F.struct(F.lit("0001-01-01").cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("gone")))))
    keys = refs.groupBy("target", "fk").agg(F.count("*").alias("_n"))
    verdict = materialize(keys.join(parents, ["target", "fk"], "left"), "fk-verdicts")
    alive = F.coalesce(F.exists("lives", lambda x: F.coalesce(x["born"] <= F.col("at"), F.lit(True)) & F.coalesce(x["gone"] > F.col("at"), F.lit(True))), F.lit(False))
    return salted_lookup(refs, verdict, ["target", "fk"]).where(~alive).drop("lives")


def corpus_refs(person_works: DataFrame, cit_internal: DataFrame) -> DataFrame:
    """The corpus' three reference fields in the form ``orphan_rows`` reads."""

    def one(df: DataFrame, table: str, column: str, a: str, b: str, target: Column) -> DataFrame:
        return df.select(target.alias("target"), handle(column).alias("fk"), F.col("loaded_at").alias("at"), F.lit(table).alias("ref_table"), F.lit(column).alias("ref_column"), F.lower(F.trim(a)).alias("row_key_1"), F.lower(F.trim(b)).alias("row_key_2"))

    work = F.when(F.lower(F.trim("work_type")) == "editor-series", "journals").otherwise("articles")
    return reduce(
        DataFrame.unionByName,
        [
            one(person_works, "person_works", "short_id", "short_id", "work_handle", F.lit("persons")),
            one(person_works, "person_works", "work_handle", "short_id", "work_handle", work),
            one(cit_internal, "cit_internal", "cited", "citing", "cited", F.lit("articles")),
        ],
    )


def corpus_orphans(person_works: DataFrame, cit_internal: DataFrame, persons: DataFrame, articles: DataFrame, journals: DataFrame) -> DataFrame:
    """Orphan references of the corpus: (ref_table, ref_column, period, row_key_1, row_key_2, fk), one row per referring row."""
    parents = lifetimes(persons, "short_id").withColumn("target", F.lit("persons")).unionByName(lifetimes(articles, "Handle").withColumn("target", F.lit("articles")))
    always = journals.select(F.lit("journals").alias("target"), handle("series_handle").alias("fk")).where("fk is not null")
    found = orphan_rows(corpus_refs(person_works, cit_internal), parents, always)
    return found.select("ref_table", "ref_column", F.date_format("at", "yyyy-MM").alias("period"), "row_key_1", "row_key_2", "fk")


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, field and month: rows, and distinct missing keys."""
    return found.groupBy("ref_table", "ref_column", "period", "fk").agg(F.count("*").alias("n")).groupBy("ref_table", "ref_column", "period").agg(F.sum("n").alias("orphan_rows"), F.count("*").alias("orphan_keys"))
