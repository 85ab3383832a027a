"""Joins that survive keys holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot; at most HOT_SHARE such keys exist.
HOT_SHARE = 200
SALT = 32


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str = "_n", salt: int = SALT, total: int | None = None, merge: bool = False) -> DataFrame:
    """Inner join of ``rows`` to ``lookup``, which is unique by ``keys``.

    ``lookup[n]`` holds how many rows of ``rows`` carry the key; it is dropped.
    Rows of hot keys are spread over ``salt`` copies of their lookup row. Give
    a materialized ``lookup``: it is read three times, once at the call. NULL keys match nothing.
    ``total``, a number that the sum of ``n`` does not exceed, saves the read at the call.
    ``merge``: the lookup is never broadcast, however small its files are.
    """
    if total is None:
        total = lookup.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = lookup.where(F.col(n) * HOT_SHARE > total).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)  # at most HOT_SHARE rows by construction
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot", n)
    right = right.hint("merge") if merge else right
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salt)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
