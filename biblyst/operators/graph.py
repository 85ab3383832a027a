"""Citation-graph statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblyst.operators.skew import salted_lookup
from biblyst.session import materialize

#: Citers of a set of hubs that meet all others of it in one group.
HUB_CITERS = 1000


def internal_edges(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Edges both of whose ends are articles; duplicates stay. Joins on the handle that varies most come first."""
    known = articles.select("handle").distinct()
    out = edges.join(known.withColumnRenamed("handle", "citing"), "citing", "left_semi")
    return out.join(known.withColumnRenamed("handle", "cited"), "cited", "left_semi").select("citing", "cited")


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """percent_rank of every row by ``value`` over the whole table without gathering the table.

    The histogram of values is ranked instead, and joined back. NULL values
    count as the lowest. A table of one row has rank 0.
    """
    hist = df.groupBy(value).agg(F.count("*").alias("_n"))
    # one task sees the distinct values, not the rows
    below = F.coalesce(F.sum("_n").over(Window.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = hist.withColumn("_below", below).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    ranked = ranked.select(F.col(value).alias("_v"), F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias(out))
    return df.join(ranked, df[value].eqNullSafe(ranked["_v"])).drop("_v")


def handle_stats_first(articles: DataFrame, edges: DataFrame, now_year: int) -> DataFrame:
    """Counts, age and citation percentile of every article with a year."""
    base = articles.where("year is not null").select("handle", "year")
    inner = internal_edges(edges, base)
    n = lambda df, key, name: df.groupBy(F.col(key).alias("handle")).agg(F.count("*").alias(name))
    out = base.join(n(edges, "cited", "total_citations"), "handle", "left").join(n(inner, "cited", "internal_citations"), "handle", "left")
    out = out.join(n(edges, "citing", "total_references"), "handle", "left").join(n(inner, "citing", "internal_references"), "handle", "left")
    out = out.fillna(0, ["total_citations", "internal_citations", "total_references", "internal_references"])
    age = F.lit(now_year) - F.col("year")
    out = out.withColumn("years_since_pub", age).withColumn("citations_per_year", F.when(age > 0, F.col("total_citations") / age).otherwise(F.lit(0.0)))
    return percent_rank(out, "total_citations", "citation_percentile")


def citers(articles: DataFrame, edges: DataFrame, first: DataFrame) -> DataFrame:
    """(cited, citer, percentile, category, journal, year): internal edges with what is known of the citer."""
    base = articles.where("year is not null").select(F.col("handle").alias("citing"), "category", "journal", "year")
    known = base.join(first.select(F.col("handle").alias("citing"), "citation_percentile"), "citing")
    inside = articles.where("year is not null").select(F.col("handle").alias("cited")).distinct()
    return edges.join(known, "citing").join(inside, "cited", "left_semi")


def handle_stats_second(cite: DataFrame, top_category: str) -> DataFrame:
    """Quality of an article's citers; shares count citers without a category in the denominator."""
    p = F.col("citation_percentile")
    top = F.sum(F.when(F.col("category") == top_category, 1).otherwise(0)) / F.count("*")
    return cite.groupBy(F.col("cited").alias("handle")).agg(F.median(p).alias("median_citer_percentile"), F.avg(p).alias("mean_citer_percentile"), F.max(p).alias("max_citer_percentile"), F.sum(p).alias("weighted_citations"), top.alias("top_category_share"))


def mode(df: DataFrame, keys: list[str], value: str, out: str, nulls: bool = False) -> DataFrame:
    """Most frequent value per key; the smallest on ties, NULL last. NULLs count only if asked for."""
    rows = df if nulls else df.where(F.col(value).isNotNull())
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value).isNull(), F.col(value))).alias(out))


def citations_by_year(cite: DataFrame) -> DataFrame:
    """(handle, years, counts): citing years in order, with the count of each in the same place."""
    n = cite.groupBy(F.col("cited").alias("handle"), "year").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("year", "n")))
    return n.groupBy("handle").agg(pairs.alias("p")).select("handle", F.col("p.year").alias("years"), F.col("p.n").alias("counts"))


def citer_categories(cite: DataFrame) -> DataFrame:
    """(handle, category, n, share) over citers with a category."""
    n = cite.where("category is not null").groupBy(F.col("cited").alias("handle"), "category").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("handle")))


def with_article(edges: DataFrame, end: str, articles: DataFrame, how: str = "left") -> DataFrame:
    """Edges with title and year of the article at one end; out-of-corpus ends stay with ``left``."""
    facts = articles.select(F.col("handle").alias(end), "title", "year")
    return edges.join(facts, end, how)


def versions_of(links: DataFrame, both: bool) -> DataFrame:
    """(handle, other, type): links in their direction, or each from both ends."""
    ok = links.where("source is not null and target is not null and source <> '' and target <> ''")
    out = ok.select(F.col("source").alias("handle"), F.col("target").alias("other"), "type")
    return out.unionByName(ok.select(F.col("target").alias("handle"), F.col("source").alias("other"), "type")) if both else out


def coupling(edges: DataFrame, least: int, hot: int) -> DataFrame:
    """(a, b, shared, strength): pairs of articles with at least ``least`` references in common.

    Every reference counts; ``hot`` shapes the plan, not the result. A pair is
    met once, at the rarest of its common references. If even that one is cited
    by more than ``hot`` articles (a hub), it is met at its rarest ``least`` (at
    most two) hubs together, so the citers of one hub are never paired.
    """
    e = materialize(edges.distinct(), "edges")
    counts = e.groupBy("cited").agg(F.count("*").alias("n")).where("cited is not null and n > 1")
    counts = materialize(counts.select("cited", "n", F.col("n").alias("_n"), F.monotonically_increasing_id().alias("ref")), "cited")
    used = salted_lookup(e.where("citing is not null"), counts, ["cited"]).groupBy("citing").agg(F.array_sort(F.collect_list(F.struct("n", "ref"))).alias("r"))
    hubs = F.transform(F.filter("r", lambda x: x["n"] > hot), lambda x: x["ref"])
    rare = F.transform(F.filter("r", lambda x: x["n"] <= hot), lambda x: x["ref"])
    used = materialize(used.select(F.monotonically_increasing_id().alias("id"), "citing", rare.alias("rare"), hubs.alias("hubs")), "references")  # rarest first
    every = F.concat("rare", "hubs").alias("r")

    def meet(left: DataFrame, right: DataFrame, on: list[str], key: Column, n: int) -> DataFrame:
        both = left.join(right, on).where("a < b").select("a", "b", key.alias("key"), F.array_intersect("x", "y").alias("both"))
        # further common references meet the pair again, which doesn't count
        return both.where((F.size("both") >= least) & (F.slice("both", 1, n) == F.col("key"))).select("a", "b", F.size("both").cast("long").alias("shared"))

    few = used.select("id", every, F.explode("rare").alias("ref"))
    few = meet(few.toDF("a", "x", "ref"), few.toDF("b", "y", "ref"), ["ref"], F.array("ref"), 1)
    later = lambda x, i: F.transform(F.slice("hubs", i + 2, F.size("hubs")), lambda y: F.array(x, y))
    sets = F.transform("hubs", lambda x: F.array(x)) if least < 2 else F.flatten(F.transform("hubs", later))
    many = used.select("id", every, F.explode(sets).alias("key"))
    sizes = materialize(many.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("parts", (1 + F.col("_n") / HUB_CITERS).cast("int")), "hub-sizes")
    many = salted_lookup(many, sizes, ["key"])
    left = many.select("key", F.col("id").alias("a"), F.col("r").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = many.select("key", F.col("id").alias("b"), F.col("r").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = few.unionByName(meet(left, right, ["key", "part"], F.col("key"), min(least, 2)))

    names = used.select("id", "citing").join(e.groupBy("citing").agg(F.count("*").alias("refs")), "citing")
    pairs = pairs.join(names.toDF("ca", "a", "ra"), "a").join(names.toDF("cb", "b", "rb"), "b")
    return pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "shared", (F.col("shared") / (F.col("ra") + F.col("rb") - F.col("shared"))).alias("strength"))


def null_safe_differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
