"""Smaller source formats: series factors, classification trees, related works, catalogue rows, CSV."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACTOR_FIELDS = 10


def series_factors(lines: DataFrame, least: int = 1000) -> DataFrame:
    """(series_handle, simple_if, ..., h_index) from tab-separated lines of a handle and nine numbers.

    Lines not starting with RePEc: are comments. A line of another width, or
    fewer than ``least`` lines, is an error: the file is broken then.
    """
    rows = lines.where(F.col("value").startswith("RePEc:")).select(F.split("value", "\t").alias("f"))
    seen = rows.agg(F.count("*").alias("n"), F.count(F.when(F.size("f") != FACTOR_FIELDS, 1)).alias("bad")).first()
    if seen["bad"] or seen["n"] < least:
        raise ValueError(f"{seen['n']} lines, {seen['bad']} of them malformed")
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    names = ["simple_if", "recursive_if", "discounted_if", "recursive_discounted_if", "h_index", "n_items", "n_citations", "adjusted_citations", "euclid"]
    return rows.select(F.lower(F.get("f", F.lit(0))).alias("series_handle"), *[number(i).alias(c) for i, c in enumerate(names, 1)])


def _classes(el: ElementTree.Element) -> list[ElementTree.Element]:
    """The outermost classifications below an element."""
    return [y for x in el for y in ([x] if x.tag == "classification" else _classes(x))]


def jel_tree(spark: SparkSession, path: str, least: int = 500) -> DataFrame:
    """(code, label, level, parent) of a nested classification in XML; the parent is the element around it.

    The nesting of opening and closing tags gives level and parent, so codes
    need not begin with their parent's. A tree of fewer than ``least`` nodes is
    an error: the file is broken then.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in filter(None, pdf["value"]):
                tree = ElementTree.fromstring(text)
                todo = [(el, 1, None) for el in _classes(tree)]
                while todo:
                    el, level, parent = todo.pop()
                    code = (el.findtext("code") or "").strip().upper()
                    rows.append((code, (el.findtext("description") or "").strip(), level, parent))
                    todo += [(x, level + 1, code) for x in el.findall("classification")]
            yield pd.DataFrame(rows, columns=["code", "label", "level", "parent"])

    out = spark.read.text(path, wholetext=True).mapInPandas(run, "code string, label string, level int, parent string").where("code <> ''").distinct()
    if out.count() < least:
        raise ValueError(f"fewer than {least} nodes")
    return out


def related_works(lines: DataFrame) -> DataFrame:
    """(source, target, type) from JSON of source -> relation -> target; the text is read as data, never run."""
    kind = "map<string,map<string,map<string,string>>>"
    a = lines.select(F.explode(F.from_json("value", kind)).alias("source", "r"))
    b = a.select("source", F.explode("r").alias("type", "t"))
    return b.select("source", F.explode(F.map_keys("t")).alias("target"), "type").select("source", "target", "type")


def flat_metrics(works: DataFrame, dois: DataFrame) -> DataFrame:
    """Catalogue works of known DOIs with nested metrics flattened; lists become JSON, absent ones stay NULL."""
    w = works.where(F.col("type").isin("article", "review") & F.col("doi").isNotNull()).withColumn("doi", F.lower(F.regexp_replace("doi", "^https?://doi.org/", "")))
    w = w.join(dois.select("doi").distinct(), "doi", "left_semi")
    return w.select(
        "doi",
        F.col("id").alias("openalex_id"),
        "type",
        "cited_by_count",
        "is_retracted",
        "fwci",
        F.col("citation_normalized_percentile.value").alias("citation_percentile"),
        F.col("open_access.oa_status").alias("oa_status"),
        F.col("primary_topic.display_name").alias("topic"),
        F.to_json("counts_by_year").alias("counts_by_year"),
        F.to_json(F.transform("funders", lambda x: x["display_name"])).alias("funders"),
        "updated_date",
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; cells that don't fit are NULL."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", quote='"', escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def markdown_list(papers: DataFrame) -> DataFrame:
    """(rank, line): numbered source lines of (rank, authors, year, title, handle)."""
    year = F.concat(F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(")"))
    return papers.select("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("authors", F.lit("")), year, F.lit(". "), F.coalesce("title", F.lit("")), F.lit(". "), F.col("handle")).alias("line"))


def catalogue_works(works: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Works of type article or review with identifier and title, of the given sources (id); the source is the nested one of the primary location."""
    w = works.where(F.col("type").isin("article", "review") & F.col("doi").isNotNull() & F.col("title").isNotNull())
    w = w.withColumn("src_id", F.col("primary_location.source.id"))
    return w if sources is None else w.join(sources.select(F.col("id").alias("src_id")).distinct(), "src_id", "left_semi")


def read_store(spark: SparkSession, path: str, columns: list[str], anonymous: bool = False) -> DataFrame:
    """Columns of parquet files under a path of any Hadoop file system; an object store is read without credentials if asked for."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if anonymous:
        conf.set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")
    return spark.read.parquet(path).select(*columns)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of the files below a folder, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy("path")


# Folders of an archive mirror that hold no records.
NOT_RECORDS = ("cpd/conf", "per/pers", "edi/inst")


def record_files(files: DataFrame) -> DataFrame:
    """(path, archive, journal, repo_id) of record files .../<archive>/<journal>/<name>.redif or .rdf, without the folders that hold none."""
    x = F.regexp_extract("path", r"(?i)([^/]+/[^/]+)/[^/]*\.(?:redif|rdf)$", 1)
    parts = F.split(F.col("_d"), "/")
    out = files.select("path", F.lower(x).alias("_d")).where((F.col("_d") != "") & ~F.col("_d").isin(*NOT_RECORDS))
    return out.select("path", F.get(parts, F.lit(0)).alias("archive"), F.get(parts, F.lit(1)).alias("journal"), F.replace("_d", F.lit("/"), F.lit("_")).alias("repo_id"))


def pull_chunks(plan: DataFrame, out: str, pull: Callable[[list[str]], DataFrame], tries: int = 8) -> list[str]:
    """Run ``pull`` for every chunk of (path, chunk) whose output does not exist; return the chunks written.

    Each chunk is written beside its place and renamed, so a run that dies
    leaves no half chunk and the next one goes on where it stopped. The plan is
    a list of files: small.
    """
    spark = plan.sparkSession
    jvm, done = spark._jvm, []
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    groups: dict[str, list[str]] = {}
    for r in plan.orderBy("chunk", "path").toLocalIterator():
        groups.setdefault(r["chunk"], []).append(r["path"])
    for chunk, paths in groups.items():
        if fs.exists(at(f"{out}/{chunk}")):
            continue
        for k in range(tries):
            try:
                pull(paths).write.mode("overwrite").parquet(f"{out}/_tmp-{chunk}")
                break
            except Exception:
                if k == tries - 1:
                    raise
        fs.rename(at(f"{out}/_tmp-{chunk}"), at(f"{out}/{chunk}"))
        done.append(chunk)
    return done


# Columns of the table of sources and of the table of a search.
EXPORT = ["handle", "title", "authors", "year", "journal", "category", "url", "doi", "similarity"]
SEARCH = ["handle", "title", "authors", "year", "journal", "category", "url", "abstract", "max_similarity", "sections", "cites_internal", "cites_total", "percentile", "oa_cites", "fwci", "retracted", "oa_url"]
EXPORT_ROWS = 2000


def export_rows(papers: DataFrame, order: str = "rank") -> DataFrame:
    """The nine columns of an export, at most EXPORT_ROWS rows in the order given; columns that are missing are NULL."""
    cols = [F.col(c) if c in papers.columns else F.lit(None).cast("string").alias(c) for c in EXPORT]
    return papers.orderBy(order, "handle").limit(EXPORT_ROWS).select(*cols)


def search_rows(papers: DataFrame) -> DataFrame:
    """(handle, line): the seventeen columns of a search as a line of CSV; cells with commas, quotes or line ends are quoted, NULLs empty, retracted ones marked."""

    def cell(c: str) -> Column:
        if c not in papers.columns:
            return F.lit("")
        x = F.when(F.col(c), "RETRACTED").otherwise("") if c == "retracted" else F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return papers.select("handle", F.concat_ws(",", *[cell(c) for c in SEARCH]).alias("line"))


def network_owner(answers: DataFrame) -> DataFrame:
    """(ip, netname, org, country, cidr) of (ip, value): answers of address registries in either of two JSON forms, the first value found of each."""
    attr = "objects struct<object: array<struct<attributes: struct<attribute: array<struct<name:string,value:string>>>>>>"
    net = "net struct<name: struct<`$`:string>, orgRef: struct<`@name`:string>, netBlocks: struct<netBlock: struct<startAddress: struct<`$`:string>, cidrLength: struct<`$`:string>>>>"
    x = answers.withColumns({"_r": F.from_json("value", attr), "_n": F.from_json("value", net)})
    flat = F.flatten(F.transform("_r.objects.object", lambda o: o["attributes"]["attribute"]))

    def named(n: str) -> Column:
        return F.get(F.transform(F.filter(flat, lambda a: F.lower(a["name"]) == n), lambda a: a["value"]), F.lit(0))

    def first(*names: str) -> Column:
        return F.coalesce(*map(named, names))

    block = F.col("_n.net.netBlocks.netBlock")
    arin = F.concat_ws("/", block["startAddress"]["$"], block["cidrLength"]["$"])
    return x.select("ip", F.coalesce(first("netname"), F.col("_n.net.name.$")).alias("netname"), F.coalesce(first("org-name", "descr", "org"), F.col("_n.net.orgRef")["@name"]).alias("org"), first("country").alias("country"), F.coalesce(first("inetnum", "inet6num", "route"), F.when(arin != "", arin)).alias("cidr"))


def attach(spark: SparkSession, prefix: str, tables: dict[str, DataFrame]) -> None:
    """Make another database's tables readable as <prefix>_<name> in SQL, beside those of the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
