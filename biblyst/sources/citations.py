"""Citation lines "cited citing#citing,..." as edges, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_edges(lines: DataFrame) -> DataFrame:
    """(cited, citing) of (value): the first word, then everything after it cut at '#' and ','; lower case, empty ones dropped."""
    line = F.lower(F.trim("value"))
    cited = F.regexp_extract(line, r"^(\S+)", 1)
    rest = F.regexp_extract(line, r"^\S+\s+(.*)$", 1)
    out = lines.select(cited.alias("cited"), F.explode(F.split(rest, "[#,]")).alias("citing"))
    return out.select("cited", F.trim("citing").alias("citing")).where("cited <> '' and citing <> ''")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return explode_edges(spark.read.text(path))


def stream_edges(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Append the edges of files not seen before, and return when they are done."""
    lines = spark.readStream.text(path)
    explode_edges(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
