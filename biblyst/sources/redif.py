"""Template files of "Key: value" blocks, as text.

A block begins with "Template-Type:". A line that starts with blanks goes on
the value before it. Keys repeat; author keys follow an "Author-Name:".
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblyst.functions.text import normalize_doi, parse_year


def parse_blocks(text: str) -> list[list[tuple[str, str]]]:
    """(key in lower case, value) pairs of each block; lines before the first block are dropped."""
    blocks: list[list[tuple[str, str]]] = []
    for line in text.lstrip("﻿").splitlines():
        if not line.strip():
            continue
        key, sep, value = line.partition(":")
        if line[0].isspace() or not sep or not key.replace("-", "").replace("#", "").replace("_", "").isalnum():
            if blocks and blocks[-1]:
                k, v = blocks[-1][-1]
                blocks[-1][-1] = (k, f"{v} {line.strip()}".strip())
            continue
        key = key.strip().lower()
        if key == "template-type":
            blocks.append([])
        if blocks:
            blocks[-1].append((key, value.strip()))
    return blocks


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, i, [{"key": k, "value": v} for k, v in b]) for p, t in zip(pdf["path"], pdf["value"]) for i, b in enumerate(parse_blocks(t or ""))]
        yield pd.DataFrame(rows, columns=["path", "block", "fields"])


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, fields): every block of the files; fields keep their order."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{rdf,redif}").select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(_parse, "path string, block int, fields array<struct<key:string,value:string>>")


def values(key: str) -> Column:
    """All values of a key in order."""
    return F.transform(F.filter("fields", lambda x: x["key"] == key), lambda x: x["value"])


def value(key: str) -> Column:
    """First value of a key that is not empty, else NULL."""
    return F.get(F.filter(values(key), lambda x: x != ""), F.lit(0))


def entries(templates: DataFrame, forthcoming: int) -> DataFrame:
    """Papers, articles and chapters as rows of the articles table; a handle needs more than three parts."""
    kind = F.lower(value("template-type"))
    h = value("handle")
    parts = F.split(h, ":")
    series = kind.startswith("redif-paper")
    out = templates.where(kind.rlike("^redif-(paper|article|chapter)") & (F.size(parts) > 3))
    return out.select(
        h.alias("Handle"),
        value("title").alias("title"),
        value("abstract").alias("abstract"),
        value("pages").alias("pages"),
        value("volume").alias("vol"),
        value("issue").alias("issue"),
        value("number").alias("number"),
        F.lower(F.get(parts, F.lit(1))).alias("archive"),
        F.get(parts, F.lit(2)).alias("journal_code"),
        F.when(series, parse_year(value("creation-date"), forthcoming)).otherwise(parse_year(value("year"), forthcoming)).alias("year"),
        series.alias("is_series"),
        value("journal").alias("journal"),
        value("file-url").alias("url"),
        F.array_join(F.filter(values("author-name"), lambda x: x != ""), "; ").alias("authors"),
        F.coalesce(normalize_doi(value("doi")), normalize_doi(value("x-doi"))).alias("doi"),
        F.filter(F.split(F.upper(F.coalesce(value("classification-jel"), F.lit(""))), r"[\s,;]+"), lambda c: c.rlike(r"^[A-Z]\d{0,2}$")).alias("jel"),
    )


# Fields of a person template that list works, and the role they give.
ROLES = {"author-paper": "paper", "author-article": "article", "author-chapter": "chapter", "author-book": "book", "author-software": "software", "editor-book": "editor-book", "editor-series": "editor-series"}


def person_works(templates: DataFrame) -> DataFrame:
    """(short_id, work_handle, work_type) of person templates, handles in lower case."""
    people = templates.where(F.lower(value("template-type")).startswith("redif-person"))
    role = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))])
    rows = people.select(F.lower(value("short-id")).alias("short_id"), F.explode("fields").alias("f"))
    return rows.select("short_id", F.lower(F.trim("f.value")).alias("work_handle"), role[F.col("f.key")].alias("work_type")).where("work_type is not null and work_handle <> ''")


def person_workplaces(templates: DataFrame) -> DataFrame:
    """(short_id, rank, name, institution, share): workplaces in order; a share that is no number is NULL."""
    people = templates.where(F.lower(value("template-type")).startswith("redif-person"))
    zipped = F.arrays_zip(values("workplace-name").alias("name"), values("workplace-institution").alias("institution"), values("workplace-share").alias("share"))
    rows = people.select(F.lower(value("short-id")).alias("short_id"), F.posexplode(zipped).alias("p", "w"))
    return rows.select("short_id", (F.col("p") + 1).alias("rank"), F.col("w.name").alias("name"), F.lower("w.institution").alias("institution"), F.col("w.share").try_cast("double").alias("share"))


def institutions(templates: DataFrame) -> DataFrame:
    """(edi_handle, display_name, location, url): the deepest tier names the place after its primary institution."""
    inst = templates.where(F.lower(value("template-type")).startswith("redif-institution") & value("handle").isNotNull())
    deep = F.coalesce(value("tertiary-name"), value("secondary-name"))
    name = F.when(deep.isNotNull(), F.concat_ws(", ", deep, value("primary-name"))).otherwise(value("primary-name"))
    return inst.select(F.lower(value("handle")).alias("edi_handle"), name.alias("display_name"), value("primary-location").alias("location"), F.coalesce(value("tertiary-homepage"), value("secondary-homepage"), value("primary-homepage")).alias("url"))


def changed_since(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(path, modified) of files that are new or newer than in ``known`` (path, parsed_at)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"))
    return files.join(known, "path", "left").where(F.col("parsed_at").isNull() | (F.col("modified") > F.col("parsed_at"))).select("path", "modified")
