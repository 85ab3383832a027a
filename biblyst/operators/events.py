"""Folding ordered event logs: (run_id, seq, type, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_seq(events: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Running number per run, in the order given."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) + start)


def first_emission(events: DataFrame, key: str) -> DataFrame:
    """The first event per run and key."""
    return events.groupBy("run_id", key).agg(F.min("seq").alias("seq"))


def last_wins(events: DataFrame) -> DataFrame:
    """(run_id, type, payload, seq): the last event of each type per run."""
    return events.groupBy("run_id", "type").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def concat_deltas(events: DataFrame, type_: str, sep: str = "") -> DataFrame:
    """(run_id, text): payloads of one type in order."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "payload")))
    return events.where(F.col("type") == type_).groupBy("run_id").agg(F.array_join(F.transform(parts, lambda x: x["payload"]), sep).alias("text"))


def replay(events: DataFrame, from_seq: int) -> DataFrame:
    return events.where(F.col("seq") >= from_seq)


def result_flags(runs: DataFrame, papers: DataFrame, persons: DataFrame, sections: DataFrame, thin: int = 5) -> DataFrame:
    """(run_id, n, all_empty, headline_empty, thin, no_new) of each run.

    runs: (run_id, prior_count); papers: (run_id, handle); persons: (run_id,
    short_id); sections: (run_id, seq, n_total). Papers and persons count
    together, each once. The headline is empty if the last of several sections
    is and another one isn't. An empty run is not thin.
    """
    n = lambda df, c: df.groupBy("run_id").agg(F.countDistinct(c).alias(f"_{c}"))
    sec = sections.groupBy("run_id").agg(F.count("*").alias("_s"), F.max_by("n_total", "seq").alias("_last"), F.max((F.col("n_total") > 0).cast("int")).alias("_some"))
    x = runs.join(n(papers, "handle"), "run_id", "left").join(n(persons, "short_id"), "run_id", "left").join(sec, "run_id", "left").fillna(0, ["_handle", "_short_id", "_s", "_some", "prior_count"])
    total = F.col("_handle") + F.col("_short_id")
    headline = F.coalesce((F.col("_s") > 1) & (F.col("_last") == 0) & (F.col("_some") == 1), F.lit(False))
    return x.select("run_id", total.alias("n"), (total == 0).alias("all_empty"), headline.alias("headline_empty"), ((total > 0) & (total < thin)).alias("thin"), (total <= F.col("prior_count")).alias("no_new"))


def capped(events: DataFrame, size: str, limit: int) -> DataFrame:
    """Events of each run up to the one at which their summed size passes the limit."""
    run = F.sum(F.col(size)).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("_s", run).where(F.col("_s") <= limit).drop("_s")


# Kinds of raw events with the fields they must have.
REQUIRED = {
    "progress": {"label": "string"},
    "paper": {"handle": "string", "url": "string"},
    "section": {"title": "string", "handles": "array<string>"},
    "person": {"short_id": "string", "name": "string", "url": "string"},
    "person_section": {"title": "string", "short_ids": "array<string>"},
    "bibtex": {"bibtex": "string"},
    "note": {"message": "string"},
    "error": {"message": "string", "recoverable": "boolean"},
}
# Kinds of sections.
MODES = ["keyword", "semantic", "journal_scan", "author", "wp", "editor", "person", "custom"]
_RAW = "type string, label string, current double, total double, handle string, title string, year double, authors string, journal string, category string, url string, similarity double, abstract string, doi string, handles array<string>, mode string, note string, short_id string, name string, short_ids array<string>, bibtex string, message string, recoverable boolean"


def valid_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON that are well-formed events, parsed; all others are dropped.

    A required field that is missing, NULL or of another type drops the line;
    optional ones may be NULL: texts of papers become '', the year 0.
    """
    spark_type = {"string": "STRING", "array<string>": "ARRAY<STRING>", "boolean": "BOOLEAN"}
    v = F.try_parse_json(value)
    ok = F.lit(False)
    kind = F.try_variant_get(v, "$.type", "string")
    for name, fields in REQUIRED.items():
        good = kind == name
        for f, t in fields.items():
            at = F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
            good = good & ((at == spark_type[t]) | (at.isin("ARRAY<STRING>", "ARRAY<VOID>") if t == "array<string>" else F.lit(False)))
        ok = ok | good
    mode = F.try_variant_get(v, "$.mode", "string")
    ok = ok & (mode.isNull() | mode.isin(MODES))
    out = lines.where(F.coalesce(ok, F.lit(False))).withColumn("e", F.from_json(value, _RAW))
    text = lambda c: F.when(F.col("e.type") == "paper", F.coalesce(F.col(f"e.{c}"), F.lit(""))).otherwise(F.col(f"e.{c}"))
    fills = {c: text(c) for c in ("title", "authors", "journal", "category")}
    fills["year"] = F.when(F.col("e.type") == "paper", F.coalesce("e.year", F.lit(0.0))).otherwise(F.col("e.year"))
    names = [x.split()[0] for x in _RAW.split(", ")]
    return out.select(*[c for c in lines.columns], *[fills.get(c, F.col(f"e.{c}")).alias(c) for c in names])


def sections(events: DataFrame, offset: int = 0) -> DataFrame:
    """(run_id, section, title, mode, n_total, rank, handle, similarity): the sections of each run with their rows in order.

    events: (run_id, seq, type, handle, similarity, title, mode, handles). A row
    has the similarity that its paper last had before the section; ids go on
    after ``offset`` earlier sections. Empty sections have one row without handle.
    """
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) + offset
    sec = events.where("type = 'section'").select("run_id", "seq", number.alias("_n"), "title", F.coalesce("mode", F.lit("custom")).alias("mode"), F.size("handles").alias("n_total"), "handles")
    sec = sec.select("run_id", "seq", "_n", "title", "mode", "n_total", F.posexplode_outer("handles").alias("_p", "handle"))
    paper = events.where("type = 'paper' and similarity is not null").select("run_id", "handle", F.col("seq").alias("_at"), "similarity")
    hit = sec.join(paper, ["run_id", "handle"], "left").groupBy("run_id", "seq", "_n", "title", "mode", "n_total", "_p", "handle").agg(F.max_by(F.when(F.col("_at") < F.col("seq"), F.col("similarity")), F.when(F.col("_at") < F.col("seq"), F.col("_at"))).alias("similarity"))
    return hit.select("run_id", F.concat(F.lit("section-"), F.col("_n").cast("string")).alias("section"), "title", "mode", "n_total", (F.col("_p") + 1).alias("rank"), "handle", "similarity")


def best_similarities(rows: DataFrame) -> DataFrame:
    """(run_id, handle, max_similarity, sections): the least distance of each paper over its sections, and their ids joined by '|'."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.regexp_extract("section", r"(\d+)$", 1).cast("int").alias("n"), "section"))), lambda x: x["section"]), "|")
    return rows.where("handle is not null").groupBy("run_id", "handle").agg(F.min("similarity").alias("max_similarity"), ids.alias("sections"))


def bundle(events: DataFrame) -> DataFrame:
    """(run_id, papers, persons, n_sections, strategy, script, bibtex, synthesis): what a log adds up to.

    events: (run_id, seq, type, key, payload). The last event wins per paper,
    person, strategy, script and bibtex; synthesis deltas are joined in order.
    Without a bibtex event the papers' own entries are not made up here.
    """
    last = lambda t: F.max_by(F.when(F.col("type") == t, F.col("payload")), F.when(F.col("type") == t, F.col("seq")))
    n = lambda t: F.countDistinct(F.when(F.col("type") == t, F.col("key")))
    parts = F.sort_array(F.collect_list(F.when(F.col("type") == "synthesis", F.struct("seq", "payload"))))
    return events.groupBy("run_id").agg(
        n("paper").alias("papers"),
        n("person").alias("persons"),
        F.count(F.when(F.col("type") == "section", 1)).alias("n_sections"),
        last("strategy").alias("strategy"),
        last("script").alias("script"),
        last("bibtex").alias("bibtex"),
        F.array_join(F.transform(parts, lambda x: x["payload"]), "").alias("synthesis"),
    )


def merge_bibtex(a: Column, b: Column) -> Column:
    """Entries of two BibTeX texts, each cite-key once, the first wins; an entry without a key counts as its own text."""
    chunks = F.split(F.concat(F.coalesce(a, F.lit("")), F.lit("\n"), F.coalesce(b, F.lit(""))), r"(?m)(?=^@)")
    each = F.filter(F.transform(chunks, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    key = lambda x: F.coalesce(F.nullif(F.trim(F.regexp_extract(x, r"^@\w+\s*\{\s*([^,]+),", 1)), F.lit("")), x)
    keyed = F.transform(each, lambda x: F.struct(key(x).alias("k"), x.alias("e")))
    empty = F.array().cast("array<struct<k:string,e:string>>")
    kept = F.aggregate(keyed, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(F.transform(kept, lambda x: x["e"]), "\n")


def reduce_runs(events: DataFrame) -> DataFrame:
    """(run_id, stages, mode, papers, persons, sections, status): the state a viewer of the log ends in.

    events: (run_id, seq, type, key, payload). A "refine" event opens a round;
    with payload "replace" results before it are dropped, else they stay. Stages
    keep their last state, in the order they began. "done" and non-recoverable
    errors (payload "fatal") end the run; anything after that is ignored.
    """
    ends = events.where("type = 'done' or (type = 'error' and payload = 'fatal')").groupBy("run_id").agg(F.min("seq").alias("_end"), F.min_by("type", "seq").alias("_how"))
    cut = events.where("type = 'refine' and payload = 'replace'").groupBy("run_id").agg(F.max("seq").alias("_cut"))
    e = events.join(ends, "run_id", "left").where("_end is null or seq <= _end").join(cut, "run_id", "left")
    live = F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))
    n = lambda t: F.countDistinct(F.when((F.col("type") == t) & live, F.col("key")))
    stage = e.where("type = 'stage'").groupBy("run_id", "key").agg(F.min("seq").alias("_first"), F.max_by("payload", "seq").alias("_state"))
    stage = stage.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("_first", "key", "_state"))).alias("_st"))
    stage = stage.select("run_id", F.transform("_st", lambda x: F.concat(x["key"], F.lit("="), x["_state"])).alias("stages"))
    out = e.groupBy("run_id").agg(F.max_by(F.when(F.col("type") == "refine", F.col("payload")), F.when(F.col("type") == "refine", F.col("seq"))).alias("mode"), n("paper").alias("papers"), n("person").alias("persons"), F.count(F.when((F.col("type") == "section") & live, 1)).alias("sections"), F.first("_how").alias("_how"))
    status = F.when(F.col("_how") == "done", "done").when(F.col("_how") == "error", "error").otherwise("running")
    return out.join(stage, "run_id", "left").select("run_id", "stages", "mode", "papers", "persons", "sections", status.alias("status"))


def summarize(papers: DataFrame, section_rows: DataFrame, sample: int = 5) -> DataFrame:
    """(run_id, summary): titles and counts of the sections, and the first papers of each run as text lines.

    papers: (run_id, seq, title, journal, year); section_rows: (run_id, seq,
    title, kind, n_total). A run without sections or papers says so.
    """
    unit = F.when(F.col("kind") == "persons", "person(s)").otherwise("paper(s)")
    line = F.concat(F.lit('- "'), F.coalesce("title", F.lit("")), F.lit('": '), F.col("n_total").cast("string"), F.lit(" "), unit)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c.alias("l")))), lambda x: x["l"]), "\n")
    sec = section_rows.groupBy("run_id").agg(ordered(line).alias("_s"))
    first = papers.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).where(F.col("_r") <= sample)
    known = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), "?").otherwise(F.col(c).cast("string"))
    row = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), known("journal"), F.lit(", "), known("year"), F.lit(")"))
    few = first.groupBy("run_id").agg(ordered(row).alias("_p"))
    n = papers.groupBy("run_id").agg(F.count("*").alias("_n"))
    out = sec.join(few, "run_id", "full_outer").join(n, "run_id", "left")
    return out.select("run_id", F.concat(F.lit("Sections:\n"), F.coalesce("_s", F.lit("(no sections emitted)")), F.lit("\n\nDistinct papers: "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit("\n\nSample:\n"), F.coalesce("_p", F.lit("(none)"))).alias("summary"))


def preflight(brief: Column) -> Column:
    """NULL if a brief can be searched for, else why not: length 15 to 2000 after trimming, three words of three letters or more."""
    t = F.regexp_replace(F.coalesce(brief, F.lit("")), r"^\s+|\s+$", "")
    words = F.regexp_count(t, F.lit("[a-zA-ZÀ-öø-ÿ]{3,}"))
    return F.when(F.length(t) < 15, "short").when(F.length(t) > 2000, "long").when(words < 3, "unreadable")
