"""Usage analytics over event logs: (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    return df.where((F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= as_of))


def log_stats(events: DataFrame, averages: dict[str, str], counters: dict[str, Column]) -> DataFrame:
    """One row: total, the averages by name (NULLs skipped), and how many rows meet each counter's condition."""
    return events.agg(F.count("*").alias("total"), *[F.avg(c).alias(n) for n, c in averages.items()], *[F.count(F.when(c, 1)).alias(n) for n, c in counters.items()])


def day_log(df: DataFrame, day: Column, ts: str = "ts") -> DataFrame:
    """Rows of [day, day + 1)."""
    d = day.cast("date").cast("timestamp_ntz")
    return df.where((F.col(ts) >= d) & (F.col(ts) < d + F.make_dt_interval(F.lit(1))))


def run_stats(runs: DataFrame) -> DataFrame:
    """(status, n, clarified, refined): runs by status, and a row for all (status NULL) with those that were clarified or refined."""
    q = F.count(F.when(F.col("clarify_question").isNotNull(), 1))
    r = F.count(F.when(F.col("refine"), 1))
    by = runs.groupBy("status").agg(F.count("*").alias("n")).where("status is not null").withColumns({"clarified": F.lit(None).cast("long"), "refined": F.lit(None).cast("long")})
    return runs.agg(F.lit(None).cast("string").alias("status"), F.count("*").alias("n"), q.alias("clarified"), r.alias("refined")).unionByName(by)


def run_log(runs: DataFrame) -> DataFrame:
    """(id, created_at, status, brief, refine, clarified, n_events, has_synthesis) of (…, events as a JSON array); broken or NULL events count 0."""
    n = F.coalesce(F.json_array_length("events"), F.lit(0))
    return runs.select("id", "created_at", "status", "brief", F.coalesce("refine", F.lit(False)).alias("refine"), F.col("clarify_question").isNotNull().alias("clarified"), n.alias("n_events"), (F.coalesce(F.length("synthesis"), F.lit(0)) > 0).alias("has_synthesis"))


def append_log(log: DataFrame, new: DataFrame, *order: Column, handles: str = "handles", top: int = 3) -> DataFrame:
    """The log with new rows numbered on from its largest search_id; their handles are cut to the first ``top``.

    ``new`` is one batch of a writer: small enough for one task.
    """
    last = F.lit(log.agg(F.max("search_id")).first()[0] or 0)
    rows = new.withColumn("search_id", (F.row_number().over(Window.orderBy(*order)) + last).cast("long")).withColumn(f"top{top}_handles", F.slice(handles, 1, top)).drop(handles)
    return log.unionByName(rows.select(*log.columns))


def claim(store: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, claimed ids): unknown ids are inserted as running, failed ones are reset to running; all others stay and are not claimed.

    ``wanted``: (id, brief). An id wanted twice is claimed once, by its smallest
    brief. One writer applies a batch: concurrency is the store's matter.
    """
    want = wanted.where("id is not null").groupBy("id").agg(F.min("brief").alias("_b"))
    x = store.join(want, "id", "full_outer")
    new, failed = F.col("status").isNull(), F.col("_b").isNotNull() & (F.col("status") == "error")
    hit = F.col("_b").isNotNull() & (new | F.coalesce(failed, F.lit(False)))
    keep = {"status": F.when(hit, "running").otherwise(F.col("status")), "brief": F.when(new, F.col("_b")).otherwise(F.col("brief"))}
    wiped = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in ("events", "synthesis", "clarify_question", "clarify_answer") if c in store.columns}
    return x.withColumns({**keep, **wiped}).select(*store.columns), x.where(hit).select("id")


def rate_limits(events: DataFrame, per_hour: dict[str, int], per_day: dict[str, int], concurrent: dict[str, int] | None = None) -> DataFrame:
    """(event_id, accepted, reason): fixed windows by (user, class) of (event_id, ts, user_id, class, until).

    Only accepted events count against a limit, so hours are filled first and
    days count the accepted ones of their hours. Events of an unlimited class
    are accepted. With ``concurrent``, an event is refused while as many of the
    user's earlier events of the class still run (``until`` after ``ts``);
    that gauge counts all earlier events, refused ones do not run and must
    have a NULL ``until``.
    """
    lim = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col("class")] if d else F.lit(None).cast("int")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = events.withColumns({"_h": F.floor(sec / 3600), "_d": F.floor(sec / 86400), "_lh": lim(per_hour), "_ld": lim(per_day), "_lc": lim(concurrent or {})})
    e = e.withColumn("_busy", F.lit(False))
    if concurrent:
        # a running sum of begins and ends; at one moment ends come first
        begin = e.select("user_id", "class", "ts", F.lit(1).alias("_k"), "event_id", F.when(F.col("until").isNotNull(), 1).otherwise(0).alias("_x"))
        end = e.where("until is not null").select("user_id", "class", F.col("until").alias("ts"), F.lit(0).alias("_k"), "event_id", F.lit(-1).alias("_x"))
        before = Window.partitionBy("user_id", "class").orderBy("ts", "_k", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        running = begin.unionByName(end).withColumn("_run", F.coalesce(F.sum("_x").over(before), F.lit(0))).where("_k = 1").select("event_id", "_run")
        e = e.join(running, "event_id").withColumn("_busy", F.coalesce(F.col("_run") >= F.col("_lc"), F.lit(False)))
    free = Window.partitionBy("user_id", "class", "_busy", "_h").orderBy("ts", "event_id")
    e = e.withColumn("_full", ~F.col("_busy") & F.coalesce(F.row_number().over(free) > F.col("_lh"), F.lit(False)))
    day = Window.partitionBy("user_id", "class", "_busy", "_full", "_d").orderBy("ts", "event_id")
    e = e.withColumn("_over", ~F.col("_busy") & ~F.col("_full") & F.coalesce(F.row_number().over(day) > F.col("_ld"), F.lit(False)))
    reason = F.when(F.col("_busy"), "concurrent").when(F.col("_full"), "hour").when(F.col("_over"), "day")
    return e.select("event_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def daily_hosts(log: DataFrame) -> DataFrame:
    """(day, n, hosts): requests and distinct addresses per day, counted in two steps so that no day is gathered."""
    n = log.groupBy(F.to_date("ts").alias("day"), "ip").agg(F.count("*").alias("n"))
    return n.groupBy("day").agg(F.sum("n").alias("n"), F.count("ip").alias("hosts"))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def daily(df: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, n, users, change): per-day counts and the change to the day before."""
    d = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    # one row per day: small enough for one task
    return d.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("day")))


def rate_limit(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Fixed windows: each event with its number in the user's window and whether it is accepted."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    w = Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    return events.withColumn("slot", slot).withColumn("in_window", F.row_number().over(w)).withColumn("accepted", F.col("in_window") <= limit)


def sweep(runs: DataFrame, as_of: Column, hours: int, waiting: str, failed: str) -> DataFrame:
    """Runs that have waited longer than ``hours`` get the failed status."""
    old = (F.col("status") == waiting) & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return runs.withColumn("status", F.when(old, failed).otherwise(F.col("status")))


def first_write_wins(store: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """The store plus new rows of unknown keys, the first of each."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = new.join(store.select(key).distinct(), key, "left_anti").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return store.unionByName(fresh)
