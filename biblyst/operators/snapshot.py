"""Diffs between snapshots of a table, their application, and keyed patches."""

from __future__ import annotations

import json
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(base: DataFrame, update: DataFrame, keys: list[str], ignore: tuple[str, ...] = (), edges: bool = False) -> DataFrame:
    """Rows of ``update`` that are NEW or UPDATE, and of ``base`` that are DELETE, with an ``operation`` column.

    Schemas must agree in names and order. One full outer join on the keys
    serves all three; keys must be unique and not NULL. Ignored columns make no
    UPDATE but travel with it. Edge tables (all columns are keys) have no UPDATE.
    """
    if base.columns != update.columns:
        raise ValueError(f"schemas differ: {base.columns} and {update.columns}")
    payload = [c for c in base.columns if c not in keys and c not in ignore]
    b = base.select(*keys, F.struct(*base.columns).alias("_b"))
    u = update.select(*keys, F.struct(*update.columns).alias("_u"))
    both = b.join(u, keys, "full_outer")
    changed = F.lit(False)
    for c in payload:
        changed = changed | ~F.col(f"_b.{c}").eqNullSafe(F.col(f"_u.{c}"))
    op = F.when(F.col("_b").isNull(), "NEW").when(F.col("_u").isNull(), "DELETE").when(changed & F.lit(not edges), "UPDATE")
    out = both.withColumn("operation", op).where("operation is not null")
    return out.withColumn("_x", F.when(F.col("operation") == "DELETE", F.col("_b")).otherwise(F.col("_u"))).select("_x.*", "operation")


def apply_diff(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` without the keys of the changes, plus their NEW and UPDATE rows in the target's columns."""
    kept = target.join(changes.select(*keys).distinct(), keys, "left_anti")
    new = changes.where("operation in ('NEW', 'UPDATE')").select(*[c if c in changes.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return kept.unionByName(new)


def check_patch(patch: DataFrame, keys: list[str]) -> None:
    missing = [k for k in keys if k not in patch.columns]
    if missing:
        raise ValueError(f"missing key {missing}")
    if patch.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("keys are not unique")


def apply_patch(target: DataFrame, patch: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """update_columns: patched columns of matching rows, NULLs included; upsert_rows: rows by key; replace_table: the patch."""
    if mode == "replace_table":
        return patch.select(*target.columns)
    unknown = [c for c in patch.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    if mode == "upsert_rows":
        return apply_diff(target, patch.withColumn("operation", F.lit("NEW")), keys)
    if mode != "update_columns":
        raise ValueError(f"unknown mode {mode}")
    new = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in new], F.lit(True).alias("_m"))
    out = target.join(p, keys, "left")
    return out.select(*[F.when(F.col("_m"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns])


MODES = ("update_columns", "upsert_rows", "replace_table")


def write_patch(patch: DataFrame, path: str, table: str, mode: str, keys: list[str]) -> None:
    """Parquet with a manifest beside it. Keys must be unique and not NULL."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode != "replace_table":
        check_patch(patch, keys)
        if patch.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count():
            raise ValueError("keys are missing")
    patch.write.mode("overwrite").parquet(f"{path}/rows")
    Path(path, "manifest.json").write_text(json.dumps({"table": table, "mode": mode, "keys": keys, "columns": patch.columns}))


def read_patch(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, manifest); a manifest that lacks a field, names an unknown mode or is no plain identifier is an error."""
    m = json.loads(Path(path, "manifest.json").read_text())
    missing = [f for f in ("table", "mode", "keys") if f not in m]
    if missing:
        raise ValueError(f"manifest lacks {missing}")
    if m["mode"] not in MODES:
        raise ValueError(f"unknown mode {m['mode']}")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", m["table"]):
        raise ValueError("the table is no identifier")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", Path(path).name) or ".." in Path(path).name:
        raise ValueError("unsafe name of a patch")
    return spark.read.parquet(f"{path}/rows"), m


def apply_pending(tables: dict[str, DataFrame], folder: str, applied: set[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, names): all patches of a folder in the order of their names, those already applied left out.

    Nothing is written: the caller dumps the tables and the names together, as
    one snapshot, so a failure leaves the old one in place.
    """
    out, done = dict(tables), []
    for path in sorted(p.parent for p in Path(folder).glob("*/manifest.json")):
        if path.name in applied:
            continue
        spark = next(iter(out.values())).sparkSession if out else SparkSession.active()
        rows, m = read_patch(spark, str(path))
        if m["table"] not in out and m["mode"] != "replace_table":
            raise ValueError(f"{path.name} targets the missing table {m['table']}")
        out[m["table"]] = rows if m["mode"] == "replace_table" else apply_patch(out[m["table"]], rows, m["mode"], m["keys"])
        done.append(path.name)
    return out, done


def newest_diff(folder: str, tables: list[str]) -> dict[str, str]:
    """Path by table of the newest complete set of files diff_<table>_<base>_<update>.parquet; a set that lacks a table is passed over."""
    found: dict[tuple[str, str], dict[str, str]] = {}
    for p in Path(folder).glob("diff_*.parquet"):
        m = re.fullmatch(r"diff_(\w+?)_(\d{8}(?:T\d{6})?)_(\d{8}(?:T\d{6})?)\.parquet", p.name)
        if m:
            found.setdefault((m.group(3), m.group(2)), {})[m.group(1)] = str(p)
    whole = [k for k, v in found.items() if set(tables) <= set(v)]
    if not whole:
        raise FileNotFoundError("no complete set of diffs")
    return {t: found[max(whole)][t] for t in tables}


def migrate_users(source: dict[str, DataFrame], target: dict[str, DataFrame], sequences: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(tables, next numbers): user tables copied behind those of the target, numbering restarted after the largest.

    Columns are matched by name; the rows of both must be kept, else an error.
    """
    out, following = {}, {}
    for name, df in source.items():
        both = df if name not in target else target[name].unionByName(df, allowMissingColumns=True)
        want = df.count() + (target[name].count() if name in target else 0)
        if both.count() != want:
            raise ValueError(f"rows of {name} were lost")
        out[name] = both
        if name in sequences:
            following[name] = int(both.agg(F.max(sequences[name])).first()[0] or 0) + 1
    return out, following


def set_key(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """A (key, value) table with one key set anew."""
    new = metadata.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return metadata.where(F.col("key") != key).unionByName(new)


def split_rows(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``df`` with a part 0..parts-1 of about equal size, by ranges of the keys: every row in exactly one part, and no row gathered."""
    if parts < 1:
        raise ValueError("at least one part")
    return df.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())


def migrate(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with the columns of the schema that it lacks, as typed NULLs; nothing is dropped."""
    for c, t in schema.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


class Snapshots:
    """Immutable snapshots of tables under one folder; a pointer file names the current one and is swapped by renaming."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, Path(root)

    def dump(self, tables: dict[str, DataFrame], stamp: str, allowed: list[str] | None = None) -> None:
        """Write the tables (those of the allow-list, if there is one) and make the stamp the current one."""
        for name, df in tables.items():
            if allowed is not None and name not in allowed:
                continue
            df.write.mode("overwrite").parquet(str(self.root / f"snapshot={stamp}" / name))
        self.root.mkdir(parents=True, exist_ok=True)
        tmp = self.root / "current.tmp"
        tmp.write_text(stamp)
        tmp.replace(self.root / "current")

    def stamps(self) -> list[str]:
        return sorted(p.name.split("=", 1)[1] for p in self.root.glob("snapshot=*"))

    def current(self) -> str:
        return (self.root / "current").read_text().strip()

    def stale(self, now: str, days: int = 7) -> bool:
        """Whether the current stamp (YYYYMMDD...) is more than ``days`` days before ``now``."""
        day = lambda s: datetime.strptime(s[:8], "%Y%m%d")
        return (day(now) - day(self.current())).days > days

    def restore(self, schemas: dict[str, dict[str, str]], stamp: str | None = None) -> dict[str, DataFrame]:
        """Tables of a stamp (the latest if none is given) by name: columns of the schema cast to it or added as NULLs, others kept."""
        at = stamp or max(self.stamps())
        out = {}
        for name, schema in schemas.items():
            if not (self.root / f"snapshot={at}" / name).exists():
                continue
            df = migrate(self.table(name, at), schema)
            out[name] = df.withColumns({c: F.col(c).cast(t) for c, t in schema.items()})
        return out

    def table(self, name: str, stamp: str | None = None) -> DataFrame:
        return self.spark.read.parquet(str(self.root / f"snapshot={stamp or self.current()}" / name))

    def counts(self, names: list[str], stamp: str | None = None) -> DataFrame:
        """(table_name, n_rows, share): row counts and their share of all rows."""
        out = None
        for n in names:
            one = self.table(n, stamp).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
            out = one if out is None else out.unionByName(one)
        total = out.agg(F.sum("n_rows").alias("t"))
        return out.join(F.broadcast(total)).select("table_name", "n_rows", (F.col("n_rows") / F.col("t")).alias("share"))
