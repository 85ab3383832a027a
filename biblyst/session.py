"""Session defaults and lineage cutting.

``materialize`` is the only way the library cuts lineage: it writes a parquet
table into the shared folder named by ``spark.checkpoint.dir`` and reads it
back, so a lost executor costs a re-read, never a recomputation that depends
on executor-local blocks.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table whose rows are small (< 1 kB) may be broadcast.
BROADCAST_ROWS = 200_000


def build_session(cpus: int | str = "*", app: str = "biblyst", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application's tables in the shared folder of the cluster.

    Where spark.checkpoint.dir is unset a local session gets a private folder,
    removed when Python ends; on a cluster that is an error, since executors do
    not share the driver's disk.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if where:
        return f"{where.rstrip('/')}/biblyst-{sc.applicationId}"
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="biblyst-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return jsc.getCheckpointDir().get().rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Remove the tables that ``materialize`` has written so far; call it when no result that reads them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        for x in fs.listStatus(path):
            fs.delete(x.getPath(), True)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, unchanged otherwise.

    Counts ``df``; give it a materialized table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they were started. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_biblyst_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="biblyst-")) / "biblyst.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._biblyst_shipped = True
