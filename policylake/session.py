"""Session helpers: table access, the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def get_spark(app: str = "policylake", cpus: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every plan here expects (UTC, AQE)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session does not name one (local tests) a temporary folder is made,
    which is removed when the process ends.
    """
    global _LOCAL_DIR
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="policylake-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return "file://" + _LOCAL_DIR


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation, and later
    reads prune columns. Parquet with zstd keeps it small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/policylake/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Delete the files of tables written by ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[0].endswith("/policylake"):
                p = spark._jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it an action's shuffle files go when the action ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, a parquet file or folder ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bounded_rows(df: DataFrame, most: int) -> list | None:
    """All rows of ``df`` if there are at most ``most``, else None (never more than ``most + 1`` fetched)."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
