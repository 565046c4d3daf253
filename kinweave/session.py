"""Session defaults and tables staged between jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of staged tables; they are written once, read seldom, and lie beside shuffles and results.
CODEC = "zstd"


def build_session(app_name: str = "kinweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew splitting and UTC; cluster settings stay untouched."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for tables between jobs: the one the cluster names, else a folder of the warehouse."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set(CHECKPOINT_KEY, configured)
    return configured.rstrip("/")


_lock = threading.Lock()
_writing: list[str | None] = []


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end meanwhile are deleted with them, not when the driver happens to collect garbage.

    What a staged table was made of is never read again, so that disk holds the shuffles of one step, not of all."""
    with _lock:
        if not _writing:
            before = spark.conf.get(CLEANUP_KEY, None)
            spark.conf.set(CLEANUP_KEY, "true")
        else:
            before = _writing[0]
        _writing.append(before)
    try:
        yield
    finally:
        with _lock:
            before = _writing.pop()
            if not _writing:
                spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` as a columnar table in the shared checkpoint folder and read it back.

    Unlike ``checkpoint`` the result keeps column pruning, filter pushdown and size statistics,
    which later joins use to pick a strategy.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_end_here(spark):
        df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_by(df: DataFrame, key: str, label: str = "staged") -> DataFrame:
    """``stage`` as a table bucketed by ``key``: grouping by it, and joins of tables so bucketed, move no rows."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    count = buckets(spark)
    writer = df.repartition(count, key).write.format("parquet").option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
    with shuffles_end_here(spark):
        writer.option("compression", CODEC).bucketBy(count, key).saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stage_by`` wrote, once all that is made of it has been written out itself."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/"
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        name = parent.rpartition("/")[2]
        if not name.isidentifier() or not spark.catalog.tableExists(name):
            raise ValueError(f"{parent} is no table of {folder}")
        spark.sql(f"DROP TABLE `{name}`")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder + name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_all(tables: dict[str, DataFrame], by: str | None = None) -> dict[str, DataFrame]:
    """``stage`` (``stage_by`` where a key is given) for several independent tables; their jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=min(8, max(1, len(tables)))) as pool:
        running = {n: pool.submit(stage, df, n) if by is None else pool.submit(stage_by, df, by, n) for n, df in tables.items()}
        return {name: job.result() for name, job in running.items()}

