"""Session settings and shared scratch tables used by every job."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def build_session(app: str = "rftspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; explicit ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names.

    A session on one machine without such a setting gets a private folder; on a cluster a
    missing setting is an error, because executors do not see each other's disks.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rftspark-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_root(spark).rstrip('/')}/rftspark/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are the writer's.

    Used where a later stage must see exactly the rows and partition numbers of an
    earlier one, also after executors were lost: the files outlive them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session setting for the jobs that run inside the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Give rows of a table of few files to all cores before expensive work, at most ``rows`` to a task.

    For tables as they are read: only their rows are counted, which Parquet footers tell, and only the
    columns that a job goes on to use are moved. Tables of as many files as cores stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, -(-df.count() // rows)))
