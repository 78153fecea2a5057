"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hub vertices make hot join keys; AQE splits their partitions on both sides.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Hash instead of sort joins, but only where AQE has measured every partition.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "kinweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Where neither ``spark.checkpoint.dir`` nor an earlier ``setCheckpointDir`` call named
    one, a local session gets a folder of its own that goes when the program ends; on a
    cluster that is an error, as executors don't see each other's disks.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or _own_folder(context.master))
    return (configured or context.getCheckpointDir()).rstrip("/")


def _own_folder(master: str) -> str:
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(
            f"Set spark.checkpoint.dir to a folder that all executors share (master {master})."
        )
    folder = tempfile.mkdtemp(prefix="kinweave-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows over all shuffle partitions by key, ahead of a step that multiplies them.

    AQE sizes partitions by the rows that go into a stage. A small table that is about
    to grow a hundredfold would end up in a few tasks; a fixed count is left alone.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism), *keys)


#: Set, a query removes its shuffle files at its end; otherwise they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what is planned inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder.

    What was shuffled for it is not needed again and leaves the disk.
    """
    shared_dir(df.sparkSession)
    with setting(df.sparkSession, FREE_SHUFFLES, "true"):
        return df.select("*").checkpoint(eager=True)


def materialise_dealt(df: DataFrame) -> DataFrame:
    """``materialise`` for rows dealt out by ``spread``: joins by its keys find them in place.

    Spark knows of a checkpoint how it is dealt out only if its plan was fixed beforehand.
    """
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return materialise(df)
