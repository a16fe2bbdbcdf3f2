"""Session helpers shared by the jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewest rows of a task that `spread` makes.
TASK_ROWS = 512


def local_session(cores: str = "*", name: str = "foldcurve") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FOLDCURVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    The folder is the one the cluster names in spark.checkpoint.dir. Only a
    local session may fall back to a temporary folder: on a cluster that folder
    would exist on one machine alone.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="foldcurve-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(held: DataFrame, key: str) -> DataFrame:
    """The written rows in tasks for all cores, where they lie in fewer and are enough for more.

    Spark joins small shuffle blocks to few tasks by their bytes. Rows that many passes of
    array work read are small and costly: one task for all of them would leave the other cores idle.
    """
    n, last = held.select(F.spark_partition_id().alias("task")).agg(F.count("task"), F.max("task")).first()
    wanted = min(2 * held.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    return held if wanted <= (last or 0) + 1 else cut_lineage(held.repartition(wanted, key))
