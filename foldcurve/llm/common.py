"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts count it; a word is a run of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"

CHECKPOINT_DIR = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="foldcurve-llm-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the one all executors share.

    spark.checkpoint.dir names it. Where that is unset, as in tests, a session
    on one machine may use a temporary folder; a cluster may not.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = own_folder()
    return f"{root.rstrip('/')}/foldcurve-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: its lineage ends there.

    Lost executors cost nothing that is in the table, and the shuffle files of the job that made it go
    when it has been written. The folder stays until the owner of spark.checkpoint.dir clears it.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class shuffles_dropped:
    """Within it, Spark drops the shuffle files of a job at the job's end."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, "false")
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.before)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what its owner sized to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """Words of a text column; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
