"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def sizing(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a table of this size, to pass to ``build_session``.

    Shuffles start with about 200 MB per partition, at least three partitions per
    core and not more than the shuffle bookkeeping bears: most shuffles here move
    combined counts, far less than the input, and whole rows spill. Adaptive
    execution merges what turns out small and splits skewed partitions. Scans read
    larger splits as the table grows, so that the number of tasks stays manageable.
    """
    mb = 1024 * 1024
    partitions = max(3 * cores, min(-(-input_bytes // (200 * mb)), 40_000))
    split = min(1024, max(128, -(-input_bytes // (mb * 50 * max(cores, 1)))))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.files.maxPartitionBytes": f"{split}m",
    }


def build_session(app: str = "incidentlake", master: str | None = None, **extra: str) -> SparkSession:
    """Session with adaptive execution on; a cluster passes its own master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="incidentlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end, not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` gave and nothing reads any more."""
    spark = df.sparkSession
    kept = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if kept.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for a table that a loop derives from itself: the estimate of its size starts anew, too.

    A join is estimated at the product of its sides, and a checkpoint keeps the estimate. In
    a loop its digits double with every round until they fill the driver's memory.
    """
    spark, kept = df.sparkSession, cut_lineage(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)
