"""Writers: back-fill columns, replace tables and runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import decade_of


def one_per_key(updates: DataFrame, key: str, cols: Sequence[str], order: str = "order") -> DataFrame:
    """One row per key: the one with the highest ``order``, without that column the largest by its values.

    Rows are combined per task before they meet, so a key with many updates is no hot task.
    """
    row = F.struct(*cols)
    by = F.struct(order, *cols) if order in updates.columns else row
    return updates.groupBy(key).agg(F.max_by(row, by).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in cols])


def backfill(df: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Take ``cols`` from ``updates`` where a key has a row there; other rows stay as they are.

    Of several updates for a key one counts, see ``one_per_key``. The result is a new table version:
    write it to a path of its own, never over the one it was read from.
    """
    fresh = one_per_key(updates, key, cols).select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = df.join(fresh, key, "left")
    kept = [F.col(c) for c in df.columns if c not in cols]
    types = dict(updates.select(*cols).dtypes)
    new = [
        F.when(F.col("_hit"), F.col(f"_{c}"))
        .otherwise(F.col(c) if c in df.columns else F.lit(None).cast(types[c])).alias(c)
        for c in cols
    ]
    return joined.select(*kept, *new)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), **options: str) -> None:
    """Replace the whole table at ``path``; ``read_table`` reads it.

    ``options`` are those of the parquet writer. The rows go to a new version folder, then one row is appended to the pointer table
    beside it. A write that fails leaves the earlier version current, and ``df`` may read
    the table it replaces. Earlier versions stay until somebody removes them.
    """
    version = f"version-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).options(**options).parquet(f"{path}/{version}")
    pointer = df.sparkSession.range(1).select(F.lit(time.time_ns()).alias("written"), F.lit(version).alias("version"))
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointer")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The current version of a table that ``replace_table`` wrote.

    A partitioned table without rows has no files, so it is read with its ``schema``.
    """
    current = spark.read.parquet(f"{path}/pointer").agg(F.max_by("version", "written").alias("version")).first()["version"]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{current}")


def replace_run(df: DataFrame, path: str, run_id: int) -> None:
    """Replace the rows of one run; other runs stay untouched. ``read_runs`` reads them.

    The rows go to a folder of their own; then one row is appended to the manifest, which
    names the folder of the run. A write that fails leaves the earlier rows current, and a
    run may be read, and be the source of ``df``, while it is replaced.
    """
    rows = df.drop("run_id").withColumn("run_id", F.lit(run_id).cast("bigint"))
    folder = f"run-{run_id}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/data/{folder}")
    _name_run(df.sparkSession, path, run_id, folder)


def _name_run(spark: SparkSession, path: str, run_id: int, folder: str | None) -> None:
    row = spark.range(1).select(F.lit(time.time_ns()).alias("written"), F.lit(run_id).cast("bigint").alias("run_id"), F.lit(folder).cast("string").alias("folder"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def current_runs(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of every run, by the last row of the manifest that names it."""
    last = F.max_by(F.struct("folder"), F.struct("written", "folder")).alias("last")
    named = spark.read.parquet(f"{path}/manifest").groupBy("run_id").agg(last).where("last.folder is not null")
    return {r["run_id"]: r["last"]["folder"] for r in named.collect()}


def read_runs(spark: SparkSession, path: str, *run_ids: int) -> DataFrame:
    """Rows of the named runs, of all without a name; runs that were never stored have none."""
    known = current_runs(spark, path)
    folders = [f"{path}/data/{f}" for run, f in sorted(known.items()) if not run_ids or run in run_ids]
    if folders:
        return spark.read.parquet(*folders)
    if not known:
        raise FileNotFoundError(f"no run is stored under {path}")
    return spark.read.parquet(f"{path}/data/{next(iter(known.values()))}").limit(0)


def forget_run(spark: SparkSession, path: str, run_id: int) -> None:
    """Leave a run out from now on; its files stay until ``delete_unnamed``."""
    _name_run(spark, path, run_id, None)


def delete_unnamed(spark: SparkSession, path: str, hours: float = 24.0) -> list[str]:
    """Delete the folders of replaced, forgotten and unfinished runs that are older than ``hours``; their names.

    The age keeps what a reader or a writer at work still needs.
    """
    named = set(current_runs(spark, path).values())
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(f"{path}/data")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = (time.time() - hours * 3600) * 1000, []
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name not in named and status.getModificationTime() <= before:
            system.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def store_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Store a table so that joins on its key need no shuffle: rows lie in ``buckets`` files by the key's hash, sorted by it.

    The bucketing is known to the session's catalog under ``name``; ``open_bucketed``
    makes it known to another session.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # one task per bucket, so that a bucket is one sorted file
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").format("parquet").saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """The table that ``store_bucketed`` wrote, with its buckets."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def backfill_bucketed(df: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], buckets: int) -> DataFrame:
    """``backfill`` for a table of ``store_bucketed``: the updates alone are shuffled, to the table's buckets."""
    return backfill(df.hint("merge"), one_per_key(updates, key, cols).repartition(buckets, key), key, cols)


def write_incidents(df: DataFrame, path: str) -> None:
    """Store incidents by decade, so that searches by decade read only their files.

    The rebalancing step splits a decade that holds most rows over many files and
    keeps small decades from being scattered.
    """
    rows = df.withColumn("decade", decade_of(F.col("year")))
    rows.hint("rebalance", "decade").write.mode("overwrite").partitionBy("decade").parquet(path)


def write_coordinates(df: DataFrame, path: str, run_id: int, key: str = "id") -> None:
    """Store the plot coordinates of one run."""
    replace_run(df.select(key, "proj_x", "proj_y"), path, run_id)
