"""Top values and top rows per group."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SENT_ROWS = 200_000  # a key, a group and two numbers each


def top_values(df: DataFrame, group: str, value: str, n: int = 5, name: str | None = None) -> DataFrame:
    """The ``n`` most frequent values per group as an ordered array (ties: alphabetical)."""
    return top_values_of(df, group, {name or f"top_{value}": (value, n)})


def top_values_of(df: DataFrame, group: str, wanted: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Several top lists per group from one scan: output name -> (column, length).

    Values are counted first, so the ranking window sees one row per (group,
    column, value); its rank filter also runs before the shuffle of that small
    table.
    """
    entries = F.array(*[
        F.struct(F.lit(name).alias("list"), F.col(c).cast("string").alias("value")) for name, (c, _) in wanted.items()
    ])
    rows = df.select(group, F.explode(entries).alias("e")).where(F.col("e.value").isNotNull())
    counts = rows.groupBy(group, F.col("e.list").alias("list"), F.col("e.value").alias("value")).agg(
        F.count("*").alias("n")
    )
    rank = F.row_number().over(Window.partitionBy(group, "list").orderBy(F.col("n").desc(), F.col("value").asc()))
    longest = max(n for _, n in wanted.values())
    best = counts.withColumn("rank", rank).where(F.col("rank") <= longest)

    def ordered(name: str, n: int):
        mine = (F.col("list") == name) & (F.col("rank") <= n)
        found = F.array_sort(F.collect_list(F.when(mine, F.struct("rank", "value"))))
        return F.transform(found, lambda x: x["value"]).alias(name)

    return best.groupBy(group).agg(*[ordered(name, n) for name, (_, n) in wanted.items()])


def most_frequent(df: DataFrame, group: str, value: str, name: str | None = None) -> DataFrame:
    """The most frequent value per group (ties: alphabetical)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    rank = F.struct(-F.col("n"), F.col(value).alias("value"))
    return counts.groupBy(group).agg(F.min(rank)["value"].alias(name or value))


def top_rows_per_group(
    df: DataFrame, group: str, order: str, n: int, key: str = "id", columns: tuple[str, ...] = ()
) -> DataFrame:
    """The ``n`` rows per group with the highest ``order`` (ties: lowest key); keys are unique.

    Rows are ranked without the further ``columns``, which a second scan fetches for the
    ranked keys alone: they are sent to the tasks if counted as few, else joined.
    """
    ranked = ranked_rows(df, group, order, n, key)
    if not columns:
        return ranked
    ranked = cut_lineage(ranked)
    few = ranked.count() <= SENT_ROWS
    return df.select(key, *columns).join(F.broadcast(ranked) if few else ranked, key).select(key, group, order, *columns, "rank")


def ranked_rows(df: DataFrame, group: str, order: str, n: int, key: str = "id") -> DataFrame:
    """(key, group, order, rank) of the ``n`` first rows per group.

    The rank filter runs inside every task before the shuffle, so a dominant group
    sends ``n`` rows per task.
    """
    by = Window.partitionBy(group).orderBy(F.col(order).desc(), F.col(key).asc())
    rows = df.where(F.col(group).isNotNull()).select(key, group, order)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
