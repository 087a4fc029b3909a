"""Filter, search, sort, page and look up incidents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import UNKNOWN
from ..session import cut_lineage

LIST_COLUMNS = (
    "id", "date", "location", "operator", "aircraft_type", "fatalities",
    "severity_label", "cluster_id", "aboard", "summary",
)
SEARCHED = ("operator", "aircraft_type", "location", "summary")
SORT_KEYS = {
    "date": "date", "operator": "operator", "aircraft": "aircraft_type", "location": "location",
    "severity": "severity_label", "fatalities": "fatalities", "aboard": "aboard",
}
MAX_PAGE_SIZE = 100
# Every task of a top-k hands its k keys to one merging task, so only slices that end
# this near the start are found that way; all others are located by counting.
HEAP_REACH = 200


def check_range(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be in [{low}, {high if high is not None else 'inf'}], got {value}")
    return value


def by_severity(df: DataFrame, severity: str | None) -> DataFrame:
    return df if not severity or severity == "All" else df.where(F.col("severity_label") == severity)


def by_decade(df: DataFrame, decade: str | None) -> DataFrame:
    """Years of a decade such as ``1980s``; text that is no decade filters nothing.

    A table stored by decade is pruned to the partitions the years lie in.
    """
    if not decade or decade == "All":
        return df
    try:
        start = int(decade.replace("s", ""))
    except ValueError:
        return df
    if "decade" in df.columns:
        df = df.where(F.col("decade").between(start - start % 10, start + 9))
    return df.where(F.col("year").between(start, start + 9))


def by_term(df: DataFrame, term: str | None, escape: bool = False) -> DataFrame:
    """Case-insensitive substring in operator, aircraft, location or summary.

    ``%`` and ``_`` typed by the user act as wildcards unless ``escape`` is set.
    """
    term = (term or "").strip()
    if not term:
        return df
    pattern = term.replace("\\", "\\\\")
    if escape:
        pattern = pattern.replace("%", "\\%").replace("_", "\\_")
    return df.where(reduce(or_, [F.col(c).ilike(f"%{pattern}%") for c in SEARCHED if c in df.columns]))


def select_incidents(
    df: DataFrame, severity: str | None = None, decade: str | None = None,
    term: str | None = None, escape: bool = False,
) -> DataFrame:
    return by_term(by_decade(by_severity(df, severity), decade), term, escape)


def sort_columns(sort_key: str = "date", sort_dir: str = "desc") -> list[Column]:
    """Whitelisted key plus id, so that pages never overlap; unknown keys mean date."""
    if sort_dir not in ("asc", "desc"):
        raise ValueError(f"sort_dir must be asc or desc, got {sort_dir!r}")
    key = F.col(SORT_KEYS.get(sort_key, "date"))
    return [key.asc() if sort_dir == "asc" else key.desc(), F.col("id").asc()]


def search_incidents(
    df: DataFrame, severity: str | None = None, decade: str | None = None, term: str | None = None,
    sort_key: str = "date", sort_dir: str = "desc", page: int = 1, page_size: int = 12,
    escape: bool = False,
) -> DataFrame:
    """One page of matching incidents as list rows.

    A page finds its ids on the two sort columns alone and then fetches only those rows.
    """
    check_range("page", page, 1)
    check_range("page_size", page_size, 1, MAX_PAGE_SIZE)
    order = sort_columns(sort_key, sort_dir)
    hits = select_incidents(df, severity, decade, term, escape)
    skip = (page - 1) * page_size
    ids = ordered_slice(hits.select("id", SORT_KEYS.get(sort_key, "date")), order, page_size, skip).select("id")
    # At most MAX_PAGE_SIZE ids.
    return df.join(F.broadcast(ids), "id", "left_semi").orderBy(*order).select(*LIST_COLUMNS)


def ordered_slice(df: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` in order; ``df`` holds no more than keys, ``order`` ends with a unique one."""
    return first_rows(df, order, n, skip) if skip + n <= HEAP_REACH else deep_rows(df, order, n, skip)


def first_rows(df: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` in order, through one heap of ``skip + n`` rows per task."""
    return df.orderBy(*order).offset(skip).limit(n)


def deep_rows(df: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """The same rows, any number of them and anywhere, without sending them through one task.

    The keys are range-partitioned and stored, the partitions counted, and only
    the partitions that hold the rows are ranked, each by itself.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = cut_lineage(df.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    holding = starts.where((F.col("_start") < skip + n) & (F.col("_start") + F.col("_n") > skip))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per range partition at most.
    return (
        placed.join(F.broadcast(holding), "_part").withColumn("_place", place)
        .where((F.col("_place") > skip) & (F.col("_place") <= skip + n)).select(*df.columns)
    )


def page_info(df: DataFrame, page_size: int = 12) -> DataFrame:
    """Number of hits and of pages (at least one)."""
    check_range("page_size", page_size, 1, MAX_PAGE_SIZE)
    pages = F.greatest(F.lit(1), F.ceil(F.count("*") / page_size)).cast("bigint")
    return df.agg(F.count("*").alias("total"), pages.alias("total_pages"))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with this key; none when it is missing."""
    return df.where(F.col(key) == F.lit(value))


def table_rows(df: DataFrame) -> DataFrame:
    """List rows with the defaults a table view shows."""
    def default(c: str, value: object) -> Column:
        return F.coalesce(F.col(c), F.lit(value))

    return df.select(
        "id", default("date", "").alias("date"), default("operator", UNKNOWN).alias("operator"),
        default("aircraft_type", UNKNOWN).alias("aircraft"), default("location", UNKNOWN).alias("location"),
        default("fatalities", 0.0).alias("fatalities"), default("aboard", 0.0).alias("aboard"),
        default("severity_label", UNKNOWN).alias("severity"), default("summary", "").alias("summary"),
        default("cluster_id", -1).alias("cluster"),
        *[default(c, v).alias(c) for c, v in (
            ("predicted_severity", ""), ("prediction_confidence", 0.0),
            ("extracted_cause_category", ""), ("extracted_phase_of_flight", ""),
        ) if c in df.columns],
    )


def projection_points(df: DataFrame, limit: int = 2000) -> DataFrame:
    """Located points for a scatter plot, lowest ids first."""
    check_range("limit", limit, 100, 5000)
    located = df.where(F.col("proj_x").isNotNull() & F.col("proj_y").isNotNull()).select(
        "id", "proj_x", "proj_y", "cluster_id", "severity_label", "fatalities", "year", "operator"
    )
    ids = ordered_slice(located.select("id"), [F.col("id").asc()], limit)
    return (
        located.join(F.broadcast(ids), "id", "left_semi").orderBy("id")  # at most 5000 ids
        .select(
            "id", F.round("proj_x", 4).alias("x"), F.round("proj_y", 4).alias("y"),
            F.coalesce("cluster_id", F.lit(-1)).alias("cluster"),
            C.or_text(F.col("severity_label"), UNKNOWN).alias("severity"),
            F.coalesce(F.col("fatalities").cast("int"), F.lit(0)).alias("fatalities"),
            F.coalesce("year", F.lit(0)).alias("year"),
            C.or_text(F.col("operator"), UNKNOWN).alias("operator"),
        )
    )


def point_labels(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Scatter points with the display label of their cluster."""
    labels = clusters.select(
        F.col("cluster_label").alias("cluster"), cluster_name(F.col("cluster_label")).alias("cluster_name")
    )
    return points.join(labels, "cluster", "left").withColumn(
        "cluster_name", F.coalesce("cluster_name", cluster_name(F.lit(None).cast("int")))
    )


def cluster_name(label: Column) -> Column:
    return F.when(label.isNull(), "Unknown Cluster").otherwise(F.concat(F.lit("Cluster "), label.cast("string")))


def pending_extraction(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Reports with text but no extracted cause, deadliest first.

    ``None`` returns the whole queue (left unordered: order matters only for a
    cut), ``0`` skips the step.
    """
    queue = df.where(F.col("summary").isNotNull() & F.col("extracted_cause_category").isNull())
    if limit is None:
        return queue
    order = [F.col("fatalities").desc(), F.col("id").asc()]
    ids = ordered_slice(queue.select("id", "fatalities"), order, check_range("limit", limit, 0)).select("id")
    return df.join(ids, "id", "left_semi")


def even_years(yearly: DataFrame, since: int = 1930) -> DataFrame:
    """Chart sampling: every second year from ``since`` on."""
    return yearly.where((F.col("year") >= since) & (F.col("year") % 2 == 0))
