"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a slice of time; entries and captures meet by pattern and slice, which spreads busy hosts.
SLICE_DAYS = 30


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a final dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, at least "/"."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_patterns(url: Column) -> Column:
    """Every pattern that matches a URL: its host and parent domains, and host with each leading part of the path."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host != "", F.concat(F.transform(domains, lambda d: F.concat(F.lit("domain:"), d)),
                                       F.transform(prefixes, lambda p: F.concat(F.lit("prefix:"), p)))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): when each pattern is on a list.

    ``entries`` has list, kind ("domain" or "prefix"), pattern, day and action ("add" or
    "remove"). Within a list and pattern an entry holds from its day to the day before the
    next one; the last has no end (null). Several entries of one day count as one, and
    "remove" wins. Entries with a null in any of these columns, or another action or kind,
    are ignored.
    """
    known = entries.select("list", "kind", F.lower("pattern").alias("pattern"), F.col("day").cast("date").alias("day"), "action") \
        .where("list is not null and pattern is not null and day is not null and kind in ('domain', 'prefix') and action in ('add', 'remove')")
    days = known.select("list", F.concat_ws(":", "kind", "pattern").alias("pattern"), "day", "action") \
        .groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))
    later = F.lead("day").over(W.partitionBy("list", "pattern").orderBy("day"))
    return days.withColumn("valid_to", later).where("action = 'add'").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def temporal_url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(url, day, blocked, lists, patterns, since): verdict on each URL at each day it was fetched.

    An as-of join: each pattern of a capture is looked up among the intervals that hold on
    its day. Intervals of one list and pattern do not overlap, so a pattern matches at most
    once per list. Intervals are cut into slices of time and meet captures by pattern and
    slice; a busy host's captures spread over the slices, and skewed joins split besides.
    One row per distinct URL and day; a null URL or day, or a URL without host, is not
    blocked. Patterns compare in lower case as far as the host goes; paths as they are in
    lower case too. Empty tables give no rows or no matches; other columns are not read.
    """
    seen = captures.select(F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("day")).distinct()
    spans = validity_intervals(entries)
    slice_of = lambda day: F.floor(F.unix_date(day) / SLICE_DAYS)
    last = seen.agg(F.max("day").alias("last"))
    cut = spans.join(F.broadcast(last), F.col("valid_from") <= F.col("last")) \
        .withColumn("slice", F.explode(F.sequence(slice_of(F.col("valid_from")), slice_of(F.least(F.coalesce("valid_to", "last"), F.col("last"))))))
    keyed = seen.where("url is not null and day is not null").select("url", "day", slice_of(F.col("day")).alias("slice"),
                                                                     F.explode(F.array_distinct(F.transform(url_patterns(F.col("url")), F.lower))).alias("pattern"))
    active = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    hits = keyed.join(cut.select("list", "pattern", "valid_from", "valid_to", "slice"), ["pattern", "slice"]).where(active)
    verdicts = hits.groupBy("url", "day").agg(
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.array_join(F.sort_array(F.collect_set("pattern")), ",").alias("patterns"), F.min("valid_from").alias("since"))
    found = verdicts.withColumnsRenamed({"url": "hit_url", "day": "hit_day"})
    return seen.join(found, (F.col("url") == F.col("hit_url")) & (F.col("day") == F.col("hit_day")), "left") \
        .select("url", "day", F.col("lists").isNotNull().alias("blocked"), "lists", "patterns", "since")
