"""Readers for raw and stored incident tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import INCIDENT_SCHEMA, RAW_FIELDS

# Header names of public accident lists -> field names.
HEADER_NAMES = {"type": "aircraft_type", "aircraft": "aircraft_type", "flight": "flight_number"}

RAW_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType())] + [T.StructField(c, T.StringType()) for c in RAW_FIELDS]
)


def _field_name(header: str) -> str:
    name = "".join(ch if ch.isalnum() else "_" for ch in header.strip().lower()).strip("_")
    return HEADER_NAMES.get(name, name)


def read_incidents_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """Raw reports as text columns, named like the incident fields.

    Without ``schema`` the header names the columns, everything stays text and
    cleaning does the typing, so no inference pass over the data is needed.
    Files whose quoted fields hold line breaks need ``multi_line``, which makes a
    file one task; one-line records are split. Files read together must have the same
    header: another order or other names end the read with an error, so that no value
    comes under another name. Empty fields are
    missing values.
    """
    reader = (
        spark.read.option("header", True).option("enforceSchema", schema is not None).option("mode", "PERMISSIVE")
        .option("multiLine", multi_line).option("escape", '"').option("quote", '"')
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(_field_name(c)) for c in raw.columns])


def read_incidents(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored incidents; only the named columns are read from the files."""
    df = spark.read.schema(INCIDENT_SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def trainable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projected scan of the rows that carry a severity label."""
    return df.where(F.col("severity_label").isNotNull()).select(*columns)


def clean_incidents(df: DataFrame, thresholds: Sequence[float] = (0.10, 0.50)) -> DataFrame:
    """Type the raw fields and derive year, rate, survivors and severity.

    One narrow pass. Fields the input lacks are added as nulls. An ``id`` has to
    come with the data: numbering rows of a distributed file is not repeatable.
    """
    text = [c for c in RAW_FIELDS if c not in ("aboard", "fatalities", "ground")]
    have = set(df.columns)

    def field(name: str):
        return F.col(name) if name in have else F.lit(None).cast("string")

    typed = df.select(
        field("id").try_cast("bigint").alias("id"),
        *[field(c).cast("string").alias(c) for c in text],
        *[C.as_double(field(c)).alias(c) for c in ("aboard", "fatalities", "ground")],
    )
    rate = C.fatality_rate(F.col("fatalities"), F.col("aboard"))
    return typed.select(
        "*",
        C.as_date(F.col("date")).alias("event_date"),
        C.year_of(F.col("date")).alias("year"),
        rate.alias("fatality_rate"),
        (F.col("aboard") - F.col("fatalities")).alias("survival_count"),
        C.severity_label(rate, F.col("fatalities"), thresholds).alias("severity_label"),
    )
