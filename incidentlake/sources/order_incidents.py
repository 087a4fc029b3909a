"""Incident rows derived from the order, customer, document and vector tables.

One row per order. A column that needs a joined table brings the join only when
it is asked for; every joined key is unique, so leaving a join out keeps the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = {"location", "operator", "route"}
_TEXT = {"summary"}
_CLUSTER = {"cluster_id"}

COLUMNS = (
    "id", "date", "location", "operator", "route", "aircraft_type", "aboard", "fatalities",
    "ground", "year", "fatality_rate", "severity_label", "cluster_id", "proj_x", "proj_y",
    "extracted_cause_category", "extracted_phase_of_flight", "summary",
)

_AIRCRAFT = ("Boeing 747-206B", "Cessna 208B", "Bell 206", "ATR 72-500", "Douglas DC-3", "Beech 1900D", "")
_PHRASES = (
    "All 12 passengers were killed.", "There were no survivors.", "Engine failure on takeoff.",
    "Crashed into a mountain in fog.", "The crew survived and escaped.", "Inflight fire.",
    "Wing separated, broke apart.", "No fatalities.", "Minor injuries only.", "Written off.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores when they come in fewer files than that.

    A table of many files keeps its splits and is not shuffled.
    """
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _pick(key, values) -> F.Column:
    """Value by remainder; remainders beyond the list give null."""
    expr = F.when(key == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        if v is not None:
            expr = expr.when(key == i, F.lit(v))
    return expr


def incidents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named incident columns (all when none are named)."""
    columns = columns or COLUMNS
    wanted = set(columns)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = table(spark, sf_dir, "orders")

    if wanted & _CLUSTER:
        vectors = table(spark, sf_dir, "embeddings")
        n_vecs = vectors.agg(F.count("*")).scalar()
        base = base.withColumn("vec_key", key % n_vecs)
        base = base.join(vectors.select(F.col("vec_id").alias("vec_key"), "label"), "vec_key", "left")
    if wanted & _PLACE:
        nation = table(spark, sf_dir, "nation").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        base = base.join(customer, cust == F.col("c_custkey"), "left").join(
            nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
    if wanted & _TEXT:
        documents = table(spark, sf_dir, "documents")
        n_docs = documents.agg(F.count("*")).scalar()
        # Texts join last, so that no other join moves them. The orders are spread over
        # the join key first: the same exchange serves the join, and the text work
        # downstream is parallel whatever the file layout. The width is stated, since the
        # narrow rows here say little about the size of the texts that join them.
        base = base.withColumn("doc_key", key % n_docs).repartition(_width(spark), "doc_key")
        base = base.join(documents.select(F.col("doc_id").alias("doc_key"), "text"), "doc_key", "left")

    year = F.when(key % 53 == 0, None).otherwise((F.year("o_orderdate") - key % 90).cast("int"))
    aboard = (
        F.when(key % 29 == 0, None).when(key % 31 == 0, F.lit(0.0)).otherwise((1 + cust % 200).cast("double"))
    )
    shared = base.select("*", key.alias("id"), year.alias("year"), aboard.alias("aboard"))
    ident = F.col("id")
    fatalities = F.when(ident % 23 == 0, None).otherwise(
        F.floor(F.col("aboard") * ((ident % 11).cast("double") / 10.0)).cast("double")
    )
    shared = shared.withColumn("fatalities", fatalities)
    shared = shared.withColumn("fatality_rate", F.when(F.col("aboard") > 0, F.col("fatalities") / F.col("aboard")))

    name, priority = F.col("n_name") if wanted & _PLACE else F.lit(None), F.col("o_orderpriority")
    rate, off_map = F.col("fatality_rate"), ident % 13 == 0
    exprs = {
        "id": ident,
        "date": F.concat(F.col("year").cast("string"), F.substr(F.col("o_orderdate").cast("date").cast("string"), F.lit(5))),
        "location": name,
        "operator": F.when(ident % 37 == 0, None).when(ident % 41 == 0, F.lit(""))
        .when(priority == "1-URGENT", F.concat(F.lit("Military - "), name))
        .when(priority == "2-HIGH", F.concat(F.lit("Private Charter "), name))
        .otherwise(F.concat(F.lit("Airline "), name)),
        "route": F.when(ident % 3 == 0, None).otherwise(F.concat(F.col("r_name"), F.lit(" - "), name))
        if wanted & _PLACE else None,
        "aircraft_type": _pick(cust % 8, _AIRCRAFT),
        "aboard": F.col("aboard"),
        "fatalities": F.col("fatalities"),
        "ground": F.when(ident % 17 == 0, 3.0).otherwise(0.0),
        "year": F.col("year"),
        "fatality_rate": rate,
        "severity_label": F.when(rate.isNull(), "Unknown").when(F.col("fatalities") == 0, "Minor")
        .when(rate < 0.1, "Moderate").when(rate < 0.5, "Severe").otherwise("Fatal"),
        "cluster_id": F.when(F.col("label") >= 8, -1).otherwise(F.col("label")) if wanted & _CLUSTER else None,
        "proj_x": F.when(off_map, None).otherwise((ident % 101).cast("double") / 7.0),
        "proj_y": F.when(off_map, None).otherwise((ident % 89).cast("double") / 7.0),
        "extracted_cause_category": _pick(
            ident % 7, ("Mechanical", "Weather|Fire", "Human Error", "Unknown", "Navigation")
        ),
        "extracted_phase_of_flight": _pick(
            ident % 7, ("Takeoff", "Landing | Approach", "Cruise", "Unknown", "Descent")
        ),
        "summary": F.when(ident % 19 == 0, None).otherwise(
            F.concat(F.col("text"), F.lit(" "), F.coalesce(_pick(ident % 16, _PHRASES), F.lit("")))
        ) if wanted & _TEXT else None,
    }
    return shared.select(*[exprs[c].alias(c) for c in columns])
