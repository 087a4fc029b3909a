"""Column layouts of the stored tables and the label sets they use."""

from __future__ import annotations

from pyspark.sql import types as T

SEVERITY_CLASSES = ("Minor", "Moderate", "Severe", "Fatal")
SEVERITY_INDEX = tuple(sorted(SEVERITY_CLASSES))
UNKNOWN = "Unknown"
NOISE = -1

RAW_FIELDS = (
    "date", "time", "location", "operator", "flight_number", "route",
    "aircraft_type", "registration", "aboard", "fatalities", "ground", "summary",
)

INCIDENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("flight_number", T.StringType()),
    T.StructField("route", T.StringType()),
    T.StructField("aircraft_type", T.StringType()),
    T.StructField("registration", T.StringType()),
    T.StructField("aboard", T.DoubleType()),
    T.StructField("fatalities", T.DoubleType()),
    T.StructField("ground", T.DoubleType()),
    T.StructField("summary", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("fatality_rate", T.DoubleType()),
    T.StructField("severity_label", T.StringType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("proj_x", T.DoubleType()),
    T.StructField("proj_y", T.DoubleType()),
    T.StructField("extracted_cause_category", T.StringType()),
    T.StructField("extracted_phase_of_flight", T.StringType()),
    T.StructField("extracted_contributing_factors", T.ArrayType(T.StringType())),
    T.StructField("extracted_at", T.TimestampType()),
    T.StructField("predicted_severity", T.StringType()),
    T.StructField("prediction_confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

CLUSTER_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("cluster_label", T.IntegerType()),
    T.StructField("incident_count", T.LongType()),
    T.StructField("year_range_start", T.IntegerType()),
    T.StructField("year_range_end", T.IntegerType()),
    T.StructField("dominant_severity", T.StringType()),
    T.StructField("avg_fatality_rate", T.DoubleType()),
    T.StructField("avg_fatalities", T.DoubleType()),
    T.StructField("top_operators", T.ArrayType(T.StringType())),
    T.StructField("top_aircraft_types", T.ArrayType(T.StringType())),
    T.StructField("root_cause_summary", T.StringType()),
    T.StructField("key_contributing_factors", T.ArrayType(T.StringType())),
    T.StructField("recommendations", T.StringType()),
    T.StructField("summarized_at", T.TimestampType()),
])

CLASS_REPORT_TYPE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("support", T.LongType()),
]))

CONFUSION_TYPE = T.ArrayType(T.StructType([
    T.StructField("actual", T.StringType()),
    T.StructField("predicted", T.StringType()),
    T.StructField("n", T.LongType()),
]))

METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision_weighted", T.DoubleType()),
    T.StructField("recall_weighted", T.DoubleType()),
    T.StructField("f1_weighted", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("classification_report", CLASS_REPORT_TYPE),
    T.StructField("confusion_matrix", CONFUSION_TYPE),
    T.StructField("feature_importances", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("test_size", T.DoubleType()),
    T.StructField("training_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
