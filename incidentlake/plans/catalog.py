"""Named queries over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab
from ..functions import replies as R
from ..operators import aggregates as A
from ..operators import clusters as K
from ..operators import evaluation as E
from ..operators import prompts as P
from ..operators import search as S
from ..operators import stats as T
from ..operators.boosting import Settings
from ..operators.density import density_clusters, signature_clusters
from ..operators.features import build_features
from ..operators.hierarchy import vector_clusters
from ..operators.layout import fit_layout
from ..operators.impute import fit_medians, median_impute
from ..operators.ranking import most_frequent, top_values
from ..operators.reduction import project_2d, reduce_dimensions
from ..operators.severity_model import SeverityModel, Training, fill_unknown, label_index, score_unknown, train_severity
from ..operators.split import stratified_split
from ..operators.text import embed_text, fit_tfidf, tokens
from ..operators.word_vectors import cooccurrences, fit_word_vectors, frequent_words, mutual_information
from ..schema import SEVERITY_CLASSES, SEVERITY_INDEX
from ..session import cut_lineage, shared_dir
from ..sources.incidents import clean_incidents, read_incidents_csv, trainable
from ..sources.postings import search_stored, stored_matches, write_searchable
from ..sources.order_incidents import COLUMNS, incidents, table, texts
from ..sources.sinks import (
    backfill, backfill_bucketed, open_bucketed, read_runs, read_table, replace_run, replace_table, store_bucketed, write_coordinates,
)
from .dashboard import dashboard_header, dashboard_summary
from .jobs import assign_clusters
from .states import add_batch, stored_dashboard

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FACTS = ("year", "aboard", "fatalities")
CLUSTERED = ("id", "cluster_id", "fatality_rate", "fatalities", "severity_label", "operator", "aircraft_type", "year")
LISTED = (*S.LIST_COLUMNS, "year")
CLUSTER_WIDTH = 0.75
BUCKETS = 16
LANGUAGES = ("de", "en", "es", "fr")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def on(*columns: str):
    """Register a query that works on the named incident columns."""
    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(incidents(spark, sf_dir, *columns))
        return fn

    return register


def joined(c: str | Column) -> Column:
    return F.concat_ws("; ", c)


def flat_lists(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[joined(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def scratch(spark: SparkSession) -> str:
    """New folder for one run under the folder all executors share."""
    return f"{shared_dir(spark)}/incidentlake-{uuid.uuid4().hex}"


# --- scans, search, projections -------------------------------------------------

@on(*COLUMNS)
def incident_scan(df):
    return df


@on("id", "operator", "aircraft_type", "fatality_rate", "fatalities", "severity_label", "year", "aboard")
def trainable_scan(df):
    return trainable(df, ["id", "operator", "aircraft_type", "fatality_rate", "fatalities", "severity_label", "year", "aboard"])


@on(*COLUMNS)
def incident_detail(df):
    return S.lookup(df, "id", 123)


@on("id", "operator")
def incident_missing(df):
    return S.lookup(df, "id", -5)


@on(*LISTED)
def incident_list(df):
    return df.select(*S.LIST_COLUMNS)


@on(*LISTED)
def search_first_page(df):
    return S.search_incidents(df)


@on(*LISTED)
def search_filtered(df):
    return S.search_incidents(df, severity="Fatal", decade="1980s", term=" nation_1 ", page=2, page_size=50)


@on(*LISTED)
def search_by_operator(df):
    return S.search_incidents(
        df, term="boeing", sort_key="operator", sort_dir="asc", page=3, page_size=25, decade="soon"
    )


@on(*LISTED)
def search_in_text(df):
    return S.search_incidents(df, term="SURVIVED and", sort_key="fatalities", page_size=100)


@on(*LISTED)
def search_postings(df):
    """The same page from stored postings."""
    path = scratch(df.sparkSession)
    write_searchable(df, path)
    return search_stored(df.sparkSession, path, term="SURVIVED and", sort_key="fatalities", page_size=100)


@on(*LISTED)
def postings_hits(df):
    """Hits of several terms counted on stored postings: plain, with wildcards, short, in another column, absent."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    write_searchable(df, path)
    counts = [stored_matches(spark, path, t).agg(F.count("*").alias("hits"), F.sum("id").alias("ids")).select(F.lit(t).alias("term"), "hits", "ids")
              for t in ("Engine", "boeing", "nation_1", "sur%ved", "a_d the", "an", "zzzqqq", "7")]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


@on(*LISTED)
def search_deep_page(df):
    return S.search_incidents(df, sort_key="aboard", sort_dir="asc", page=105, page_size=100)


@on(*LISTED)
def search_hits(df):
    return S.page_info(S.select_incidents(df, severity="Severe", decade="1990s", term="airline"), 12)


@on(*LISTED)
def table_rows(df):
    return S.table_rows(df)


@on("id", "proj_x", "proj_y", "cluster_id", "severity_label", "fatalities", "year", "operator")
def projection_points(df):
    return S.projection_points(df, 2000)


@on(*CLUSTERED, "proj_x", "proj_y")
def point_labels(df):
    return S.point_labels(S.projection_points(df, 1000), K.cluster_stats(df))


@on("id", "summary", "extracted_cause_category", "fatalities")
def pending_extraction(df):
    return S.pending_extraction(df).select("id", "fatalities")


@on("id", "summary", "extracted_cause_category", "fatalities")
def extraction_queue(df):
    return S.pending_extraction(df, 200).select("id", "fatalities")


@on(*FACTS)
def even_years(df):
    return A.yearly_chart(S.even_years(A.yearly_trends(df)))


# --- cleaning ---------------------------------------------------------------------

def raw_text(df: DataFrame) -> DataFrame:
    """The incidents as the text columns of a raw file, with unreadable numbers."""
    ident = F.col("id")

    def number(c: str, bad: str, every: int) -> Column:
        return F.when(ident % every == 1, F.lit(bad)).otherwise(F.col(c).cast("string")).alias(c)

    us_date = F.concat(F.substring("date", 6, 2), F.lit("/"), F.substring("date", 9, 2), F.lit("/"), F.substring("date", 1, 4))
    return df.select(
        ident.cast("string").alias("id"),
        F.when(ident % 5 == 0, us_date).when(ident % 43 == 2, F.concat(F.lit("about "), F.substring("date", 1, 4)))
        .otherwise(F.col("date")).alias("date"),
        "location", "operator", "route", "aircraft_type", number("aboard", "n/a", 61),
        number("fatalities", "unknown", 67), number("ground", "", 71),
    )


CLEANED = (
    "id", "event_date", "year", "aboard", "fatalities", "ground", "fatality_rate", "survival_count",
    "severity_label", "operator",
)
RAW = ("id", "date", "location", "operator", "route", "aircraft_type", "aboard", "fatalities", "ground")


def cleaned(df: DataFrame) -> DataFrame:
    return clean_incidents(df).select(*CLEANED).withColumn("event_date", F.col("event_date").cast("string"))


@on(*RAW)
def clean_fields(df):
    return cleaned(raw_text(df))


@query
def csv_import(spark, sf_dir):
    """Raw text written as CSV files, read back by header and cleaned."""
    path = scratch(spark)
    raw = raw_text(incidents(spark, sf_dir, *RAW)).withColumnRenamed("aircraft_type", "Aircraft Type")
    raw.write.option("header", True).option("escape", '"').csv(path)
    return cleaned(read_incidents_csv(spark, path, multi_line=True))


@on("id", "operator", "extracted_cause_category", "extracted_phase_of_flight")
def categories(df):
    return df.select(
        "id", C.operator_category(F.col("operator")).alias("category_full"),
        C.operator_category(F.col("operator"), "short").alias("category_short"),
        C.first_value(F.col("extracted_cause_category")).alias("cause"),
        C.first_value(F.col("extracted_phase_of_flight")).alias("phase"),
    )


# --- overview, trends, rankings, distributions --------------------------------------

OVERVIEW = ("fatalities", "aboard", "year", "operator", "aircraft_type", "location", "severity_label")


@on(*OVERVIEW)
def overview(df):
    return A.overview(df)


@on(*OVERVIEW)
def overview_all(df):
    return A.overview_all(df).drop("severity_distribution")


@on(*OVERVIEW)
def overview_severities(df):
    return A.overview_all(df).select(F.explode("severity_distribution").alias("severity_label", "n"))


@on(*FACTS)
def yearly_trends(df):
    return A.yearly_trends(df)


@on(*FACTS)
def yearly_trends_percent(df):
    return A.yearly_trends(df, "percent")


@on(*FACTS)
def decade_trends(df):
    return A.decade_trends(df)


@on(*FACTS)
def decade_trends_percent(df):
    return A.decade_trends(df, "percent")


@on(*FACTS)
def yearly_chart(df):
    return A.yearly_chart(A.yearly_trends(df))


@on(*FACTS)
def decade_chart(df):
    return A.decade_chart(A.decade_trends(df))


@on("operator", "aboard", "fatalities")
def top_operators(df):
    return A.top_groups(df, "operator", 20)


@on("aircraft_type", "aboard", "fatalities")
def top_aircraft(df):
    return A.top_groups(df, "aircraft_type", 20).drop("avg_fatalities_per_incident")


@on("operator", "fatalities")
def top_operators_share(df):
    return A.top_groups_share(df, "operator")


@on("aircraft_type", "fatalities")
def top_aircraft_share(df):
    return A.top_groups_share(df, "aircraft_type")


def part_labelled(df: DataFrame) -> DataFrame:
    """Severity with missing labels, so that the treatment of nulls shows."""
    return df.select(F.when(F.col("id") % 47 != 0, F.col("severity_label")).alias("severity_label"))


@on("id", "severity_label")
def severity_distribution(df):
    return A.severity_distribution(part_labelled(df))


@on("id", "severity_label")
def severity_distribution_labelled(df):
    return A.severity_distribution(part_labelled(df), None, 1)


@on("id", "severity_label")
def quick_stats(df):
    return A.quick_stats(part_labelled(df))


@on("id", "severity_label")
def distribution_shares(df):
    return A.distribution_shares(part_labelled(df))


@on("severity_label")
def training_label_counts(df):
    return A.label_counts(df.where(F.col("severity_label").isin(*SEVERITY_CLASSES)), "severity_label")


@on("extracted_cause_category")
def cause_distribution(df):
    return A.value_distribution(df, "extracted_cause_category")


@on("extracted_cause_category")
def extraction_coverage(df):
    return A.extraction_coverage(df)


@on("extracted_cause_category", "extracted_phase_of_flight")
def extraction_distribution(df):
    return A.extraction_distribution(df)


@on("summary")
def summary_coverage(df):
    return A.summary_coverage(df)


# --- statistics -----------------------------------------------------------------------

NUMBERS = ("aboard", "fatalities", "ground", "year", "fatality_rate")


@on(*NUMBERS)
def correlation_matrix(df):
    return T.correlation_matrix(df)


@on(*NUMBERS)
def correlation_insights(df):
    return T.correlation_insights(T.correlation_matrix(df))


@on("fatalities", "aboard", "year")
def correlation_pairwise(df):
    return T.correlation_matrix(df, T.PAIRWISE, complete=False)


@on("severity_label", "aircraft_type")
def contingency(df):
    return T.contingency(df, "severity_label", "aircraft_type")


@on("severity_label", "operator", "year")
def chi_square_suite(df):
    return T.chi_square_suite(df)


@on("severity_label", "year")
def chi_square_decade(df):
    return T.chi_square_decade(df)


@query
def chi_square_words(spark, sf_dir):
    """Language against every word of the documents: a test with many thousands of values."""
    words = texts(spark, sf_dir).select("lang", F.explode(tokens(F.col("text"))).alias("word"))
    return T.chi_square(words, "lang", "word").select("test", F.round("chi2", 2).alias("chi2"), "dof", "significant")


@on("id", "fatalities", "ground")
def chi_square_two_by_two(df):
    """One degree of freedom: the continuity correction applies."""
    yes_no = df.select((F.col("fatalities") > 50).alias("many"), (F.col("ground") > 0).alias("hit_ground"))
    return T.chi_square(yes_no, "many", "hit_ground").drop("interpretation", "p_value")


@on("id", "operator", "severity_label")
def top_operator_rows(df):
    return T.top_operator_rows(df)


# --- evaluation -------------------------------------------------------------------------

PHRASE_RULES = (
    ("kw_no_fatalities", "Minor"), ("kw_no_survivors", "Fatal"), ("kw_all_killed", "Fatal"),
    ("kw_survived", "Moderate"), ("kw_engine", "Severe"),
)


def by_phrase(reverse: bool = False) -> Column:
    """The label of the first rule whose phrase a report has."""
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(v)) for c, v in (PHRASE_RULES[::-1] if reverse else PHRASE_RULES)], F.lit("Fatal"))


def phrase_predictions(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Severity guessed from report phrases: a stand-in for stored predictions."""
    return build_features(df, "id", "severity_label").select("id", "severity_label", by_phrase(reverse).alias("predicted"))


def phrase_confusion(df: DataFrame, reverse: bool = False) -> DataFrame:
    return E.confusion(phrase_predictions(df, reverse), "severity_label", "predicted")


@on("id", "severity_label", "summary")
def confusion(df):
    return phrase_confusion(df)


@on("id", "severity_label", "summary")
def confusion_shares(df):
    return E.row_shares(phrase_confusion(df))


@on("id", "severity_label", "summary")
def class_report(df):
    return E.rounded_report(phrase_confusion(df))


@on("id", "severity_label", "summary")
def classification_metrics(df):
    return E.classification_metrics(phrase_confusion(df))


@on("id", "severity_label", "summary")
def confusion_from_json(df):
    """The matrix packed into JSON text and unpacked again, once bare and once with names."""
    cells = phrase_confusion(df)
    rows = cells.groupBy("actual").agg(F.array_sort(F.collect_list(F.struct("predicted", "n"))).alias("r"))
    matrix = rows.agg(F.array_sort(F.collect_list(F.struct("actual", F.transform("r", lambda x: x["n"]).alias("c")))).alias("m"))
    text = F.to_json(F.transform("m", lambda x: x["c"]))
    names = ",".join(f'"{c}"' for c in SEVERITY_INDEX)
    wrapped = F.concat(F.lit('{"matrix":'), text, F.lit(f',"classNames":[{names}]}}'))
    stored = matrix.select(F.explode(F.array(
        F.struct(F.lit("bare").alias("form"), text.alias("j")), F.struct(F.lit("named").alias("form"), wrapped.alias("j")),
        F.struct(F.lit("broken").alias("form"), F.lit("not json").alias("j")),
    )).alias("s")).select("s.form", "s.j")
    return E.confusion_from_json(stored, "j")


def stored_metrics(df: DataFrame) -> DataFrame:
    """Two runs, with the rules in either order. Both come from one count of the reports, whose texts are read once."""
    both = build_features(df, "severity_label").select("severity_label", by_phrase().alias("first"), by_phrase(True).alias("last"))
    counted = both.groupBy("severity_label", "first", "last").agg(F.count("*").alias("reports"))
    runs = [
        E.classification_metrics(E.confusion(counted, "severity_label", rule, count="reports")).select(
            F.lit(run).cast("bigint").alias("run_id"), F.lit("PhraseRules").alias("model_type"),
            F.lit("").alias("model_path"), "accuracy", "f1_weighted", "precision_weighted", "recall_weighted",
            F.lit(0).alias("n_estimators"), F.lit(0).cast("bigint").alias("training_samples"), "test_samples",
        )
        for run, rule in ((1, "first"), (2, "last"))
    ]
    return runs[0].unionByName(runs[1])


@on("id", "severity_label", "summary")
def metrics_history(df):
    return E.metrics_history(stored_metrics(df))


@on("id", "severity_label", "summary")
def metrics_summary(df):
    return E.metrics_summary(stored_metrics(df), 2)


@on("id", "severity_label", "summary")
def metrics_report(df):
    """The per-class report of one stored run as rows."""
    cells = phrase_confusion(df)
    report = E.rounded_report(cells).agg(
        F.array_sort(F.collect_list(F.struct("label", "precision", "recall", "f1", "support")))
    ).scalar()
    run = E.metrics_full(stored_metrics(df).withColumn("classification_report", report), 1)
    return run.select("run_id", "accuracy", F.explode("classification_report").alias("r")).select("run_id", "accuracy", "r.*")


@on("id", "severity_label", "summary")
def prediction_counts(df):
    return A.label_counts(phrase_predictions(df).where(F.col("severity_label") == "Unknown"), "predicted")


# --- features, split, text ----------------------------------------------------------------

FEATURE_SOURCES = (
    "id", "year", "aboard", "ground", "cluster_id", "date", "route", "operator", "summary", "aircraft_type",
    "extracted_cause_category", "extracted_phase_of_flight",
)


@on(*FEATURE_SOURCES)
def features(df):
    rows = build_features(df.withColumnRenamed("id", "incident"), "incident")
    return rows.withColumn("log_aboard", F.round("log_aboard", 10))


@on("id", "severity_label")
def label_indices(df):
    return df.select("id", label_index(F.col("severity_label")).alias("label"))


@on("id", "severity_label")
def split_rows(df):
    return stratified_split(df, "severity_label")


@on("id", "severity_label", "year", "aboard")
def imputed_numbers(df):
    split = stratified_split(df, "severity_label")
    cols = ("year", "aboard")
    rows = split.select("id", "split", *[F.col(c).cast("double").alias(c) for c in cols])
    return median_impute(rows, fit_medians(rows.where(F.col("split") == "train"), cols))


@query
def tfidf_vocabulary(spark, sf_dir):
    model = fit_tfidf(texts(spark, sf_dir), "text")
    return model.vocabulary.withColumn("idf", F.round("idf", 6)).drop("idx")


@query
def tfidf_weights(spark, sf_dir):
    documents = texts(spark, sf_dir)
    model = fit_tfidf(documents, "text")
    return model.weights(documents, "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def text_vectors(spark, sf_dir):
    """The filled places of every text vector."""
    rows = embed_text(texts(spark, sf_dir), "text").select("doc_id", F.posexplode("embedding").alias("idx", "value"))
    return rows.where("value <> 0").select("doc_id", "idx", F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def word_pairs(spark, sf_dir):
    """How often frequent words stand near each other, and their mutual information."""
    words = cut_lineage(texts(spark, sf_dir).select(tokens(F.col("text"), vocab.STOP_WORDS).alias("words")))
    names = [w for w, _ in frequent_words(words, "words", 300, 5)]
    pairs = cut_lineage(cooccurrences(words, "words", names))
    known = spark.createDataFrame(list(enumerate(names)), "i int, word string")
    return pairs.join(mutual_information(pairs).withColumnsRenamed({"i": "a", "j": "b"}), ["a", "b"], "left") \
        .join(F.broadcast(known.withColumnsRenamed({"i": "a", "word": "first"})), "a").join(F.broadcast(known.withColumnsRenamed({"i": "b", "word": "second"})), "b") \
        .select("first", "second", "n", F.round(F.coalesce("value", F.lit(0.0)), 6).alias("information"))


@query
def learned_text_vectors(spark, sf_dir):
    """Vectors of the documents by the company that their words keep."""
    docs = texts(spark, sf_dir).select("doc_id", "text")
    return fit_word_vectors(docs, "text", dims=50, most_words=5000).embed(docs, "text").drop("text")


@query
def text_vector_lengths(spark, sf_dir):
    """Size and Euclidean length of every text vector."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return embed_text(texts(spark, sf_dir), "text").select(
        "doc_id", F.size(v).alias("dims"), F.round(norm, 4).alias("length")
    )


@query
def component_variance(spark, sf_dir):
    """Total variance over all components, which a rotation must preserve, and the order of the components."""
    full = reduce_dimensions(table(spark, sf_dir, "embeddings"), k=64).select(F.posexplode("reduced").alias("i", "x"))
    per = full.groupBy("i").agg(F.var_pop("x").alias("v"))
    ordered = per.withColumn("ok", F.col("v") <= F.lag("v", 1, float("inf")).over(Window.orderBy("i")) + 1e-12)
    return ordered.agg(F.round(F.sum("v"), 6).alias("total_variance"), F.min("ok").alias("falling"))


@query
def reduced_vectors(spark, sf_dir):
    """Every vector's 50 principal components, one row each."""
    rows = reduce_dimensions(table(spark, sf_dir, "embeddings"), k=50)
    return rows.select("vec_id", F.posexplode("reduced").alias("idx", "value")).withColumn("value", F.round("value", 4))


@query
def projected_vectors(spark, sf_dir):
    return project_2d(table(spark, sf_dir, "embeddings")).select(
        "vec_id", F.round("proj_x", 4).alias("proj_x"), F.round("proj_y", 4).alias("proj_y"))


# --- classifier ------------------------------------------------------------------------------

MODEL_SOURCES = (*FEATURE_SOURCES, "severity_label")


def trained(spark: SparkSession, sf_dir: str):
    """The rows and a training run over them."""
    rows = incidents(spark, sf_dir, *MODEL_SOURCES)
    return rows, train_severity(rows)


@query
def severity_predictions(spark, sf_dir):
    return trained(spark, sf_dir)[1].predictions


@query
def severity_scores(spark, sf_dir):
    rows, training = trained(spark, sf_dir)
    return score_unknown(training.model, rows)


@query
def severity_test_rows(spark, sf_dir):
    """The rows the model was tested on: exactly the test part of the split."""
    return trained(spark, sf_dir)[1].predictions.select("id", "actual")


@query
def severity_back_fill(spark, sf_dir):
    """Which rows the in-place back-fill completes, and whether the values are in range."""
    rows, training = trained(spark, sf_dir)
    filled = fill_unknown(training.model, rows)
    fine = F.col("predicted_severity").isin(*SEVERITY_CLASSES) & F.col("prediction_confidence").between(0.25, 1)
    return filled.select("id", "severity_label", F.coalesce(fine, F.lit(False)).alias("filled"))


@query
def severity_importances(spark, sf_dir):
    return trained(spark, sf_dir)[1].model.importances(spark)


def language_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports whose severity stands for their language; every tenth is unlabelled."""
    by_language = F.create_map(*[F.lit(x) for pair in zip(LANGUAGES, SEVERITY_CLASSES) for x in pair])[F.col("lang")]
    docs = texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("text").alias("summary"),
        F.when(F.col("doc_id") % 10 != 3, by_language).otherwise(F.lit(None)).alias("known"))
    return docs.withColumn("severity_label", F.coalesce("known", F.lit("Unknown"))).drop("known")


def measure(name: str, df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("measure"), "value")


def training_checks(training: Training, docs: DataFrame) -> DataFrame:
    """What must hold of a trained classifier, as counted rows."""
    spark = docs.sparkSession
    path = scratch(spark)
    training.model.save(spark, path)
    scored, tested = cut_lineage(score_unknown(training.model, docs)), training.predictions  # counted and compared
    again = score_unknown(SeverityModel.load(spark, path), docs)
    fine = F.col("predicted").isin(*SEVERITY_CLASSES) & F.col("confidence").between(0.25, 1)
    best = tested.groupBy("actual").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    right = tested.agg(F.count_if(F.col("actual") == F.col("predicted")).alias("n"))
    weights = training.model.importances(spark, 1000)
    falling = F.col("importance").between(0, F.lag("importance", 1, 1.0).over(Window.orderBy(F.desc("importance"), "feature")))
    parts = [
        measure("tested", tested, F.count("*")),
        measure("tested in range", tested, F.count_if(fine)),
        measure("better than the largest class", right.unionByName(best.select((-F.col("n")).alias("n"))), (F.sum("n") > 0).cast("int")),
        measure("scored", scored, F.count("*")),
        measure("scored alike when reloaded", scored.intersect(again), F.count("*")),
        measure("importances out of order", weights.select((~falling).alias("bad")), F.count_if("bad")),
        measure("importances in all, per cent", weights, F.round(F.sum("importance") * 100)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def model_checks(spark, sf_dir):
    """Checks of a forest that learns a document's language.

    The model must beat the largest class on its test rows, keep to the classes and to
    confidences up to 1, score alike after it is stored and read again, and have
    importances that fall and sum to 1.
    """
    docs = language_reports(spark, sf_dir)
    return training_checks(train_severity(docs, num_trees=60), docs)


@query
def boosted_checks(spark, sf_dir):
    """The same of one boosted model for all classes."""
    docs = cut_lineage(language_reports(spark, sf_dir))
    return training_checks(train_severity(docs, kind="softmax", boosting=Settings(rounds=12, rate=0.3, depth=3, patience=4)), docs)


# --- clusters ---------------------------------------------------------------------------------

@on(*CLUSTERED)
def cluster_stats(df):
    return flat_lists(K.cluster_stats(df), "top_operators", "top_aircraft_types")


@on(*CLUSTERED)
def clusters_by_label(df):
    return K.real_clusters(K.cluster_stats(df)).select("cluster_label", "incident_count", "dominant_severity")


@on(*CLUSTERED)
def clusters_by_size(df):
    return K.by_size(K.cluster_stats(df)).select("cluster_label", "incident_count")


@on(*CLUSTERED)
def cluster_lookup(df):
    return S.lookup(K.cluster_stats(df), "cluster_label", 3).select(
        "cluster_label", "incident_count", "avg_fatality_rate", K.year_range().alias("year_range")
    )


@on("cluster_id")
def cluster_coverage(df):
    return A.cluster_coverage(df)


@on("cluster_id")
def cluster_labels(df):
    return df.select("cluster_id").distinct()


@on("cluster_id", "operator")
def cluster_top_operators(df):
    best = top_values(df, "cluster_id", "operator", 5, "names")
    return best.select("cluster_id", F.posexplode("names").alias("position", "operator"))


@on("cluster_id", "severity_label")
def cluster_dominant_severity(df):
    return most_frequent(df, "cluster_id", "severity_label", "dominant_severity")


@on(*CLUSTERED, "summary")
def cluster_samples(df):
    return K.cluster_samples(df, K.cluster_stats(df))


def cluster_reply(label: Column) -> Column:
    """A model reply per cluster, in the forms such replies come in."""
    body = F.concat(
        F.lit('{"root_cause_summary": " Pattern '), label.cast("string"),
        F.lit(' ", "key_contributing_factors": ["a", " b", "", "c", "d", "e", "f", "g"], "recommendations": "Train crews"}'),
    )
    return (
        F.when(label % 3 == 0, body).when(label % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" Good luck.")))
    )


def summarised_clusters(df: DataFrame) -> DataFrame:
    """Cluster table with summaries for the deadlier clusters."""
    clusters = K.with_summary_columns(K.cluster_stats(df))
    answered = clusters.where(F.col("avg_fatalities") > 47)
    replies = answered.select("cluster_label", cluster_reply(F.col("cluster_label")).alias("reply"))
    return P.apply_cluster_replies(clusters, replies)


@on(*CLUSTERED)
def cluster_cards(df):
    cards = K.cluster_cards(summarised_clusters(df))
    return flat_lists(cards, "top_operators", "top_aircraft_types", "key_contributing_factors")


@on(*CLUSTERED)
def cluster_rate_texts(df):
    rate = F.col("avg_fatality_rate")
    return K.cluster_stats(df).select(
        "cluster_label", C.percent_text(rate).alias("one_digit"), C.percent_text(rate, 0).alias("whole")
    )


@on(*CLUSTERED)
def cluster_summaries(df):
    rows = K.cluster_summaries(summarised_clusters(df)).drop("summarized_at")
    return flat_lists(rows, "top_operators", "top_aircraft_types", "key_contributing_factors")


@on("id", "proj_x", "proj_y")
def density_labels(df):
    return density_clusters(df, eps=0.2).select("id", "cluster_id")


@query
def embedding_clusters(spark, sf_dir):
    """Coarse clusters of the given vectors, by signatures of all their components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return signature_clusters(vectors, "embedding", 64, width=CLUSTER_WIDTH, key="vec_id").select("vec_id", "cluster_id")


@query
def layout_coordinates(spark, sf_dir):
    """Plot coordinates of the given vectors that keep neighbours together."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return fit_layout(vectors, "embedding", 64).place(vectors, "embedding").drop("embedding")


@query
def embedding_groups(spark, sf_dir):
    """Clusters of the given vectors by the hierarchy of their neighbourhoods."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_clusters(vectors, "embedding", 64, key="vec_id").select("vec_id", "cluster_id")


@query
def document_clusters(spark, sf_dir):
    """Clusters of the documents' text vectors, which are stored once and then read in every pass."""
    vectors = cut_lineage(embed_text(texts(spark, sf_dir).select("doc_id", "text"), "text").drop("text"))
    return assign_clusters(vectors, key="doc_id").drop("embedding")


@on("id", "proj_x", "proj_y", *[c for c in CLUSTERED if c not in ("id", "cluster_id")])
def density_profiles(df):
    """Density clusters written back to the incidents and profiled."""
    filled = backfill(df, density_clusters(df, eps=0.2), "id", ["cluster_id"])
    return flat_lists(K.cluster_stats(filled), "top_operators", "top_aircraft_types")


@on("id", "severity_label", "summary", "operator")
def backfill_predictions(df):
    unknown = phrase_predictions(df).where(F.col("severity_label") == "Unknown")
    updates = unknown.select("id", F.col("predicted").alias("predicted_severity"), F.lit(0.5).alias("prediction_confidence"))
    return backfill(df.select("id", "severity_label", "operator"), updates, "id", ["predicted_severity", "prediction_confidence"])


@on("id", "severity_label", "summary", "operator")
def bucketed_backfill(df):
    """The same on incidents stored in buckets of their key."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    name = f"incidents_{path[-12:]}"
    store_bucketed(df.select("id", "severity_label", "operator"), name, path, "id", BUCKETS)
    unknown = phrase_predictions(df).where(F.col("severity_label") == "Unknown")
    updates = unknown.select("id", F.col("predicted").alias("predicted_severity"), F.lit(0.5).alias("prediction_confidence"))
    return backfill_bucketed(open_bucketed(spark, name, path, "id", BUCKETS), updates, "id", ["predicted_severity", "prediction_confidence"], BUCKETS)


@on("id", "proj_x", "proj_y", "operator")
def backfill_clusters(df):
    labels = density_clusters(df, eps=0.2)
    return backfill(df.select("id", "operator"), labels, "id", ["cluster_id"])


# --- prompts and replies -----------------------------------------------------------------------

@on("id", "summary", "extracted_cause_category", "fatalities")
def extraction_prompts(df):
    return P.extraction_prompts(df)


@on("id", "summary", "extracted_cause_category", "fatalities")
def extraction_prompts_short(df):
    return P.extraction_prompts(df, chars=vocab.EXTRACTION_CHARS)


@on("id", "summary", "extracted_cause_category", "fatalities")
def extraction_prompts_stripped(df):
    """Reports with tabs, line breaks and other white space at their ends, or of nothing else."""
    kind = F.col("id") % 5
    odd = F.when(kind == 0, F.lit("\t \n\u3000")).when(kind == 1, F.concat(F.lit("\n\t"), "summary", F.lit("\u00a0\r\n"))).otherwise(F.col("summary"))
    return P.extraction_prompts(df.withColumn("summary", odd))


@on(*CLUSTERED, "summary")
def cluster_prompts(df):
    return P.cluster_prompts(K.cluster_stats(df), df)


@on(*CLUSTERED, "summary")
def cluster_prompts_short(df):
    return P.cluster_prompts(K.cluster_stats(df), df, sample_chars=vocab.SAMPLE_CHARS, name_chars=vocab.NAME_LIST_CHARS)


def incident_reply(df: DataFrame) -> DataFrame:
    """A reply per report in the forms such replies come in."""
    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.lower(F.coalesce(c, F.lit("sabotage"))), F.lit('"'))

    body = F.concat(
        F.lit('{"cause_category": '), quoted("extracted_cause_category"), F.lit(', "phase_of_flight": '),
        quoted("extracted_phase_of_flight"),
        F.lit(', "contributing_factors": ["f1", " f2 ", "", null, "f3", "f4", "f5", "f6"], "is_weather_related": true}'),
    )
    kind = F.col("id") % 5
    reply = (
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Sure! "), body, F.lit("\nAnything else?")))
        .when(kind == 3, "no structured answer")
        .otherwise('{"cause_category": "Pilot Error", "phase_of_flight": "taxi", "contributing_factors": "none"}')
    )
    return df.select("id", reply.alias("reply"))


REPLIED = ("id", "extracted_cause_category", "extracted_phase_of_flight")


@on(*REPLIED)
def parsed_replies(df):
    rows = P.parse_replies(incident_reply(df)).drop("reply")
    return flat_lists(rows, "contributing_factors")


@on(*REPLIED)
def applied_replies(df):
    some = incident_reply(df.where(F.col("extracted_cause_category").isNotNull()))
    rows = P.apply_replies(df, some).withColumn("stamped", F.col("extracted_at").isNotNull()).drop("extracted_at")
    return flat_lists(rows, "extracted_contributing_factors")


@on("id", "summary")
def keyword_extraction(df):
    return P.extract_by_keywords(df)


@on("id", "summary", "extracted_cause_category", "extracted_phase_of_flight")
def keyword_backfill(df):
    return P.fill_by_keywords(df).drop("summary")


@on("id", "location", "operator")
def factor_fields(df):
    """Stored factor fields in every older form, read as lists."""
    kind, place = F.col("id") % 6, F.coalesce("location", F.lit("x"))
    stored = (
        F.when(kind == 0, F.concat(F.lit('["ice", "'), place, F.lit('"]')))
        .when(kind == 1, F.concat(F.lit('"'), place, F.lit('"')))
        .when(kind == 2, F.concat(place, F.lit("\n \nfatigue ")))
        .when(kind == 3, F.concat(place, F.lit(", wind,, night ")))
        .when(kind == 4, place)
    )
    return df.select("id", joined(R.factor_list(stored)).alias("factors"), F.size(R.factor_list(stored)).alias("n"))


# --- tables written and read back -----------------------------------------------------------------

@query
def replaced_runs(spark, sf_dir):
    """Two runs stored, the first one replaced; the second must stay as it was."""
    path = scratch(spark)
    stats = K.cluster_stats(incidents(spark, sf_dir, *CLUSTERED)).select("cluster_label", "incident_count")
    replace_run(stats, path, 1)
    replace_run(stats, path, 2)
    replace_run(stats.where(F.col("cluster_label") >= 0), path, 1)
    return read_runs(spark, path)


@query
def replaced_table(spark, sf_dir):
    path = scratch(spark)
    stats = K.cluster_stats(incidents(spark, sf_dir, *CLUSTERED)).select("cluster_label", "incident_count")
    replace_table(stats, path)
    replace_table(stats.where(F.col("cluster_label") == -1), path)
    return read_table(spark, path)


@query
def stored_coordinates(spark, sf_dir):
    path = scratch(spark)
    points = incidents(spark, sf_dir, "id", "proj_x", "proj_y").where(F.col("proj_x").isNotNull())
    write_coordinates(points, path, 7)
    return read_runs(spark, path, 7).select("id", "proj_x", "proj_y", "run_id")


# --- dashboard ---------------------------------------------------------------------------------------

@on("id", "location", "summary", *[c for c in CLUSTERED if c != "id"], "aboard")
def dashboard_totals(df):
    return dashboard_header(df, K.cluster_stats(df), stored_metrics(df))


@on(*OVERVIEW)
def dashboard_sections(df):
    """The JSON sections of the dashboard, read back as rows."""
    return section_rows(dashboard_summary(df))


@on(*OVERVIEW)
def dashboard_states(df):
    """The same from the stored states of three batches, one of them stored twice."""
    path = scratch(df.sparkSession)
    numbered = df.withColumn("batch", F.pmod(F.xxhash64("year", "operator", "aircraft_type"), F.lit(3)))
    add_batch(numbered, path, 1)
    for batch in range(3):
        add_batch(numbered.where(F.col("batch") == batch), path, batch)
    return section_rows(stored_dashboard(df.sparkSession, path))


def section_rows(row: DataFrame) -> DataFrame:
    def rows(section: str, kind: str, name: str, count: str, value: str) -> DataFrame:
        items = F.from_json(section, f"array<struct<{kind}>>")
        return row.select(F.explode(items).alias("i")).select(
            F.lit(section).alias("section"), F.col(f"i.{name}").cast("string").alias("name"),
            F.col(f"i.{count}").alias("n"), F.col(f"i.{value}").alias("value"),
        )

    head = F.from_json("overview", "total_incidents bigint, overall_fatality_rate_pct double")
    overall = row.select(
        F.lit("overview").alias("section"), F.lit("all").alias("name"), head["total_incidents"].alias("n"),
        head["overall_fatality_rate_pct"].alias("value"),
    )
    return (
        overall
        .unionByName(rows("yearly", "year: int, incident_count: bigint, avg_fatality_rate: double", "year", "incident_count", "avg_fatality_rate"))
        .unionByName(rows("severity", "severity: string, count: bigint, percentage: double", "severity", "count", "percentage"))
        .unionByName(rows("decade", "decade: string, incidents: bigint, fatality_rate: double", "decade", "incidents", "fatality_rate"))
    )
