"""The batch jobs: clusters, severity model, prompts and replies.

Every job reads a stored table and writes a new version beside it, so a job that
is repeated after a failure starts from unchanged input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import cluster_stats, with_summary_columns
from ..operators.hierarchy import vector_clusters
from ..functions import vocab
from ..operators.prompts import cluster_prompts, extraction_prompts, fill_by_keywords
from ..operators.layout import fit_layout
from ..operators.reduction import reduce_dimensions
from ..operators.severity_model import SeverityModel, Training, fill_unknown, train_severity
from ..operators.text import embed_text, incident_text
from ..sources.sinks import read_table, replace_run, replace_table, write_coordinates


ASSIGNED = ("cluster_id", "proj_x", "proj_y")


def assign_clusters(
    df: DataFrame, vector: str = "embedding", key: str = "id", k: int = 50,
    min_samples: int = 5, min_cluster_size: int = 15,
) -> DataFrame:
    """Add cluster label and plot coordinates to rows that carry a vector.

    The vectors are reduced to ``k`` components, all of which the density step uses; the
    plot has a layout of its own, fitted to keep neighbours together.
    """
    k = max(k, 2)
    reduced = reduce_dimensions(df.drop(*ASSIGNED), vector, k, "_reduced")
    placed = fit_layout(reduced, "_reduced", k).place(reduced, "_reduced")
    return vector_clusters(placed, "_reduced", k, min_samples, min_cluster_size, key).drop("_reduced")


def build_clusters(
    df: DataFrame, out: str, run_id: int, text: Column | None = None, **options: float
) -> tuple[DataFrame, DataFrame]:
    """Embed, reduce, cluster; store the back-filled incidents and the cluster table of the run.

    Every text is encoded once: the incidents are stored with their vectors and all
    further passes read those. Reduction and labelling are row-wise once fitted, so
    the incidents are rewritten in a scan without being shuffled.
    """
    spark, path = df.sparkSession, f"{out}/incidents_clustered_{run_id}"
    replace_table(embed_text(df, text if text is not None else incident_text()), f"{out}/vectors_{run_id}")
    vectors = read_table(spark, f"{out}/vectors_{run_id}")
    assigned = assign_clusters(vectors, **options).drop("embedding")
    kept = [c for c in df.columns if c not in ASSIGNED]
    replace_table(assigned.select(*kept, *ASSIGNED), path)
    stored = read_table(spark, path)
    write_coordinates(stored, f"{out}/coordinates", run_id)
    replace_table(with_summary_columns(cluster_stats(stored, run_id=run_id)), f"{out}/clusters_{run_id}")
    return stored, read_table(spark, f"{out}/clusters_{run_id}")


def metrics_row(training: Training, run_id: int, model_path: str | None, test_size: float = 0.20) -> DataFrame:
    """The stored form of one training run."""
    spark = training.metrics.sparkSession
    report = training.report.agg(
        F.array_sort(F.collect_list(F.struct("label", "precision", "recall", "f1", "support")))
    ).scalar()
    cm = training.confusion.agg(F.array_sort(F.collect_list(F.struct("actual", "predicted", "n")))).scalar()
    importances = training.model.importances(spark).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
    ).scalar()
    return training.metrics.select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(training.model.model_type).alias("model_type"),
        "accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro",
        report.alias("classification_report"), cm.alias("confusion_matrix"),
        importances.alias("feature_importances"), F.lit(training.model.n_estimators).alias("n_estimators"),
        F.lit(test_size).alias("test_size"),
        F.lit(training.split_counts.get("train", 0)).cast("bigint").alias("training_samples"), "test_samples",
        F.lit(model_path).cast("string").alias("model_path"), F.current_timestamp().alias("created_at"),
    )


def train_and_score(df: DataFrame, out: str, run_id: int, **options: object) -> tuple[Training, DataFrame]:
    """Train, store model and metrics, predict the unlabelled rows and back-fill them."""
    spark = df.sparkSession
    training = train_severity(df, **options)
    path = f"{out}/model_{run_id}"
    training.model.save(spark, path)
    replace_run(metrics_row(training, run_id, path), f"{out}/model_metrics", run_id)
    stored = SeverityModel.load(spark, path)
    replace_table(fill_unknown(stored, df), f"{out}/incidents_scored_{run_id}")
    return training, read_table(spark, f"{out}/incidents_scored_{run_id}")


def extract_offline(df: DataFrame, out: str, run_id: int) -> DataFrame:
    """Extract cause and phase of the pending reports from their phrases; no remote model needed."""
    path = f"{out}/incidents_extracted_{run_id}"
    replace_table(fill_by_keywords(df), path)
    return read_table(df.sparkSession, path)


def prepare_prompts(df: DataFrame, clusters: DataFrame, out: str, run_id: int, limit: int | None = 200) -> Sequence[str]:
    """Store the extraction and the cluster prompts of a run; replies come back through the apply steps."""
    targets = [f"{out}/extraction_prompts", f"{out}/cluster_prompts"]
    replace_run(extraction_prompts(df, limit, chars=vocab.EXTRACTION_CHARS), targets[0], run_id)
    short = cluster_prompts(clusters, df, sample_chars=vocab.SAMPLE_CHARS, name_chars=vocab.NAME_LIST_CHARS)
    replace_run(short, targets[1], run_id)
    return targets
