"""Incident analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from .operators.aggregates import (
    cluster_coverage,
    decade_chart,
    decade_trends,
    distribution_shares,
    extraction_coverage,
    extraction_distribution,
    label_counts,
    overview,
    overview_all,
    quick_stats,
    severity_distribution,
    summary_coverage,
    top_groups,
    top_groups_share,
    value_distribution,
    yearly_chart,
    yearly_trends,
)
from .operators.clusters import (
    by_size,
    cluster_cards,
    cluster_samples,
    cluster_stats,
    cluster_summaries,
    cluster_summary,
    real_clusters,
    summarised,
)
from .operators.density import default_eps, default_width, density_clusters, signature_clusters
from .operators.evaluation import (
    class_report,
    classification_metrics,
    confusion,
    confusion_from_json,
    importance_rows,
    metrics_full,
    metrics_history,
    metrics_summary,
    rounded_report,
    row_shares,
)
from .operators.features import build_features
from .operators.hierarchy import vector_clusters
from .operators.impute import fit_medians, median_impute
from .operators.prompts import (
    apply_cluster_replies,
    apply_replies,
    cluster_prompts,
    extract_by_keywords,
    extraction_prompts,
    fill_by_keywords,
    parse_cluster_replies,
    parse_replies,
)
from .operators.ranking import most_frequent, top_rows_per_group, top_values, top_values_of
from .operators.reduction import project_2d, reduce_dimensions
from .operators.search import (
    even_years,
    lookup,
    page_info,
    pending_extraction,
    point_labels,
    projection_points,
    search_incidents,
    select_incidents,
    table_rows,
)
from .operators.severity_model import SeverityModel, fill_unknown, label_index, label_name, score_unknown, train_severity
from .operators.split import stratified_split
from .operators.stats import (
    chi_square,
    chi_square_decade,
    chi_square_suite,
    contingency,
    correlation_insights,
    correlation_matrix,
    top_operator_rows,
)
from .operators.text import TfidfModel, embed_text, fit_tfidf
from .plans.dashboard import dashboard_header, dashboard_summary
from .plans.jobs import assign_clusters, build_clusters, extract_offline, prepare_prompts, train_and_score
from .session import build_session, sizing
from .sources.incidents import clean_incidents, read_incidents, read_incidents_csv, trainable
from .sources.postings import search_stored, stored_matches, write_searchable
from .sources.sinks import (
    backfill,
    backfill_bucketed,
    delete_unnamed,
    forget_run,
    one_per_key,
    open_bucketed,
    read_runs,
    read_table,
    replace_run,
    replace_table,
    store_bucketed,
    write_coordinates,
    write_incidents,
)

# Ship the few Python helpers with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("sys", "cloudpickle")]
