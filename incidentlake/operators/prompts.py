"""Prompt texts for the extraction steps and the way back from the replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import replies as R
from ..functions import vocab
from ..schema import NOISE, UNKNOWN
from ..sources.sinks import one_per_key
from .clusters import cluster_samples
from .search import pending_extraction


def fill(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a text."""
    pieces, rest = [], template
    while rest:
        places = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, name = min(places)
        pieces += [F.lit(rest[:at]), values[name].cast("string")]
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def _first(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def extraction_prompts(df: DataFrame, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """One prompt per pending report, from its whole text or its first ``chars`` characters.

    Blank summaries need no request and get none; ``apply_replies`` gives them the defaults.
    """
    text = C.strip("summary")
    return pending_extraction(df, limit).where(text != "").select(
        "id", fill(vocab.EXTRACTION_PROMPT, summary=_first(text, chars)).alias("prompt")
    )


def _name_list(c: str, chars: int | None) -> Column:
    return C.or_text(_first(F.concat_ws(", ", c), chars), "Various")


def cluster_prompts(
    clusters: DataFrame, df: DataFrame, sample_chars: int | None = None, name_chars: int | None = None,
    samples: int = vocab.SAMPLES_PER_CLUSTER,
) -> DataFrame:
    """One prompt per real cluster, built from its figures and its deadliest reports.

    Reports and name lists are whole unless ``sample_chars`` or ``name_chars`` shorten them.
    Clusters without any text have a null prompt and carry the fixed default
    texts instead.
    """
    best = cluster_samples(df, clusters, samples).where(F.col("summary") != "")
    body = C.strip("summary")
    shortened = body if sample_chars is None else F.concat(
        F.substring(body, 1, sample_chars), F.when(F.length("summary") > sample_chars, "...").otherwise(""),
    )
    # At most ``samples`` texts per cluster are gathered here.
    listed = best.select("cluster_id", F.struct("rank", shortened.alias("text")).alias("s")).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list("s")).alias("s")
    )
    numbered = F.transform(
        "s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])
    )
    texts = listed.select(F.col("cluster_id").alias("cluster_label"), F.array_join(numbered, "\n\n").alias("summaries"))

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    prompt = fill(
        vocab.CLUSTER_PROMPT, count=F.col("incident_count"), year_start=known("year_range_start"),
        year_end=known("year_range_end"), severity=known("dominant_severity"),
        fatality_rate=C.percent_text(F.coalesce("avg_fatality_rate", F.lit(0.0))),
        operators=_name_list("top_operators", name_chars), aircraft=_name_list("top_aircraft_types", name_chars),
        summaries=F.col("summaries"),
    )
    real = clusters.where(F.col("cluster_label") != NOISE)
    no_text = F.col("summaries").isNull()
    return real.join(texts, "cluster_label", "left").select(
        "cluster_label", F.when(~no_text, prompt).alias("prompt"),
        F.when(no_text, fill(vocab.NO_TEXT_SUMMARY, label=F.col("cluster_label"))).alias("default_summary"),
        F.when(no_text, F.lit(vocab.NO_TEXT_RECOMMENDATION)).alias("default_recommendations"),
    )


def parse_replies(df: DataFrame, reply: str = "reply", factors: int | None = vocab.INCIDENT_FACTORS) -> DataFrame:
    """Normalised extraction fields beside the input columns; unreadable replies give the defaults.

    The first ``factors`` contributing factors are kept, all if null.
    """
    parsed = df.withColumn("_reply", R.reply_json(F.col(reply)))
    r = F.col("_reply")

    def truth(name: str) -> Column:
        return F.coalesce(R.field(r, name, "boolean"), F.lit(False)).alias(name)

    return parsed.select(
        *df.columns,
        R.normal_cause(R.field(r, "cause_category")).alias("cause_category"),
        R.normal_phase(R.field(r, "phase_of_flight")).alias("phase_of_flight"),
        R.clean_list(R.field(r, "contributing_factors", "array<string>"), factors)
        .alias("contributing_factors"),
        truth("is_mechanical_failure"), truth("is_weather_related"), truth("is_human_error"),
    )


def parse_cluster_replies(df: DataFrame, reply: str = "reply", factors: int | None = vocab.CLUSTER_FACTORS) -> DataFrame:
    """Cleaned cluster summary fields beside the input columns, with the first ``factors`` factors (all if null)."""
    parsed = df.withColumn("_reply", R.reply_json(F.col(reply)))
    r = F.col("_reply")
    return parsed.select(
        *df.columns,
        R.clean_text(R.field(r, "root_cause_summary")).alias("root_cause_summary"),
        R.clean_list(R.field(r, "key_contributing_factors", "array<string>"), factors)
        .alias("key_contributing_factors"),
        R.clean_text(R.field(r, "recommendations")).alias("recommendations"),
    )


def apply_replies(df: DataFrame, replies: DataFrame, key: str = "id") -> DataFrame:
    """Write extracted fields of answered reports into the incidents, stamped with the time.

    ``replies`` is (key, reply) and may have the column ``order``. Of several replies
    for a key the one with the highest ``order`` counts, without that column the last in
    the alphabet. A pending report with a blank text needs no reply: it gets the default
    fields. Other reports without a reply keep their fields.
    """
    parsed = parse_replies(one_per_key(replies, key, ["reply"])).select(
        key, F.lit(True).alias("_answered"), "cause_category", "phase_of_flight", "contributing_factors"
    )
    joined = df.join(parsed, key, "left")
    source = {
        "extracted_cause_category": F.col("cause_category"),
        "extracted_phase_of_flight": F.col("phase_of_flight"),
        "extracted_contributing_factors": F.col("contributing_factors"),
        "extracted_at": F.current_timestamp(),
    }
    kinds = {"extracted_contributing_factors": "array<string>", "extracted_at": "timestamp"}
    defaults = {
        "extracted_cause_category": F.lit(UNKNOWN), "extracted_phase_of_flight": F.lit(UNKNOWN),
        "extracted_contributing_factors": F.array().cast("array<string>"), "extracted_at": F.current_timestamp(),
    }
    blank = F.lit(False)
    if {"summary", "extracted_cause_category"} <= set(df.columns):
        blank = F.coalesce(F.col("extracted_cause_category").isNull() & (C.strip("summary") == ""), F.lit(False))

    def merged(name: str) -> Column:
        old = F.col(name) if name in df.columns else F.lit(None).cast(kinds.get(name, "string"))
        return F.when(F.col("_answered"), source[name]).when(blank, defaults[name]).otherwise(old).alias(name)

    return joined.select(*[F.col(c) for c in df.columns if c not in source], *[merged(c) for c in source])


def apply_cluster_replies(clusters: DataFrame, replies: DataFrame) -> DataFrame:
    """Write summaries into the clusters; ``replies`` is (cluster_label, reply), one per label as in ``apply_replies``."""
    parsed = parse_cluster_replies(one_per_key(replies, "cluster_label", ["reply"])).select(
        "cluster_label", F.lit(True).alias("_answered"),
        *[F.col(c).alias(f"_{c}") for c in ("root_cause_summary", "key_contributing_factors", "recommendations")],
    ).withColumn("_summarized_at", F.current_timestamp())
    joined = clusters.join(parsed, "cluster_label", "left")
    fields = ("root_cause_summary", "key_contributing_factors", "recommendations", "summarized_at")
    return joined.select(
        *[F.col(c) for c in clusters.columns if c not in fields],
        *[
            F.when(F.col("_answered"), F.col(f"_{c}"))
            .otherwise(F.col(c) if c in clusters.columns else F.lit(None)).alias(c)
            for c in fields
        ],
    )


def _by_keywords(lowered: Column) -> tuple[Column, Column]:
    cause = F.coalesce(*[
        F.when(C.matches(lowered, vocab.SUMMARY_PATTERNS[p], vocab.PHRASE_NEEDS.get(p, ())), F.lit(value))
        for p, value in vocab.CAUSE_BY_PHRASE.items()
    ], F.lit(UNKNOWN))
    phase = F.coalesce(*[
        F.when(C.matches(lowered, pattern, vocab.PHASE_NEEDS[value]), F.lit(value))
        for value, pattern in vocab.PHASE_PATTERNS.items()
    ], F.lit(UNKNOWN))
    return cause, phase


def extract_by_keywords(df: DataFrame) -> DataFrame:
    """Cause and phase read from report phrases, without any remote model."""
    cause, phase = _by_keywords(F.col("text"))
    rows = df.select("id", F.lower("summary").alias("text"))
    return rows.select("id", cause.alias("cause_category"), phase.alias("phase_of_flight"))


def fill_by_keywords(df: DataFrame) -> DataFrame:
    """Fill the extracted fields of the pending reports from their phrases, row by row."""
    pending = F.col("summary").isNotNull() & F.col("extracted_cause_category").isNull()
    cause, phase = _by_keywords(F.col("_text"))
    rows = df.withColumns({"_text": F.lower("summary"), "_pending": pending})
    return rows.withColumns({
        "extracted_cause_category": F.when(F.col("_pending"), cause).otherwise(F.col("extracted_cause_category")),
        "extracted_phase_of_flight": F.when(F.col("_pending"), phase).otherwise(F.col("extracted_phase_of_flight")),
    }).drop("_text", "_pending")
