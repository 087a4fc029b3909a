"""Language identification: proportions of languages in a document by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, kept_in_worker, matching_points, mixed, place_of, share_of

#: Buckets that character trigrams are hashed to.
BUCKETS = 8192
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """``logs[l, b]``: log-probability of trigram bucket b in language l."""

    languages: tuple[str, ...]
    logs: np.ndarray


def letters_table() -> np.ndarray:
    return kept_in_worker("letters", lambda: matching_points(r"[^\W\d_]"))


def trigram_counts(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the trigrams of lower-case letters, other runs being one gap."""
    points, marks = code_points([t.lower() for t in texts])
    is_letter = letters[points]
    before = np.concatenate(([False], is_letter[:-1]))
    keep = is_letter | before | (points == 0)  # of a run without letters only the first character stays
    values = np.where(is_letter, points, 0)[keep].astype(np.uint64)
    doc = (np.cumsum(points == 0) - 1)[keep]
    with np.errstate(over="ignore"):
        grams = values[:-2] + values[1:-1] * np.uint64(1 << 21) + values[2:] * np.uint64(1 << 42)
        bucket = (mixed(grams) >> np.uint64(51)).astype(np.int64)
    inside = (doc[:-2] == doc[2:]) & (values[1:-1] > 0)  # around a letter
    found, n = np.unique((doc[:-2] * BUCKETS + bucket)[inside], return_counts=True)
    return found // BUCKETS, found % BUCKETS, n


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          most_rows: int = 4000, smoothing: float = 0.5) -> LanguageModel:
    """Trigram distribution of each language, from at most about ``most_rows`` documents of each.

    ``most_rows`` bounds the sample: the share of a language's rows that is read follows
    from its row count, and rows are chosen by a hash of their id. Whole texts are
    counted in the tasks and summed by Spark; what comes back is one row per language
    and bucket. Rows without text or language are not used.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(share_of(most_rows, sizes[lang]))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letters_table(), np.zeros((len(languages), BUCKETS), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                doc, bucket, n = trigram_counts(texts[a:b], letters)
                np.add.at(total, (np.array([number[x] for x in langs[a:b]])[doc], bucket), n)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])],
                                         names=["lang", "bucket", "n"])

    counted = rows.where("text is not null").where(place_of("id") < share).select("text", "lang") \
        .mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.full((len(languages), BUCKETS), smoothing)
    for lang, bucket, n in counted:
        counts[lang, bucket] += n
    return LanguageModel(languages, np.log(counts / counts.sum(1, keepdims=True)) if languages else counts)


def mixtures(doc: np.ndarray, logs: np.ndarray, n: np.ndarray, docs: int, penalty: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (docs x languages) and the log-likelihood gained over the best single language.

    ``logs`` has the log-probabilities of each (document, bucket) row. Expectation-
    maximisation over all languages gives the largest likelihood any set can reach; a
    document whose gain does not pay the penalty of a second language gets its best
    single language, which is then the exact optimum of the penalised likelihood. For
    the others the least language leaves the set as long as the penalised likelihood
    rises.
    """
    languages = logs.shape[1]
    starts = np.searchsorted(doc, np.arange(docs + 1))
    filled = starts[1:] > starts[:-1]
    place = starts[:-1][filled]

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros((docs, *values.shape[1:]))
        if len(place):
            out[filled] = np.add.reduceat(values, place, axis=0)
        return out

    total = summed(n.astype(float))
    single = summed(logs * n[:, None])
    best = single.argmax(1)
    shares = np.zeros((docs, languages))
    shares[np.arange(docs), best] = 1
    gain = np.zeros(docs)
    if languages < 2 or not len(doc):
        return shares, gain
    cost = penalty * 0.5 * np.log(np.maximum(total, 2))

    def fit(rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihood of the documents ``rows`` with their allowed languages."""
        pi = allowed / allowed.sum(1, keepdims=True)
        reached, active = np.zeros(len(rows)), np.arange(len(rows))
        for _ in range(rounds):
            wanted = np.zeros(docs, np.int64) - 1
            wanted[rows[active]] = np.arange(len(active))
            own = wanted[doc]
            use = own >= 0
            own, rel, count = own[use], logs[use], n[use]
            top = rel.max(1)
            p = np.exp(rel - top[:, None])
            first = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
            q = np.einsum("ij,ij->i", p, pi[active][own])
            value = np.add.reduceat(count * (np.log(np.maximum(q, 1e-300)) + top), first)
            slope = np.add.reduceat(p * (count / np.maximum(q, 1e-300))[:, None], first, axis=0) / total[rows[active]][:, None]
            reached[active] = value
            fresh = pi[active] * slope
            pi[active] = fresh / fresh.sum(1, keepdims=True)
            # no mixture of the allowed languages is better by more than this
            left = total[rows[active]] * np.log(np.maximum((slope * allowed[active]).max(1), 1))
            going = (left > 0.1) & ((value + left - single[rows[active], best[rows[active]]]) > cost[rows[active]])
            active = active[going]
            if not len(active):
                break
        return pi, reached

    rows = np.flatnonzero(filled)
    allowed = np.ones((len(rows), languages))
    pi, reached = fit(rows, allowed)
    alone = single[rows, best[rows]]
    pays = reached - alone > cost[rows]
    rows, pi, reached, allowed = rows[pays], pi[pays], reached[pays], allowed[pays]
    score = reached - (languages - 1) * cost[rows]
    open_ = np.arange(len(rows))
    kept, value = pi.copy(), score.copy()
    while len(open_):
        cur = np.where(allowed[open_] > 0, pi[open_], np.inf)
        allowed[open_, cur.argmin(1)] = 0
        smaller, reach = fit(rows[open_], allowed[open_])
        pi[open_] = smaller
        worth = reach - (allowed[open_].sum(1) - 1) * cost[rows[open_]]
        better = worth >= value[open_]
        kept[open_[better]], value[open_[better]] = smaller[better], worth[better]
        open_ = open_[better & (allowed[open_].sum(1) > 2)]
    mixed_set = value > single[rows, best[rows]]
    shares[rows[mixed_set]] = kept[mixed_set]
    gain[rows[mixed_set]] = value[mixed_set] - single[rows, best[rows]][mixed_set]
    return shares, gain


def least_fit(model: LanguageModel, shares: np.ndarray, n: np.ndarray, way: float = 1 / 3, deviations: float = 3.0) -> np.ndarray:
    """Least mean log-likelihood per trigram of texts that are in the model's languages, for texts of ``n`` trigrams.

    It lies a part ``way`` of the way from what the texts the model learned from reach to
    what trigrams reach that have nothing to do with the language, each as the mixture has
    it; lower for short texts, whose mean varies. Neighbouring trigrams overlap, so three
    count as one.
    """
    p = np.exp(model.logs)
    learned, foreign = (p * model.logs).sum(1), model.logs.mean(1)
    spread = np.sqrt(np.maximum((p * model.logs**2).sum(1) - learned**2, 0))
    return shares @ (learned + way * (foreign - learned)) - deviations * (shares @ spread) * np.sqrt(3 / np.maximum(n, 1))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0, with_fit: bool = False) -> DataFrame:
    """(id, lang_pred, score, shares): the main language of each whole text and its share.

    ``shares`` maps each language of the chosen set to its proportion. ``penalty``
    weighs the cost of one more language; neighbouring trigrams overlap, so each
    character counts three times. Null and empty texts, and texts without a letter, are
    "und" with score 0 and no shares; so is every text if the model knows no language.
    Repeated rows give repeated rows, ties go to the language first in the alphabet,
    other columns are not read. ``with_fit`` adds ``fit``, the mean log-likelihood of a
    trigram under the text's mixture (null without letters), and ``least_fit``.
    """
    languages, logs = model.languages, model.logs.T.copy() if model.languages else model.logs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_table()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score, shares = [UNKNOWN] * len(texts), np.zeros(len(texts)), [{} for _ in texts]
            fit, least = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            for a, b in chunks(texts) if languages else ():
                doc, bucket, n = trigram_counts(texts[a:b], letters)
                pi, _ = mixtures(doc, logs[bucket], n, b - a, penalty)
                known = np.zeros(b - a, bool)
                known[doc] = True
                if with_fit and len(doc):
                    sizes = np.bincount(doc, n, b - a)
                    reached = np.bincount(doc, n * np.log(np.einsum("ij,ij->i", np.exp(logs[bucket]), pi[doc])), b - a)
                    fit[a:b] = np.where(known, reached / np.maximum(sizes, 1), np.nan)
                    least[a:b] = np.where(known, least_fit(model, pi, sizes), np.nan)
                for i in np.flatnonzero(known).tolist():
                    top = int(pi[i].argmax())
                    pred[a + i], score[a + i] = languages[top], min(1.0, float(pi[i, top]))
                    shares[a + i] = {languages[k]: float(pi[i, k]) for k in np.flatnonzero(pi[i] > 1e-6).tolist()}
            fits = [pa.array(fit, from_pandas=True), pa.array(least, from_pandas=True)] if with_fit else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred), pa.array(score), pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.float64())), *fits],
                names=["id", "lang_pred", "score", "shares", *(["fit", "least_fit"] if with_fit else [])])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, shares map<string,double>" + (", fit double, least_fit double" if with_fit else ""))
