"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language in every task, adds the counts up in
Spark and brings one matrix of bounded size to the driver, which is broadcast.
Scoring adds the log-probability rows of a text's n-grams, batch by batch.

The model is fitted on a sample whose size is a documented bound: about
`rows_per_language` rows of each language, chosen by a hash of the id. Scoring
covers all rows and whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0 and is
not learned from, nor is a row without a language or an id; without any training
row everything is `und`. Rows are kept one to one, repeated rows and null ids
included. Equal scores go to the language that sorts first. Columns other than
those named are ignored. More than MAX_LANGUAGES languages raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.arrays import bounded_batches, drop_model, mix, text_slices

BUCKET_BITS = 15
MAX_LANGUAGES = 500
UNDETERMINED = "und"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probabilities: np.ndarray  # bucket x language
    log_priors: np.ndarray
    orders: tuple[int, ...]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_buckets(texts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams of the lower-cased, blank-padded texts, and the place where each text's begin."""
    padded = [f" {text.lower()} ".encode("utf-32-le", "replace") for text in texts]
    sizes = np.array([len(one) // 4 for one in padded], np.int64)
    codes = np.frombuffer(b"".join(padded), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    for order in orders:
        # Padding makes a text at least two long; longer orders see shorter texts cut at their end.
        sums = sum(codes[at : len(codes) - order + 1 + at] * _STEPS[at % 4] for at in range(order)) if len(codes) >= order else np.empty(0, np.uint64)
        inside = np.ones(len(sums), np.bool_)
        for gap in range(1, order):
            crossing = ends[:-1] - gap
            inside[crossing[(crossing >= 0) & (crossing < len(sums))]] = False
        kept = np.maximum(sizes - order + 1, 0)
        yield (mix(sums[inside] + np.uint64(order)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.cumsum(kept) - kept


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 10_000, orders: tuple[int, ...] = (2, 3), smoothing: float = 0.1) -> LanguageModel:
    """Learn from the rows for which `learn` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counted = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(row.lang for row in counted)
    share = {row.lang: min(1.0, rows_per_language / row.n) for row in counted}
    buckets = 1 << BUCKET_BITS
    if not languages:
        return LanguageModel([], np.empty((buckets, 0)), np.empty(0), orders)
    number = {language: at for at, language in enumerate(languages)}
    chance = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col).cast("string")), F.lit(1_000_000)) / 1e6
    sampled = rows.filter(chance < F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col(lang_col)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_model()
        counts = np.zeros(len(languages) * buckets, np.int64)
        documents = np.zeros(len(languages), np.int64)
        for batch in batches:
            numbers = np.array([number[language] for language in batch.column(0).to_pylist()], np.int64)
            for first, _, offsets in text_slices(batch.column(1)):
                texts = batch.column(1).slice(first, len(offsets) - 1).to_pylist()
                chosen = [at for at, text in enumerate(texts) if has_letter(text)]
                owners = numbers[first : first + len(texts)][chosen]
                documents += np.bincount(owners, minlength=len(languages))
                for found, starts in gram_buckets([texts[at] for at in chosen], orders):
                    owner = np.repeat(owners, np.diff(np.append(starts, len(found))))
                    counts += np.bincount(owner * buckets + found, minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cells, -1 - np.arange(len(languages))])), pa.array(np.concatenate([counts[cells], documents]))], ["cell", "n"])

    totals = sampled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, values = totals["cell"].to_numpy(), totals["n"].to_numpy()
    counts = np.zeros((len(languages), buckets))
    counts[cells[cells >= 0] // buckets, cells[cells >= 0] % buckets] = values[cells >= 0]
    seen = np.array([share_n for _, share_n in sorted((-1 - cell, n) for cell, n in zip(cells, values) if cell < 0)], np.float64)
    taught = np.flatnonzero(seen) if len(seen) else np.empty(0, np.int64)
    smoothed = counts[taught] + smoothing
    prior = np.array([row.n for row in sorted(counted, key=lambda row: row.lang)], np.float64)[taught]
    return LanguageModel([languages[at] for at in taught], np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T.copy(), np.log(prior / prior.sum()), orders)


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability of each text."""
    chosen = [at for at, text in enumerate(texts) if has_letter(text)] if model.languages else []
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not chosen:
        return names, scores
    sums = np.tile(model.log_priors, (len(chosen), 1))
    for found, starts in gram_buckets([texts[at] for at in chosen], model.orders):
        if len(found):
            # reduceat wants a place inside the list; a text without n-grams of this order adds nothing
            part = np.add.reduceat(model.log_probabilities[found], np.minimum(starts, len(found) - 1), axis=0)
            part[np.diff(np.append(starts, len(found))) == 0] = 0
            sums += part
    best = sums.argmax(axis=1)
    posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    for at, place, value in zip(chosen, best, posterior):
        names[at], scores[at] = model.languages[place], value
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `lang_pred` and `score` of every row."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, offsets in text_slices(batch.column(1)):
                rows = len(offsets) - 1
                names, scores = score_texts(shipped.value, batch.column(1).slice(first, rows).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(names, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, whose language is determined with at least `min_score`."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, offsets in text_slices(batch.column(place)):
                part = batch.slice(first, len(offsets) - 1)
                names, scores = score_texts(shipped.value, part.column(place).fill_null("").to_pylist())
                yield part.filter(pa.array((np.array(names) != UNDETERMINED) & (scores >= min_score)))

    return docs.mapInArrow(work, docs.schema)
