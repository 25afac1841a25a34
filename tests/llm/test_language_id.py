import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lorespark.llm import language_id
from lorespark.llm.queries import op5_language_id

SCHEMA = "doc_id long, text string, lang string, score string"


def test_scores_are_those_of_plain_naive_bayes(spark):
    rows = [(1, "the cat and the dog", "en", ""), (2, "der Hund und die Katze", "de", ""), (3, "und the", "en", ""), (4, None, "fr", ""), (5, "ja", None, ""), (6, "12 34", "es", ""), (None, "le chat", "fr", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(frame, F.lit(True))
    assert model.languages == ["de", "en"]
    grams = lambda text: [g for found, _ in language_id.gram_buckets([text], (2, 3)) for g in found.tolist()]
    counts = {lang: Counter(g for _, text, own, _ in rows if own == lang for g in grams(text)) for lang in ("de", "en")}
    for row in language_id.predict(frame, model).collect():
        text = next(text for key, text, _, _ in rows if key == row.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        logs = {lang: math.log({"de": 1, "en": 2}[lang] / 3) + sum(math.log((own[g] + 0.1) / (own.total() + 0.1 * 2**language_id.BUCKET_BITS)) for g in grams(text)) for lang, own in counts.items()}
        best = max(logs, key=logs.get)
        assert row.lang_pred == best
        assert math.isclose(row.score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-9)


def test_grams_do_not_cross_texts():
    texts = ["abc", "d", "é漢", "x" * 50]
    together = list(language_id.gram_buckets(texts, (1, 2, 3, 4)))
    for order, (found, starts) in zip((1, 2, 3, 4), together):
        bounds = [*starts.tolist(), len(found)]
        for at, text in enumerate(texts):
            (alone, _), = language_id.gram_buckets([text], (order,))
            assert np.array_equal(found[bounds[at] : bounds[at + 1]], alone)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {row.doc_id: (row.lang, row.text) for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [row for row in op5_language_id(spark, folder).collect() if row.held_out]
    right = sum(row.lang_pred == truth[row.doc_id][0] for row in held)
    assert len(held) > 200 and right >= 0.97 * len(held)


def test_nothing_to_learn_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "word", None, ""), (1, "word", None, "")], SCHEMA)
    model = language_id.fit(frame, F.lit(True))
    assert [(r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()] == [("und", 0.0)] * 2
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.predict(empty, language_id.fit(empty, F.lit(True))).collect() == []
    assert language_id.keep_identified(frame, model).collect() == []


def test_a_sample_of_bounded_size_and_whole_rows(spark):
    rows = [(n, ("the thing " if n % 2 else "das Ding ") * 5, "en" if n % 2 else "de", "s") for n in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(frame, F.lit(True), rows_per_language=50)
    kept = language_id.keep_identified(frame.unionByName(spark.createDataFrame([(500, "?!", "en", None)], SCHEMA)), model)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
