import random

import numpy as np
from pyspark.sql import functions as F

from lorespark.llm import quality
from lorespark.llm.queries import op13_quality

SCHEMA = "doc_id long, text string, score string, strength string"
WORDS = "the of rend and threlyes house river stone walks under bright morning light with many small birds".split()


def clean(chance):
    return ". ".join(" ".join(chance.choices(WORDS, k=8)).capitalize() for _ in range(6)) + "."


def junk(chance):
    return chance.choice([clean(chance).upper() + "!!", "buy " * 60, clean(chance).replace(" ", "### ")])


def data(count=240):
    chance = random.Random(4)
    rows = [(n, clean(chance) if n % 3 else junk(chance), "x", "y") for n in range(count)]
    return rows, [(n, int(n % 3 > 0), 0) for n in range(count)]


def test_learns_and_ranks_unseen_texts(spark):
    rows, labels = data()
    rows += [(1000, None, "", ""), (1001, "", "", ""), (None, rows[1][1], "", ""), (1, rows[1][1], "", ""), (1002, rows[0][1] * 900, "", "")]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5, None, 1), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known, F.col("doc_id") < 160, rows_per_label=60)
    scored = quality.above(quality.score(docs, model)).collect()
    assert len(scored) == len(rows) and all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in scored)
    held = [row for row in scored if row.doc_id is not None and 160 <= row.doc_id < 240]
    assert all(row.predicted == int(row.doc_id % 3 > 0) for row in held)
    assert len({row.score for row in scored if row.doc_id in (1000, 1001)}) == 1  # null like empty
    assert len({row.score for row in scored if row.doc_id in (1, None)}) == 1
    again = quality.fit(docs.repartition(7), known, F.col("doc_id") < 160, rows_per_label=60)
    np.testing.assert_allclose(again.weights, model.weights, rtol=1e-9)


def test_weights_maximise_the_likelihood_of_the_pairs():
    chance = np.random.default_rng(1)
    rows = chance.normal(size=(40, 3))
    good, bad = np.arange(20), np.arange(20, 40)
    rows[good, 0] += 1
    preferred, other = quality.preferences(good, bad, 6)
    weights = quality.strengths(rows, preferred, other, 0.01, 500)

    def loss(w):
        gap = (rows[preferred] - rows[other]) @ w
        return np.log1p(np.exp(-gap)).mean() + 0.005 * w @ w

    gradient = [(loss(weights + step) - loss(weights - step)) / 2e-5 for step in np.eye(3) * 1e-5]
    np.testing.assert_allclose(gradient, 0, atol=1e-6)


def test_every_document_has_its_opponents():
    for n_good, n_bad in ((1, 1), (5, 2), (2, 5), (30, 7), (7, 30)):
        good, bad = np.arange(n_good), 100 + np.arange(n_bad)
        preferred, other = quality.preferences(good, bad, 4)
        assert len(set(zip(preferred.tolist(), other.tolist()))) == len(preferred) == max(n_good, n_bad) * min(4, n_good, n_bad)
        assert set(preferred.tolist()) == set(good.tolist()) and set(other.tolist()) == set(bad.tolist())


def test_features_do_not_cross_texts():
    chance = random.Random(9)
    texts = ["", clean(chance), "É漢", "A", clean(chance).upper(), "", "same same Same"]
    encoded = [text.encode() for text in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in encoded]))
    together = quality.features(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    for at, text in enumerate(encoded):
        alone = quality.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        np.testing.assert_allclose(together[at], alone[0])
    assert not together[0].any()


def test_cut_at_the_quantile():
    values = np.array([3.0, 1.0, 2.0, 10.0])
    assert quality.weighted_quantile(values, np.ones(4), 0.5) == 2.5
    assert quality.weighted_quantile(values, np.array([1, 1, 1, 7.0]), 0.3) == 6.5


def test_one_kind_of_label_only_and_empty_tables(spark):
    docs = spark.createDataFrame(data(6)[0], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.lit(True))
    assert {row.score for row in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.fit(docs.limit(0), labels.limit(0), F.lit(True)).cut_score == 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {row.doc_id: row.quality for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [row for row in op13_quality(spark, folder).collect() if row.held_out and row.doc_id in truth]
    right = sum(row.predicted == truth[row.doc_id] for row in held)
    assert len(held) > 60 and right >= 0.97 * len(held)


def test_every_labelled_row_counts(spark):
    """The weights are the optimum over the pairs of all groups, and the cut their quantile: a sample has another."""
    rows, labels = data(300)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learnt = [[text.encode() for n, text, *_ in rows if (n % 3 > 0) == good] for good in (True, False)]
    good, bad = (quality.features(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(text) for text in texts]))).astype(np.float32).astype(float) for texts in learnt)
    for per_label, opponents in ((1000, 12), (30, 10**6)):
        model = quality.fit(docs, known, F.lit(True), rows_per_label=per_label, opponents=opponents)
        values = np.sort(np.concatenate([good, bad]) @ model.weights - model.center @ model.weights)
        assert abs(model.cut - (values[99] + values[100]) / 2) < 1e-8
        np.testing.assert_allclose(model.center, (good.mean(axis=0) + bad.mean(axis=0)) / 2, atol=1e-9)
    # In seven groups the 100 rare rows stand in five each; a good row meets all those of its group.
    groups, copies = 7, 5
    own = {row.n: row.g for row in spark.range(300).select(F.col("id").alias("n"), F.pmod(F.xxhash64(F.lit("quality group"), F.col("id").cast("string")), F.lit(groups)).alias("g")).collect()}
    numbers = [[n for n, *_ in rows if (n % 3 > 0) == good] for good in (True, False)]
    gradient, pairs = 1e-4 * model.weights, 0
    parts = np.zeros(quality.FEATURES)
    for group in range(groups):
        ours = good[[own[n] == group for n in numbers[0]]]
        theirs = bad[[(group - own[n]) % groups < copies for n in numbers[1]]]
        gap = (ours @ model.weights)[:, None] - (theirs @ model.weights)[None, :]
        lost = 1 / (1 + np.exp(gap))
        parts += lost.sum(axis=0) @ theirs - lost.sum(axis=1) @ ours
        pairs += gap.size
    np.testing.assert_allclose(gradient + parts / pairs, 0, atol=1e-9)
