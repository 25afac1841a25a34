import random
import re

import numpy as np

from lorespark.llm import lookup, ngram_join

SCHEMA = "doc_id long, text string, n long, cls string"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[at : at + size]) for at in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [(key, shingles(text, size)) for key, text in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (ka, one) in enumerate(sets):
        for b, (kb, other) in enumerate(sets[:a]):
            if one and other and ka is not None and kb is not None and 100 * len(one & other) >= percent * len(one | other):
                parent[root(a)] = root(b)
    least = {}
    for at, (key, _) in enumerate(sets):
        if key is not None:
            least[root(at)] = min(key, least.get(root(at), key))
    return sorted(((key, len(own), least[root(at)] if key is not None else None) for at, (key, own) in enumerate(sets)), key=repr)


def corpus(seed, groups=12):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abcdeé") for _ in range(chance.randint(1, 3)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(chance.choice([1, 2, 3, 5, 30, 120, 300]))]
        for _ in range(chance.randint(1, 9)):
            words = list(base)
            for _ in range(chance.choice([0, 0, 1, 1, 2, 4])):
                words[chance.randrange(len(words))] = word()
            texts.append(" ".join(words))
            base = words if chance.random() < 0.4 else base
    texts += [" ".join([word() for _ in range(chance.randint(2, 12))] + passage) for _ in range(25)]
    chance.shuffle(texts)
    rows = list(enumerate(texts, 100))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, texts[0].upper()), (None, texts[0]), (None, texts[0]), (100, texts[0]), (101, "other text of the same id"), (5, "x y"), (6, "x  Y"), (7, "y x"), (8, "w " * 30_000)]


def result(spark, rows, **more):
    frame = spark.createDataFrame([(*row, 1, "") for row in rows], SCHEMA)
    return sorted(map(tuple, ngram_join.link(frame, **more).collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows, 3, 90)


def test_other_threshold_and_estimates_that_change_the_prefixes(spark):
    # With few counters nearly all tokens look frequent, so sets ask for several matches.
    rows = corpus(2, 8)
    assert result(spark, rows, size=5, percent=80, counter_bits=3) == brute(rows, 5, 80)


def test_prefixes_keep_every_partner():
    chance = np.random.default_rng(0)
    others = chance.integers(0, 50, 1 << ngram_join.COUNTER_BITS)
    for _ in range(300):
        one = np.unique(chance.integers(0, 2**64, chance.integers(1, 60), dtype=np.uint64))
        other = np.unique(np.concatenate([one[chance.random(len(one)) > 0.05], chance.integers(0, 2**64, 1, dtype=np.uint64)]))
        common = len(np.intersect1d(one, other))
        union = len(one) + len(other) - common
        if 100 * common >= 90 * union:
            (p, k), (q, m) = ngram_join.chosen_prefix(one, others, 90), ngram_join.chosen_prefix(other, others, 90)
            assert len(np.intersect1d(p, q)) >= min(k, m)
        assert ngram_join.differing_bits(ngram_join.parity_bits(one), ngram_join.parity_bits(other)) <= union - common


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    found = dict(lookup.components(edges).collect())
    assert found == {n: 0 for n in range(201)} | {500: 500, 501: 500}


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 1)]
