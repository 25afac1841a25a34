import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import repeats, substring_dedup, suffix_dedup
from lorespark.llm.repeats import Units, Window

SCHEMA = "doc_id long, text string, spans string, id int"


def different(rows):
    return list({(key, text) for key, text in rows if key is not None and text})


def brute_bytes(rows, length, keep_first=False):
    seen = defaultdict(list)
    for key, text in different(rows):
        data = text.encode()
        for at in range(len(data) - length + 1):
            seen[data[at : at + length]].append((key, text, at))
    least = {window: min(places, key=lambda p: (p[0], p[2])) for window, places in seen.items()}
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        if key is not None:
            for at in range(len(data) - length + 1):
                window = data[at : at + length]
                if len(seen[window]) > 1 and not (keep_first and least[window] == (key, text, at)):
                    gone[at : at + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((key, len(data), int(gone.sum()), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def brute_words(rows, size):
    least = {}
    split = lambda text: [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    for key, text in different(rows):
        words = split(text)
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            least[window] = min(key, least.get(window, key))
    out = []
    for key, text in rows:
        words = split(text)
        gone = [False] * len(words)
        if key is not None:
            for at in range(len(words) - size + 1):
                if least[tuple(words[at : at + size])] < key:
                    gone[at : at + size] = [True] * size
        out.append((key, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed):
    chance = random.Random(seed)
    word = lambda: "".join(chance.choice("abé,D") for _ in range(chance.randint(1, 6)))
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(chance.choice([12, 20, 40, 80, 150])) for _ in range(6)]
    rows = []
    for key in range(60):
        words = []
        for _ in range(chance.randint(0, 4)):
            words += fresh(chance.randint(0, 30))
            passage = chance.choice(passages)
            start = chance.randint(0, len(passage) // 2)
            words += passage[start : start + chance.randint(5, 200)]
            if chance.random() < 0.2:
                words += passage
        rows.append((key, chance.choice([" ", "  ", "\n"]).join(words)))
    common = fresh(30)
    rows += [(100 + n, " ".join(fresh(3) + common + fresh(3))) for n in range(60)]
    rows += [(200 + n, rows[n][1]) for n in range(5)] + [(300, "ab" * 400), (301, "z " * 600), (302, "z " * 100 + "y"), (303, None), (304, ""), (None, rows[0][1]), (None, None)]
    rows += [rows[3], rows[3], (3, "another text of the same id " + " ".join(common)), (305, " ".join(fresh(4000) + passages[0] + fresh(3000)))]
    chance.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, "clash", 1) for row in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("hot", [2000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_bytes_against_brute_force(spark, hot, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    rows = corpus(1)
    found = suffix_dedup.dedup(frame(spark, rows), 40, keep_first).collect()
    got = sorted(((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.removed), len(r.removed), bytes(r.kept)) for r in found), key=repr)
    assert got == brute_bytes(rows, 40, keep_first)


@pytest.mark.parametrize("hot", [2000, 3])
def test_words_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    rows = corpus(2)
    found = substring_dedup.dedup(frame(spark, rows), 12).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.removed), r.kept) for r in found), key=repr)
    assert got == brute_words(rows, 12)


def test_runs_share_out_all_windows():
    chance = np.random.default_rng(0)
    units = chance.integers(0, 3, 400).astype(np.uint64)
    bounds = np.array([0, 5, 5, 120, 131, 400])
    runs = repeats.runs_of(units, bounds, Window(12, 3))
    windows = [at for a, b in zip(runs.first, runs.last) for at in range(a, b + 1)]
    assert windows == [at for a, b in zip(bounds, bounds[1:]) for at in range(a, b - 11)]
    assert ((runs.anchor >= runs.last) & (runs.anchor + 3 <= runs.first + 12)).all()


def test_suffix_ranks_are_in_suffix_order():
    chance = np.random.default_rng(1)
    data = chance.integers(97, 99, 300).astype(np.uint8)
    for depth in (3, 8, 20, 200):
        ranks = suffix_ranks = suffix_dedup.suffix_ranks(data, depth)
        prefixes = [data[at : at + depth].tobytes().ljust(depth, b"\0") for at in range(300)]
        order = sorted(set(prefixes))
        assert [order[rank - 1] for rank in ranks] == prefixes if depth >= 8 else len(set(suffix_ranks.tolist())) >= len(order)


def test_index_finds_all_intervals():
    chance = np.random.default_rng(2)
    texts, bounds, owners = chance.integers(5, 9, 500).astype(np.uint64), np.array([0, 100, 101, 101, 350, 500]), np.array([7, 3, 9, 5, 1])
    index = substring_dedup.FMIndex(texts, bounds, owners)
    for size in (1, 2, 5):
        for _ in range(50):
            pattern = chance.integers(5, 9, size).astype(np.uint64)
            low, high = np.zeros(1, np.int64), np.array([index.size])
            for word in pattern[::-1]:
                low, high = index.step(np.searchsorted(index.words, [word]) + 1, low, high)
            hits = [t for t in range(5) for at in range(bounds[t], bounds[t + 1] - size + 1) if (texts[at : at + size] == pattern).all()]
            assert high[0] - low[0] == len(hits)
            if hits:
                assert index.least_owner(low, high)[0] == min(owners[t] for t in hits)


def test_windows_across_touching_spans_are_not_taken():
    # Windows of 3: [0, 3) and [3, 6) are covered, [1, 4) and [2, 5) are not; they come again at 8.
    units = np.array([1, 2, 3, 4, 5, 6, 9, 9, 2, 3, 4, 9, 4, 5, 6], np.uint64)
    spans = [{"start": 0, "end": 3}, {"start": 3, "end": 6}]
    assert repeats.same_windows(units, spans, 3) == [(0, 6), (12, 15)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.digests(suffix_dedup.dedup(empty)).collect() == []
    assert substring_dedup.digests(substring_dedup.dedup(empty)).collect() == []
    one = frame(spark, [(1, None), (2, "short")])
    assert sorted(map(tuple, suffix_dedup.dedup(one).select("doc_id", "n_bytes", F.size("removed")).collect())) == [(1, 0, 0), (2, 5, 0)]
