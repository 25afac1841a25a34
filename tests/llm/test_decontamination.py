import random
import re

from lorespark.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, items string, spans int", "item_id long, text string, n_words int"


def words_of(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items):
    out = []
    for key, text in docs:
        words, hit, names = words_of(text), set(), set()
        for item, other in items:
            theirs = words_of(other)
            size = min(10, len(theirs))
            windows = {tuple(theirs[at : at + size]) for at in range(len(theirs) - size + 1)} if size else set()
            places = [at for at in range(len(words) - size + 1) if size and tuple(words[at : at + size]) in windows]
            hit |= {at + step for at in places for step in range(size)}
            if places and item is not None:
                names.add(str(item))
        out.append((key, len(words), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_words, [w for s in r.spans for w in range(s["first"], s["after"])], list(r["items"])) for r in frame.collect()), key=repr)


def test_against_brute_force(spark):
    chance = random.Random(3)
    items = [(n, " ".join(chance.choice("abcdefg") + chance.choice("xyZ9é") for _ in range(chance.choice([1, 3, 9, 10, 11, 30])))) for n in range(25)]
    items += [(25, None), (26, ""), (27, " .,"), (3, "entirely other words of item three " * 2), (None, items[7][1]), (28, "same " * 14)]
    docs = []
    for n in range(80):
        parts = []
        for _ in range(chance.randint(0, 6)):
            words = (items[chance.randrange(25)][1]).split()
            start = chance.randint(0, len(words))
            parts += words[start : start + chance.randint(1, 30)] + [chance.choice("pq") for _ in range(chance.randint(0, 3))]
        docs.append((n, chance.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(90, None), (91, ""), (92, "same " * 9), (93, "SAME! " * 40), (None, items[1][1]), (None, items[1][1]), (94, "x " * 5000 + items[3][1] + " y" * 200_000 + " " + items[4][1])]
    docs_frame = spark.createDataFrame([(*doc, "clash", 1) for doc in docs], DOCS)
    items_frame = spark.createDataFrame([(*item, 0) for item in items], ITEMS)
    wanted = brute(docs, items)
    assert result(decontamination.mark(docs_frame, items_frame)) == wanted
    # The same in several blocks of the benchmark.
    assert result(decontamination.mark(docs_frame, items_frame, block_words=400)) == wanted
    clean = decontamination.keep_clean(docs_frame, items_frame)
    assert clean.columns == docs_frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((key for key, _, hit, _ in wanted if not hit), key=repr)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontamination.mark(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    assert result(decontamination.mark(one, items)) == [(1, 2, [], [])]
