"""Tables and indexes kept by segments, against the same rows taken whole."""

import random

from lorespark.operators import lexical
from lorespark.sources.segments import GROWTH, SegmentedTable

WORDS = ["alpha", "alphabet", "beta", "naïve", "gamma", "e-mail", "delta"]


def table_of(spark, folder):
    return SegmentedTable(spark, str(folder), "id bigint, v string", "id", ["id"])


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, v string")


def keys(spark, *found):
    return spark.createDataFrame([(one,) for one in found], "id bigint")


def test_table_equals_a_dictionary(spark, tmp_path):
    table, expected, rng = table_of(spark, tmp_path), {}, random.Random(5)
    for step in range(9):
        size = 60 if step == 0 else rng.randint(0, 6)
        changed = {rng.randrange(80): f"{step}" for _ in range(size)}
        gone = [key for key in rng.sample(range(90), 3) if key not in changed]
        assert table.append(pairs(spark, list(changed.items())), keys(spark, *gone), batch=step)
        expected = {key: value for key, value in (expected | changed).items() if key not in gone}
        assert sorted(tuple(row) for row in table.read().collect()) == sorted(expected.items())
        sizes = [one.keys for one in table.segments()]
        assert all(size >= GROWTH * sum(sizes[at + 1 :]) for at, size in enumerate(sizes))


def test_small_batches_leave_the_large_segment_alone(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.append(pairs(spark, [(number, "a") for number in range(100)]))
    base = table.segments()[0]
    for number in range(4):
        table.append(pairs(spark, [(number, "b")]), keys(spark, number + 50))
    assert table.segments()[0] == base and 1 < len(table.segments()) <= 4
    assert table.read().filter("v = 'b'").count() == 4 and table.read().count() == 96


def test_repeated_batches_empty_batches_and_null_keys(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert table.read().count() == 0 and table.segments() == [] and not table.compact()
    assert table.append(pairs(spark, [(1, "a"), (None, "x")]), batch=4)
    assert not table.append(pairs(spark, [(1, "b")]), batch=4) and not table.append(pairs(spark, [(1, "c")]), batch=3)
    assert table.append(pairs(spark, []), batch=5) and table.applied() == 5 and len(table.segments()) == 1
    assert [tuple(row) for row in table.read().collect()] == [(1, "a")]
    assert table.append(None, keys(spark, 1, 1, None, 9)) and table.read().count() == 0


def test_writers_at_once_lose_nothing(spark, tmp_path):
    one, other = table_of(spark, tmp_path), table_of(spark, tmp_path)
    publish, met = one._publish, []

    def late(*arguments):
        if not met:
            met.append(True)
            other.append(pairs(spark, [(2, "other")]))
        return publish(*arguments)

    one._publish = late
    one.append(pairs(spark, [(1, "one")]))
    assert sorted(tuple(row) for row in one.read().collect()) == [(1, "one"), (2, "other")]


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    table = table_of(spark, tmp_path)
    for number in range(4):
        table.append(pairs(spark, [(number % 3, f"{number}")]))
    table.vacuum()
    assert sorted(tuple(row) for row in table.read().collect()) == [(0, "3"), (1, "1"), (2, "2")]
    assert len(list((tmp_path / "data").iterdir())) == len(table.segments()) and len(list((tmp_path / "manifests").glob("0*"))) == 1


def test_index_follows_its_rows(spark, tmp_path):
    rng, now = random.Random(11), {}
    index = lexical.SegmentedIndex(spark, str(tmp_path), ["a", "b"], positions=True)
    for step in range(5):
        changed = {rng.randrange(40): (" ".join(rng.choices(WORDS, k=rng.randint(0, 12))), rng.choice([None, "", "Alpha beta"])) for _ in range(25 if step == 0 else 4)}
        gone = [key for key in rng.sample(range(40), 3) if key not in changed]
        index.update(spark.createDataFrame([(key, *texts) for key, texts in changed.items()], "id long, a string, b string"), keys(spark, *gone), step)
        now = {key: value for key, value in (now | changed).items() if key not in gone}
    fresh = lexical.PostingsIndex.build(spark.createDataFrame([(key, *texts) for key, texts in now.items()], "id long, a string, b string"), ["a", "b"], positions=True)
    for query in ("alpha", "naive gam", "e-mail", "alpha-beta"):
        found, expected = ({row["id"]: round(row["score"], 9) for row in one.scores(query).collect()} for one in (index.open(), fresh))
        assert found == expected and found


def test_each_text_is_tokenised_once(spark):
    rows = spark.createDataFrame([(1, "one two")], "id long, a string")
    plan = lexical.index_rows(rows, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "Exchange" not in plan


def test_rows_of_a_segment_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = pairs(spark, [(number, "a") for number in range(50)])
    table_of(spark, tmp_path).append(rows.mapInArrow(count, rows.schema))
    assert seen.value == 50
