import datetime
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorespark.model import PAGES, RequestError, SectionFilters
from lorespark.operators import answering, filters, hybrid, lexical, vectors

T0 = datetime.datetime(2024, 1, 1)


def page(number, title, body="", tags=(), status="published", properties=None, alias=None, parent=None, deleted=False):
    return (number, title, alias or title.lower().replace(" ", "-"), body, sorted(tags), status, parent, properties or {}, T0, T0 + datetime.timedelta(minutes=number), T0 if deleted else None, None)


def make(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def ids(frame):
    return [row["id"] for row in frame.collect()]


@pytest.fixture(scope="module")
def shelf(spark):
    """Four pages about boats; one a draft, one in the trash."""
    return make(
        spark,
        [
            page(11, "Sail Mending", "Stitch the canvas twice.", ["craft", "boats"], alias="needle-work"),
            page(12, "Knots", "A bowline holds the canvas.", ["boats"]),
            page(13, "Varnish", "three coats on canvas", status="draft", properties={"grade": '"marine"', "coats": "3"}),
            page(14, "Anchor", "canvas", deleted=True),
        ],
    )


@pytest.mark.parametrize(
    ("query", "more", "expected"),
    [
        ("mending", {}, [11]), ("need", {}, [11]), ("canvas", {}, [12, 11]), ("canvas", {"tags": ["craft"]}, [11]), ("", {"tags": ["craft"]}, [11]), ("bowline", {"tags": ["craft"]}, []), ("craft", {}, [11]),
        ("coats", {}, []), ("coats", {"status": "draft"}, [13]), ("marine", {"status": "all"}, [13]), ("canvas", {"status": "draft", "properties": {"grade": "marine"}}, [13]), ("canvas", {"status": "draft", "properties": {"coats": "3"}}, []),
        ("canvas", {"status": "draft", "properties": {"coats": 3}}, [13]), ("?! canvas", {}, []),
    ],
)
def test_every_text_and_filter_of_a_page_counts(shelf, query, more, expected):
    assert ids(lexical.search_pages(shelf, query, **more)) == expected


WORDS = ["alpha", "alphabet", "beta", "naïve", "naive", "gamma", "e-mail", "x²", "GAMMA", "delta_one"]


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "naive", "e-mail", "gam", "alpha-beta", "x", "delta-on", "nai gam"])
def test_scores_equal_the_full_text_engine(spark, query):
    rng = random.Random(3)
    rows = [(number, " ".join(rng.choices(WORDS, k=rng.randint(1, 25))), " ".join(rng.choices(WORDS, k=rng.randint(0, 3)))) for number in range(1, 60)]
    database = sqlite3.connect(":memory:")
    database.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='unicode61 remove_diacritics 2')")
    database.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", rows)
    match = " AND ".join(f'"{word}"*' for word in query.split())
    expected = dict(database.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    scanned = {row["id"]: row["score"] for row in lexical.scan_scores(frame, ["a", "b"], query, ["id"]).collect()}
    indexed = {row["id"]: row["score"] for row in lexical.PostingsIndex.build(frame, ["a", "b"], positions=True).scores(query).collect()}
    assert scanned.keys() == expected.keys() == indexed.keys()
    for number, score in expected.items():
        assert scanned[number] == pytest.approx(score, abs=1e-9) and indexed[number] == pytest.approx(score, abs=1e-9)


def test_index_survives_on_disk(spark, tmp_path):
    frame = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, "")], "id long, a string")
    saved = lexical.PostingsIndex.build(frame, ["a"]).save(str(tmp_path))
    assert saved.lengths.count() == 3
    assert sorted(row["id"] for row in saved.scores("two").collect()) == [1, 2]


def test_keywords_of_a_question_vote(spark):
    rows = spark.createDataFrame([(1, "Gulls nest on the northern cliff in spring, and leave it in autumn."), (2, "spring tides"), (3, "nothing of that")], "id long, body string")
    questions = spark.createDataFrame([(7, "When do the gulls nest? In spring, or is it autumn")], "q long, text string")
    found = lexical.keyword_vote(lexical.PostingsIndex.build(rows, ["body"]), questions, "q", "text", 4).orderBy("rank").collect()
    assert [(row["id"], row["votes"]) for row in found] == [(1, 4), (2, 1)]
    words = lexical.question_keywords(questions).orderBy("keyword_no").collect()
    assert [row["keyword"] for row in words] == ["gulls", "nest", "spring", "autumn"]


def test_pages_of_results(spark):
    pages = make(spark, [page(number, f"Common {number}", "shared term") for number in range(1, 4)])
    assert ids(lexical.search_pages(pages, "shared", limit=2)) == [3, 2]
    assert ids(lexical.search_pages(pages, "shared", limit=2, offset=2)) == [1]


def ferry_files(spark):
    """A timetable file with two versions on the page of a line, and a page that has no file."""
    pages = make(spark, [page(1, "Blue line", "overview", ["ferry"], properties={"harbour": '"north"'}), page(2, "Crew", "the purser")])
    documents = spark.createDataFrame([(10, 1, "timetable.txt", "text", "ready", "not_required", T0)], "id long, page_id long, filename string, format string, status string, ocr_status string, updated_at timestamp_ntz")
    versions = spark.createDataFrame([(100, 10, 1), (101, 10, 2)], "id long, document_id long, version int")
    sections = spark.createDataFrame(
        [(1000, 100, 0, "Last winter the purser sold tickets."), (1001, 101, 0, "From May on the purser checks tickets at the gangway."), (1002, 101, 1, "Bicycles travel free.")],
        "section_id long, version_id long, ordinal int, text string",
    ).select("*", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("title"), F.struct(F.lit("Part 1").alias("label")).alias("locator"), F.lit(False).alias("hidden"))
    return pages, filters.searchable_sections(sections, versions, documents, pages)


def test_section_search_and_facets(spark):
    pages, searchable = ferry_files(spark)
    found = lexical.search_sections(searchable, "purser tickets").collect()
    assert [(row["section_id"], row["version"], row["filename"]) for row in found] == [(1001, 2, "timetable.txt")]
    assert "gangway" in found[0]["excerpt"]
    count = lambda **more: lexical.search_sections(searchable, "purser", SectionFilters(**more), ["ferry"], "published", {"harbour": "north"}).count()
    assert count() == 1 and count(format="text", hidden=False) == 1
    assert count(format="pdf") == 0 and count(updated_after="2999-01-01 00:00:00") == 0 and count(document_ids=(11,)) == 0


def test_fusion_drops_the_page_of_a_found_section(spark):
    pages, searchable = ferry_files(spark)
    hits, mode, warning = hybrid.search(pages, searchable, "purser")
    assert mode == "lexical" and warning is None
    assert [row["hit"] for row in hits.collect()] == ["d:1001", "p:2"]
    hits, _, _ = hybrid.search(pages, searchable, "blue")
    assert [row["hit"] for row in hits.collect()] == ["d:1002", "d:1001"]  # page 1 gives way to its sections
    only = hybrid.search(pages, searchable, "purser", filters=SectionFilters(format="text"))[0]
    assert [row["hit"] for row in only.collect()] == ["d:1001"]
    with pytest.raises(RequestError):
        hybrid.search(pages, searchable, "  ")


def test_evidence_from_pages_and_sections(spark):
    pages, searchable = ferry_files(spark)
    hits, mode, _ = answering.retrieve(pages, searchable, "Does the purser swim, or are bicycles free?")
    assert mode == "keywords" and [row["hit"] for row in hits.orderBy("rank").collect()] == ["d:1002", "d:1001", "p:2"]
    rows = answering.evidence(hits, pages, searchable).orderBy("evidence_id").collect()
    assert [(row["evidence_id"], row["source"], row["title"], row["locator"], row["url"]) for row in rows] == [
        ("E1", "document", "timetable.txt", "Part 1", "/documents/10/content?offset=0#section-1"), ("E2", "document", "timetable.txt", "Part 1", "/documents/10/content?offset=0#section-0"), ("E3", "page", "Crew", "crew", "/wiki/crew"),
    ]
    only, _, _ = answering.retrieve(pages, searchable, "purser or bicycles?", ["ferry"], filters=SectionFilters(hidden=True))
    assert only.collect() == []
    assert answering.retrieve(pages, None, "purser")[0].first()["hit"] == "p:2"
    assert answering.retrieve(pages, None, "of a")[0].collect() == []


def test_hybrid_prefers_the_near_page(spark):
    pages = make(spark, [page(1, "Tide mill", "Water turns the wheel at ebb.", ["mill"]), page(2, "Wind pump", "Sails lift water", ["pump"])])
    searchable = ferry_files(spark)[1].filter("false")
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0], "m"), (2, 2, [0.0, 1.0, 0.0], "m"), (3, 1, [0.9, 0.1, 0.0], "m"), (4, 1, None, "m"), (5, 1, [1.0], "m"), (6, 2, [1.0, 0.0, 0.0], "old")], "chunk_id long, page_id long, embedding array<float>, model string")
    none = spark.createDataFrame([], "chunk_id long, section_id long, embedding array<float>")
    now = chunks.filter("model = 'm'").drop("model")
    hits, mode, _ = hybrid.search(pages, searchable, "grinding grain", vector=[1.0, 0.0, 0.0], page_chunks=now, section_chunks=none)
    rows = hits.collect()
    assert mode == "hybrid" and rows[0]["hit"] == "p:1"
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and rows[1]["score"] == pytest.approx(1 / 63)
    filtered = hybrid.search(pages, searchable, "grain", ["pump"], vector=[1.0, 0.0, 0.0], page_chunks=now, section_chunks=none)[0].collect()
    assert [(row["hit"], round(row["score"], 9)) for row in filtered] == [("p:2", round(1 / 63, 9))]  # ranks keep their gaps
    assert hybrid.search(pages, searchable, "grain", vector=[1.0, 0.0, 0.0])[2].startswith("Semantic index")
    near = vectors.page_neighbours(chunks, pages, [1.0, 0.0, 0.0], model="m")
    assert [row["chunk_id"] for row in near.orderBy("rank").collect()] == [1, 3, 2]


def test_sections_count_once(spark):
    near = spark.createDataFrame([(5, 1, 1), (5, 1, 2), (6, 1, 3)], "section_id long, page_id long, rank int")
    assert sorted((row["section_id"], row["rank"]) for row in hybrid.first_per_section(near).collect()) == [(5, 1), (6, 3)]


def test_result_cursor_belongs_to_its_query(spark):
    hits = spark.createDataFrame([(f"p:{n}",) for n in range(5)], "hit string").orderBy("hit")
    rows, cursor = hybrid.take_hits(hits, None, 2, "lexical", query="a")
    assert [row["hit"] for row in rows] == ["p:0", "p:1"]
    rows, cursor = hybrid.take_hits(hits, cursor, 2, "lexical", query="a")
    assert [row["hit"] for row in rows] == ["p:2", "p:3"]
    with pytest.raises(RequestError):
        hybrid.take_hits(hits, cursor, 2, "lexical", query="b")


def test_query_vector_is_checked():
    with pytest.raises(RequestError):
        vectors.check_query_vector([1.0], 2)
    assert vectors.check_query_vector([1, 2], 2) == [1.0, 2.0]


def test_an_index_is_built_without_a_shuffle(spark, monkeypatch):
    """Texts are tokenised once, in the task that reads them."""
    plans = []
    monkeypatch.setattr(lexical, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    rows = spark.createDataFrame([(1, "É é x", "x x"), (2, None, "́ - "), (None, "x", None)], "id long, a string, b string")
    index = lexical.PostingsIndex.build(rows, ["a", "b"], positions=True)
    assert plans and "Exchange" not in plans[0] and "Repartition" not in plans[0]
    found = sorted((row["id"] or 0, row["text_no"], row["term"], row["hits"], row["positions"]) for row in index.postings.collect())
    assert found == [(0, 0, "x", 1, [0]), (1, 0, "e", 2, [0, 1]), (1, 0, "x", 1, [2]), (1, 1, "x", 2, [0, 1])]
    assert sorted((row["id"] or 0, row["length"]) for row in index.lengths.collect()) == [(0, 1), (1, 5), (2, 0)]
