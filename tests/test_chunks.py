import random

from pyspark.sql import functions as F

from lorespark.functions.text import WHITESPACE
from lorespark.operators import chunks


def reference_cut(source, size, earliest, overlap):
    """Plain loop over one text, as a yardstick."""
    pieces, start = [], 0
    while start < len(source):
        end = min(len(source), start + size)
        if end < len(source):
            boundary = source.rfind("\n\n", 0, end + 2)
            if boundary > start + earliest:
                end = boundary
        pieces.append(source[start:end])
        if end >= len(source):
            break
        start = max(start + 1, end - overlap)
    return pieces


def random_text(seed, length):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "é ", "\n\n", "\n", "x" * rng.randint(1, 30)]) for _ in range(length)).strip(WHITESPACE)


def test_cut_equals_a_plain_loop(spark):
    texts = [random_text(seed, length) for seed, length in enumerate([0, 1, 5, 50, 200, 800, 3000])] + ["a" * 300, "a" * 301, "\n\n".join("p" * 120 for _ in range(20))]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for size, earliest, overlap in [(300, 180, 30), (100, 60, 20), (50, 25, 0), (10, 6, 9)]:
        rows = frame.select("n", chunks.cut(F.col("t"), size, earliest, overlap).alias("p")).orderBy("n").collect()
        for row in rows:
            assert row["p"] == reference_cut(texts[row["n"]], size, earliest, overlap), (row["n"], size)


def test_long_page_in_bounded_chunks(spark):
    body = "first " * 80 + "\n\n" + "second " * 80
    frame = spark.createDataFrame([(1, "Long", "long", body, [], {})], "id long, title string, alias string, body string, tags array<string>, properties map<string,string>")
    rows = [row["content"] for row in chunks.page_chunks(frame, 300, 30).orderBy("ordinal").collect()]
    assert len(rows) > 2 and all(len(row) <= 300 for row in rows)
    assert rows[0].startswith("Long\nlong\n\nfirst")


def test_markdown_sections(spark):
    text = "# Guide\n\nIntro.\n\n## Install\n\nRun it."
    row = spark.range(1).select(chunks.finish_sections(chunks.markdown_sections(F.lit(text))).alias("s"), chunks.markdown_first_heading(F.lit(text)).alias("t")).first()
    assert row["t"] == "Guide"
    assert [(item["locator"]["label"], item["text"], item["kind"]) for item in row["s"]] == [("Heading: Guide", "Intro.", "heading"), ("Heading: Install", "Run it.", "heading")]
    row = spark.range(1).select(chunks.finish_sections(chunks.markdown_sections(F.lit("before\n# A\nx"))).alias("s")).first()
    assert [item["locator"]["label"] for item in row["s"]] == ["Preamble", "Heading: A"]
    row = spark.range(1).select(chunks.finish_sections(chunks.markdown_sections(F.lit("plain notes"))).alias("s")).first()
    assert [(item["kind"], item["locator"]["label"], item["text"]) for item in row["s"]] == [("text", "Part 1", "plain notes")]


def test_plain_parts_prefer_blank_lines(spark):
    text = "a" * 15_000 + "\n\n" + "b" * 15_000
    parts = spark.range(1).select(chunks.finish_sections(chunks.plain_parts(F.lit(text))).alias("s")).first()["s"]
    assert [len(part["text"]) for part in parts] == [15_000, 15_000]
    parts = spark.range(1).select(chunks.finish_sections(chunks.plain_parts(F.lit("  \r\n "))).alias("s")).first()["s"]
    assert parts == []


def test_stale_pages(spark):
    frame = spark.createDataFrame([(1, "A", "a", "x", ["t"], {"k": "1"}), (2, "B", "b", "y", [], {})], "id long, title string, alias string, body string, tags array<string>, properties map<string,string>")
    state = frame.filter("id = 1").select(F.col("id").alias("page_id"), chunks.page_content_hash().alias("content_hash"))
    assert [row["id"] for row in chunks.stale_pages(frame, state).collect()] == [2]
