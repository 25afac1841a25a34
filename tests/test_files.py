import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.model import PAGES
from lorespark.operators import blobs, chunks, lifecycle
from lorespark.sources import files as text_files
from lorespark.sources import frontmatter, tables


def files(spark, rows):
    return spark.createDataFrame([(name, name, mime, None if content is None else bytearray(content)) for name, mime, content in rows], "file_id string, filename string, mime string, content binary")


def test_text_and_markdown_files(spark):
    frame = files(spark, [
        ("tides.md", "text/markdown", b"# Tides\n\nHigh at noon.\n\n## Moon\n\nFull in May."), ("log.txt", "text/plain", "wind from west, 5 Bft \U0001f32c".encode("utf-16")), ("be.txt", "", b"\xfe\xff" + "fog é".encode("utf-16-be")),
        ("bom.txt", "", b"\xef\xbb\xbfcalm"), ("half.txt", "text/plain", b"\xff\xfeab\x00"), ("lone.txt", "", b"\xff\xfe\x00\xd8a\x00"), ("low.txt", "", b"\xfe\xff\xdc\x00"), ("latin.txt", "", b"\xe9t\xe9"), ("map.pdf", "application/pdf", b"%PDF"), ("blank.txt", "", b"  \n"), ("none.md", "", None),
    ])
    rows = {row["file_id"]: row for row in text_files.extract_files(frame).collect()}
    assert rows["tides.md"]["title"] == "Tides" and [item["text"] for item in rows["tides.md"]["sections"]] == ["High at noon.", "Full in May."]
    assert [item["text"] for item in rows["log.txt"]["sections"]] == ["wind from west, 5 Bft \U0001f32c"] and rows["be.txt"]["sections"][0]["text"] == "fog é" and rows["bom.txt"]["sections"][0]["text"] == "calm"
    assert all("UTF-16" in rows[name]["error"] for name in ("half.txt", "lone.txt", "low.txt", "latin.txt", "none.md"))
    assert "only Markdown" in rows["map.pdf"]["error"] and rows["blank.txt"]["warnings"] == ["no extractable text was found"]
    assert chunks.explode_sections(text_files.extract_files(frame.filter("file_id = 'tides.md'")), F.col("sections"), ["file_id"]).count() == 2


def pages(spark):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(1, "Root: \"one\"", "root", "body\n---\nmore", ["a", "b: c"], "published", None, {"owner": '"te\\"am"', "n": "2", "on": "true", "none": "null"}, t, t, None, None), (2, "Child", "child", "", [], "draft", 1, {}, t, t, None, None), (3, "Gone", "deleted-page-3", "x", [], "archived", None, {}, t, t, t, "gone")]
    return spark.createDataFrame(rows, PAGES)


def test_front_matter_round_trip(spark):
    stored = pages(spark)
    exported = frontmatter.export_pages(stored)
    content = {row["id"]: row for row in exported.collect()}
    assert content[2]["content"].startswith('---\nalias: "child"\narchive_version: 1\ncreated_at: 2024-01-02T03:04:05.000Z\nparent: "root"\nparent_id: 1\n')
    assert content[3]["path"] == "trash/3-gone.md" and "deleted_at:" in content[3]["content"]
    inputs = frontmatter.import_pages(exported.select(F.col("id").alias("no"), "content"), stored)
    rows = {row["no"]: row for row in inputs.collect()}
    assert rows[1]["title"] == 'Root: "one"' and rows[1]["body"] == "body\n---\nmore" and rows[1]["tags"] == ["a", "b: c"]
    assert rows[1]["properties"] == {"owner": '"te\\"am"', "n": "2", "on": "true", "none": "null"} and rows[2]["parent_id"] == 1 and rows[1]["error"] is None
    created, refused = lifecycle.create_pages(stored, inputs.drop("error"), "2024-06-01 00:00:00", imported=True)
    assert sorted(row["alias"] for row in created.collect()) == ["child-2", "deleted-page-3-2", "root-2"] and refused.count() == 0


@pytest.mark.parametrize("text, problem", [("no header", "front matter"), ("---\n- a\n---\n", "mapping"), ("---\ntitle: ''\n---\n", "title"), ("---\ntitle: a\ntags: x\n---\n", "tags"), ("---\ntitle: a\nstatus: odd\n---\n", "status"), ("---\ntitle: [\n---\n", "invalid"), ("---\ntitle: a\nproperties: {a: [1]}\n---\n", "scalars")])
def test_bad_headers(spark, text, problem):
    row = frontmatter.import_pages(spark.createDataFrame([(1, text)], "no long, content string"), pages(spark)).first()
    assert problem in row["error"]


def test_published_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = tables.publish({"pages": pages(spark)}, folder)
    second = tables.publish({"pages": pages(spark).filter("id = 1")}, folder)
    assert tables.open_version(spark, folder, "pages").count() == 1 and tables.open_version(spark, folder, "pages", first).count() == 3
    assert tables.current_version(spark, folder) == second
    merged = tables.upsert(pages(spark).select("id", "title"), spark.createDataFrame([(2, "New"), (9, "More")], "id long, title string"), ["id"])
    assert sorted(map(tuple, merged.collect())) == [(1, 'Root: "one"'), (2, "New"), (3, "Gone"), (9, "More")]


def test_capture_export(spark):
    articles = spark.createDataFrame([(1, "![a](/web-assets/" + "f" * 64 + "/my%20pic.png)"), (2, "none")], "web_capture_id long, content string")
    assets = spark.createDataFrame([(1, "f" * 64, "my pic.png"), (1, "f" * 64, "my pic.png")], "web_capture_id long, blob_sha256 string, filename string")
    rows = {row["web_capture_id"]: row["content"] for row in frontmatter.capture_article(articles, assets).collect()}
    assert rows == {1: "![a](resources/ffffffffffff-my pic.png)", 2: "none"}


def test_a_file_is_opened_once(spark):
    """The content is matched a few times, however many fields a header has."""
    files = spark.createDataFrame([(1, "---\ntitle: x\n---\nbody"), (2, "no header"), (3, None)], "no long, content string")
    pages = spark.createDataFrame([], "id long, alias string, deleted_at timestamp_ntz")
    back = frontmatter.import_pages(files, pages)
    assert back._jdf.queryExecution().optimizedPlan().toString().count(frontmatter.HEADER) <= 4
    rows = {row["no"]: row for row in back.collect()}
    assert (rows[1]["title"], rows[1]["body"], rows[1]["error"]) == ("x", "body", None)
    assert rows[2]["error"] == rows[3]["error"] == "Markdown import requires YAML front matter"
