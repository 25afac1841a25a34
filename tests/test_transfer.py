import datetime
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorespark.model import PAGES, RequestError
from lorespark.sources import frontmatter, tables, transfer

T = datetime.datetime(2024, 1, 2, 3, 4, 5)
RULES = {
    "keys": {"pages": ["id"], "attachments": ["id"]},
    "references": [("attachments", "page_id", "pages", "id"), ("pages", "parent_id", "pages", "id")],
    "blob_columns": [("attachments", "blob_sha256")],
}


def pages(spark, count=40):
    rows = [(n, f"Page {n}", f"page-{n}", f"body {n} " * n, ["a"], "published", n // 2 or None, {"n": str(n)}, T, T, T if n == 7 else None, None) for n in range(1, count)]
    return spark.createDataFrame(rows, PAGES)


def blobs(spark, contents):
    return spark.createDataFrame([(bytearray(content),) for content in contents], "content binary").select(F.sha2("content", 256).alias("sha256"), "content")


def attachments(spark, stored, owner=1):
    return stored.distinct().select(F.row_number().over(Window.orderBy("sha256")).alias("id"), F.lit(owner).cast("long").alias("page_id"), F.col("sha256").alias("blob_sha256"))


@pytest.fixture
def archive(spark, tmp_path):
    stored = blobs(spark, [b"one", b"two", b"one", b""])
    live = pages(spark)
    transfer.write_archive(str(tmp_path / "archive"), {"pages": live, "attachments": attachments(spark, stored)}, lambda kept: frontmatter.export_pages(kept["pages"]), lambda kept: stored, part_bytes=2000)
    return str(tmp_path / "archive")


def test_restored_tables_equal_the_exported_ones(spark, archive, tmp_path):
    store = str(tmp_path / "store")
    version = transfer.restore_archive(spark, archive, store, **RULES)
    assert tables.current_version(spark, store) == version
    back = tables.open_version(spark, store, "pages")
    assert sorted(map(str, back.collect())) == sorted(map(str, pages(spark).collect()))
    found = {row["path"]: bytes(row["content"]) for row in transfer.archive_files(spark, archive).collect()}
    assert sorted(content for path, content in found.items() if path.startswith("blobs/")) == [b"", b"one", b"two"]
    summary = {row["item"]: row["n"] for row in transfer.archive_summary(transfer.archive_manifest(spark, archive)).collect()}
    assert summary == {"pages": 38, "trash": 1, "blobs": 3, "table pages": 39, "table attachments": 3}


def test_parts_are_bounded_by_their_last_file(spark, archive):
    parts = spark.read.parquet(f"{archive}/parts").select("part", F.octet_length("content").alias("size"))
    rows = parts.groupBy("part").agg(F.sum("size").alias("all"), F.max("size").alias("largest")).collect()
    assert len(rows) > 2 and all(row["all"] < 2000 + row["largest"] for row in rows)
    assert parts.count() == 42


def damage(spark, archive, kind):
    folder = f"{archive}/parts"
    if kind == "truncated":
        where, name = next((where, name) for where, _, names in os.walk(folder) for name in names if name.endswith(".parquet"))
        os.truncate(os.path.join(where, name), 40)
        return
    files = spark.read.parquet(folder).withColumn("part", F.lit("x"))
    first = files.agg(F.min("path")).first()[0]
    chosen = F.col("path") == first
    changed = {
        "missing": files.filter(~chosen),
        "hash": files.withColumn("content", F.when(chosen, F.encode(F.lit("z" * 3), "UTF-8")).otherwise(F.col("content"))),
        "unexpected": files.unionByName(files.filter(chosen).withColumn("path", F.lit("blobs/no/name"))),
        "twice": files.unionByName(files.filter(chosen)),
        "unsafe": files.unionByName(files.filter(chosen).withColumn("path", F.lit("../../etc/x"))),
    }[kind]
    changed.write.parquet(f"{archive}/other")
    spark.read.parquet(f"{archive}/other").write.mode("overwrite").partitionBy("part").parquet(folder)


@pytest.mark.parametrize(
    "kind, named",
    [("truncated", None), ("missing", "file missing: 1"), ("hash", "blob name: 1"), ("unexpected", "file unexpected: 1"), ("twice", "path found twice: 1"), ("unsafe", "unsafe path: 1")],
)
def test_a_damaged_part_leaves_the_old_version_current(spark, archive, tmp_path, kind, named):
    store = str(tmp_path / "store")
    old = tables.publish({"pages": pages(spark, 3)}, store)
    before = os.listdir(f"{store}/data")
    damage(spark, archive, kind)
    with pytest.raises(Exception) as problem:
        transfer.restore_archive(spark, archive, store, **RULES)
    if named:
        assert isinstance(problem.value, RequestError) and named in str(problem.value)
    assert tables.current_version(spark, store) == old and tables.open_version(spark, store, "pages").count() == 2
    assert os.listdir(f"{store}/data") == before


def test_tables_are_checked_as_staged(spark, archive, tmp_path):
    rows = pages(spark)
    rows.filter("id <> 1").unionByName(rows.filter("id = 2")).write.mode("overwrite").parquet(f"{archive}/tables/pages")
    with pytest.raises(RequestError) as problem:
        transfer.restore_archive(spark, archive, str(tmp_path / "store"), **RULES)
    for named in ("table pages: 1", "key pages: 1", "attachments.page_id: 3", "pages.parent_id: 3"):
        assert named in str(problem.value)


def test_blobs_that_are_referred_to_must_be_there(spark, tmp_path):
    stored = blobs(spark, [b"one", b"two"])
    archive = str(tmp_path / "archive")
    transfer.write_archive(archive, {"pages": pages(spark), "attachments": attachments(spark, stored)}, lambda kept: frontmatter.export_pages(kept["pages"]), lambda kept: stored.filter("content = cast('one' as binary)"))
    with pytest.raises(RequestError, match="blob of attachments.blob_sha256: 1"):
        transfer.restore_archive(spark, archive, str(tmp_path / "store"), **RULES)


def test_guards_and_unfinished_archives(spark, archive, tmp_path):
    with pytest.raises(RequestError, match="too many bytes: 1, too many entries: 1"):
        transfer.restore_archive(spark, archive, str(tmp_path / "store"), max_entries=3, max_bytes=10)
    with pytest.raises(RequestError, match="not finished"):
        transfer.restore_archive(spark, str(tmp_path / "none"), str(tmp_path / "store"))


def test_empty_archive(spark, tmp_path):
    archive, store = str(tmp_path / "archive"), str(tmp_path / "store")
    nothing = spark.createDataFrame([], "path string, content string")
    transfer.write_archive(archive, {"pages": pages(spark).limit(0)}, lambda kept: nothing)
    transfer.restore_archive(spark, archive, store, keys={"pages": ["id"]}, max_bytes=1)
    assert tables.open_version(spark, store, "pages").count() == 0
