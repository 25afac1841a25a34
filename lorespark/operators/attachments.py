"""Files attached to pages, their stored blobs, and the whole of a page for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mime import normalize_mime, valid_filename
from .blobs import addressed, blob_path, orphan_blobs
from .filters import active, json_text
from .graph import backlinks
from .tree import breadcrumbs


def attach(files: DataFrame, attachments: DataFrame, pages: DataFrame, now: str) -> dict[str, DataFrame]:
    """New attachments and blobs for files (no, page_id, filename, mime, content), and the refused files.

    A name may stand once on a page: the first of equal ones in the batch wins,
    and only against names that the page does not have yet.
    """
    named = addressed(files).withColumn("_name", valid_filename(F.col("filename")))
    live = active(pages).select(F.col("id").alias("page_id"), F.lit(True).alias("_live"))
    taken = attachments.select("page_id", F.col("filename").alias("_name"), F.lit(True).alias("_taken"))
    first = named.filter(F.col("_name").isNotNull()).groupBy("page_id", "_name").agg(F.min("no").alias("_first"))
    checked = named.join(live, "page_id", "left").join(taken, ["page_id", "_name"], "left").join(first, ["page_id", "_name"], "left")
    error = (
        F.when(F.col("_live").isNull(), "page not found")
        .when(F.col("_name").isNull(), "attachment filename is invalid")
        .when(F.col("_taken") | (F.col("no") != F.col("_first")), "attachment already exists on this page")
    )
    checked = checked.withColumn("error", error)
    good = checked.filter(F.col("error").isNull())
    moment = F.lit(now).cast("timestamp_ntz")
    added = good.select("no", "page_id", F.col("_name").alias("filename"), F.col("sha256").alias("blob_sha256"), moment.alias("created_at"))
    stored = good.groupBy("sha256").agg(F.max("size").alias("size"), F.min(normalize_mime(F.col("mime"))).alias("mime_type"))
    return {"attachments": added, "blobs": stored, "refused": checked.filter(F.col("error").isNotNull()).select("no", "error")}


def listed(attachments: DataFrame, stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Attachments of live pages with size, type and place of their blob; pages in the trash show none."""
    live = active(pages).select(F.col("id").alias("page_id"))
    files = stored.select(F.col("sha256").alias("blob_sha256"), "size", "mime_type")
    shown = attachments.join(live, "page_id", "left_semi").join(files, "blob_sha256")
    return shown.withColumn("path", blob_path(F.col("blob_sha256")))


def remove(attachments: DataFrame, chosen: DataFrame, pages: DataFrame, stored: DataFrame, *other_referrers: DataFrame) -> dict[str, DataFrame]:
    """What is left without the chosen attachments (id) of live pages, and the blobs that nothing refers to any more."""
    live = active(pages).select(F.col("id").alias("page_id"))
    gone = attachments.join(chosen.select("id").distinct(), "id", "left_semi").join(live, "page_id", "left_semi")
    left = attachments.join(gone.select("id"), "id", "left_anti")
    touched = stored.join(gone.select(F.col("blob_sha256").alias("sha256")).distinct(), "sha256", "left_semi")
    return {"attachments": left, "removed": gone, "orphans": orphan_blobs(touched, left.select(F.col("blob_sha256").alias("sha256")), *other_referrers)}


def version_files(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Document versions with size, type and place of their file."""
    return versions.join(stored.select("sha256", "size", "mime_type"), "sha256").withColumn("path", blob_path(F.col("sha256")))


def hydrate_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Live pages as they are read: tags, properties as text, number of children, breadcrumbs and backlinks.

    Breadcrumbs are as long as the forest is deep; who links to a page, `graph.backlink_list` lists in order.
    """
    live = active(pages)
    children = live.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    crumbs = breadcrumbs(pages).select("id", F.transform("breadcrumbs", lambda item: F.struct(item["id"].alias("id"), item["label"].alias("title"))).alias("breadcrumbs"))
    sources = backlinks(links, pages).select(F.col("page_id").alias("id"), "source_id").distinct()
    named = sources.groupBy("id").agg(F.count("*").alias("backlink_count"))
    joined = live.join(children, "id", "left").join(crumbs, "id", "left").join(named, "id", "left")
    properties = F.map_from_entries(F.transform(F.map_entries("properties"), lambda item: F.struct(item["key"].alias("key"), json_text(item["value"]).alias("value"))))
    return joined.withColumns({
        "properties_text": properties, "children": F.coalesce("children", F.lit(0)), "backlink_count": F.coalesce("backlink_count", F.lit(0)),
    })
