"""Documents that own a page: create, replace, complete, review, requeue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mime import document_format, normalize_mime, valid_filename
from ..functions.text import sha256_hex, strip
from ..model import MAX_TITLE_CHARS
from .filters import active, current_versions
from .history import human_edited
from .queues import request, superseded


def page_inputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page inputs and refused files for new documents (no, filename, mime, content).

    The page names the file, and carries its type as tags and properties until
    people edit it.
    """
    named = files.withColumn("_name", valid_filename(F.col("filename"))).withColumn("format", document_format(F.col("filename"), F.col("mime")))
    error = F.when(F.col("_name").isNull(), F.lit("attachment filename is invalid")).when(F.col("format").isNull(), F.lit("supported document formats are DOCX, XLSX, PPTX, PDF, Markdown, and TXT"))
    checked = named.withColumn("error", error)
    stem = strip(F.regexp_replace("_name", r"\.[^.]+$", ""))
    title = F.substring(F.coalesce(F.nullif(stem, F.lit("")), F.col("_name")), 1, MAX_TITLE_CHARS)
    shown = F.regexp_replace("_name", r"([\\\[\]*_`])", r"\\$1")
    body = F.concat(F.lit("> Imported document: **"), shown, F.lit("**\n\nExtracted content is managed by the archive and appears below when ready."))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("_name").alias("v"))), r'^\{"v":|\}$', "")
    good = checked.filter(F.col("error").isNull())
    inputs = good.select(
        "no", title.alias("title"), body.alias("body"), F.array(F.lit("type:document"), F.concat(F.lit("type:"), F.col("format"))).alias("tags"),
        F.create_map(F.lit("document.filename"), quoted, F.lit("document.format"), F.concat(F.lit('"'), F.col("format"), F.lit('"'))).alias("properties"),
    )
    return inputs, checked.filter(F.col("error").isNotNull()).select("no", "error")


def new_documents(files: DataFrame, pages: DataFrame, now: str, first_id: int = 1) -> dict[str, DataFrame]:
    """Rows of new documents: files carry the `page_id` of their page.

    A document takes the number of its page plus `first_id`, which stays unique
    without numbering all rows. Returns documents, versions, blobs, and jobs.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    managed = pages.select(F.col("id").alias("page_id"), *[F.col(name).alias(f"managed_{name}") for name in ("title", "body", "tags", "properties")])
    hashed = files.withColumn("sha256", sha256_hex(F.col("content"))).withColumn("mime_type", normalize_mime(F.col("mime"))).withColumn("format", document_format(F.col("filename"), F.col("mime")))
    joined = hashed.join(managed, "page_id").withColumn("id", F.col("page_id") + first_id)
    documents = joined.select(
        "id", "page_id", valid_filename(F.col("filename")).alias("filename"), "mime_type", "format", F.lit("queued").alias("status"), F.lit(False).alias("needs_ocr"),
        F.lit("not_required").alias("ocr_status"), F.lit(False).alias("needs_review"), "managed_title", "managed_body", "managed_tags", "managed_properties", moment.alias("created_at"), moment.alias("updated_at"),
    )
    versions = joined.select(F.col("id").alias("document_id"), F.lit(1).alias("version"), "sha256", F.lit("queued").alias("status"), moment.alias("created_at"))
    blobs = joined.select("sha256", F.octet_length("content").cast("bigint").alias("size"), "mime_type").dropDuplicates(["sha256"])
    return {"documents": documents, "versions": versions, "blobs": blobs, "jobs": request(joined, now)}


def replace_documents(documents: DataFrame, versions: DataFrame, pages: DataFrame, files: DataFrame, now: str) -> dict[str, DataFrame]:
    """New content for documents (document_id, filename, mime, content), at most one file each.

    The next version is queued, unfinished ones are superseded, and a page that
    people have edited marks its document for review.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    latest = versions.groupBy("document_id").agg(F.max("version").alias("_latest"))
    hashed = files.withColumn("sha256", sha256_hex(F.col("content"))).join(latest, "document_id")
    added = hashed.select("document_id", (F.col("_latest") + 1).alias("version"), "sha256", F.lit("queued").alias("status"), moment.alias("created_at"))
    review = human_edited(pages, documents).select(F.col("document_id").alias("id"), F.col("needs_review").alias("_review"))
    change = files.select(
        F.col("document_id").alias("id"), valid_filename(F.col("filename")).alias("_filename"), normalize_mime(F.col("mime")).alias("_mime"), document_format(F.col("filename"), F.col("mime")).alias("_format"), F.lit(True).alias("_replaced")
    )
    joined = documents.join(change, "id", "left").join(review, "id", "left")
    replaced = F.coalesce(F.col("_replaced"), F.lit(False))
    new = {
        "filename": F.col("_filename"), "mime_type": F.col("_mime"), "format": F.col("_format"), "status": F.lit("queued"), "needs_ocr": F.lit(False),
        "ocr_status": F.lit("not_required"), "needs_review": F.col("_review"), "updated_at": moment,
    }
    after = joined.select(*[F.when(replaced, new[name]).otherwise(F.col(name)).alias(name) if name in new else F.col(name) for name in documents.columns])
    return {"documents": after, "versions": superseded(versions, files).unionByName(added), "jobs": request(files, now, "document_id")}


def complete_documents(documents: DataFrame, versions: DataFrame, extracted: DataFrame, now: str) -> dict[str, DataFrame]:
    """Apply accepted extractions (document_id, version, ocr_status, needs_ocr): documents and versions become ready.

    Also returns the jobs for vectors and tagging that follow.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    done = extracted.select("document_id", "version", F.col("ocr_status").alias("_ocr"), F.col("needs_ocr").alias("_needs"), F.lit(True).alias("_done"))
    current = versions.join(done, ["document_id", "version"], "left")
    finished = F.coalesce(F.col("_done"), F.lit(False))
    new_versions = current.withColumn("status", F.when(finished, F.lit("ready")).otherwise(F.col("status"))).drop("_ocr", "_needs", "_done")
    joined = documents.join(done.drop("version"), documents["id"] == done["document_id"], "left")
    new = {"status": F.lit("ready"), "needs_ocr": F.col("_needs"), "ocr_status": F.col("_ocr"), "updated_at": moment}
    after = joined.select(*[F.when(finished, new[name]).otherwise(F.col(name)).alias(name) if name in new else F.col(name) for name in documents.columns])
    return {"documents": after, "versions": new_versions.select(versions.columns), "vector_jobs": request(extracted, now, "document_id"), "tagging_jobs": request(extracted, now, "document_id")}


def acknowledge_reviews(documents: DataFrame, pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Accept the present page as the managed state of the chosen documents."""
    state = pages.select(F.col("id").alias("page_id"), *[F.col(name).alias(f"_{name}") for name in ("title", "body", "tags", "properties")])
    joined = documents.join(state, "page_id").join(chosen.select("id", F.lit(True).alias("_chosen")).distinct(), "id", "left")
    picked = F.coalesce(F.col("_chosen"), F.lit(False))
    new = {"needs_review": F.lit(False), **{f"managed_{name}": F.col(f"_{name}") for name in ("title", "body", "tags", "properties")}}
    return joined.select(*[F.when(picked, new[name]).otherwise(F.col(name)).alias(name) if name in new else F.col(name) for name in documents.columns])


def tagging_targets(documents: DataFrame, versions: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, version): the latest version of every ready document on a live page, to be tagged again."""
    live = active(pages).select(F.col("id").alias("page_id"))
    ready = documents.filter(F.col("status") == "ready").join(live, "page_id", "left_semi").select(F.col("id").alias("document_id"))
    return current_versions(versions.join(ready, "document_id", "left_semi")).select("document_id", "version")


def document_of_page(documents: DataFrame, pages: DataFrame, page_id: int) -> DataFrame:
    """The document that owns a live page, if any."""
    live = active(pages).filter(F.col("id") == page_id).select(F.col("id").alias("page_id"))
    return documents.filter(F.col("page_id") == page_id).join(live, "page_id", "left_semi")


def hydrate_documents(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents with their latest version, most recently changed first."""
    latest = current_versions(versions).select(F.col("document_id").alias("id"), F.col("version"), F.col("sha256"), F.col("status").alias("version_status"))
    return documents.join(latest, "id", "left").orderBy(F.desc("updated_at"), F.desc("id"))
