"""File formats, media types, names and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind
from .text import strip

# Canonical media type of each document format.
FORMAT_MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "pdf": "application/pdf",
    "markdown": "text/markdown",
    "text": "text/plain",
}


def document_format(filename: Column, mime: Column) -> Column:
    """Format by extension first, then by media type; null when unsupported."""

    def decide(extension: Column) -> Column:
        return (
            F.when(extension == ".docx", F.lit("docx"))
            .when(extension == ".xlsx", F.lit("xlsx"))
            .when(extension == ".pptx", F.lit("pptx"))
            .when((extension == ".pdf") | (mime == FORMAT_MIME["pdf"]), F.lit("pdf"))
            .when(extension.isin(".md", ".markdown") | (mime == FORMAT_MIME["markdown"]), F.lit("markdown"))
            .when((extension == ".txt") | mime.startswith("text/plain"), F.lit("text"))
        )

    return bind(F.regexp_extract(F.lower(filename), r"[^./](\.[^./]*)$", 1), decide)


def canonical_mime(document_format_name: Column) -> Column:
    pairs = [F.lit(value) for pair in FORMAT_MIME.items() for value in pair]
    return F.try_element_at(F.create_map(*pairs), document_format_name)


def normalize_mime(mime: Column) -> Column:
    bare = F.lower(strip(F.substring_index(mime, ";", 1)))
    part = r"[a-z0-9!#$&^_.+-]+"
    return F.when(bare.rlike(f"^{part}/{part}$"), bare).otherwise(F.lit("application/octet-stream"))


def valid_filename(filename: Column) -> Column:
    """Trimmed name, or null when it is refused."""
    name = strip(filename)
    bad = (name == "") | (F.length(name) > 255) | name.rlike(r"[\\/\x00-\x1f\x7f]") | name.isin(".", "..")
    return F.when(~bad, name)


def safe_archive_path(path: Column) -> Column:
    """True for a relative path without parent steps."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~F.array_contains(F.split(path, "/"), "..")


def image_mime(content: Column) -> Column:
    """Media type of a raster image by its first bytes; null for anything else."""
    # File signatures in hexadecimal.
    return bind(F.hex(F.substring(content, 1, 12)), lambda head: (
        F.when(head.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(head.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("image/gif"))
        .when(head.rlike("^52494646.{8}57454250$"), F.lit("image/webp"))
        .when(head.startswith("424D"), F.lit("image/bmp"))
        .when(head.rlike("^.{8}66747970617669"), F.lit("image/avif"))
    ))


def has_pdf_signature(content: Column) -> Column:
    return F.instr(F.hex(F.substring(content, 1, 1029)), "255044462D") % 2 == 1
