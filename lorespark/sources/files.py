"""Markdown and text files to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bind import bind
from ..functions.mime import document_format
from ..model import SECTION, Settings
from ..operators.chunks import finish_sections, markdown_first_heading, markdown_sections, plain_parts


def decode_text(content: Column) -> Column:
    """UTF-8, or UTF-16 with a byte order mark; null when the bytes are not valid text."""
    head = F.hex(F.substring(content, 1, 3))
    body = F.when(head == "EFBBBF", F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    # UTF-16 is valid when nothing is left of its surrogates after the pairs are taken out.
    units = F.when(head.startswith("FFFE"), F.regexp_replace(F.hex(content), "(..)(..)", "$2$1 ")).otherwise(F.regexp_replace(F.hex(content), "(....)", "$1 "))
    alone = F.regexp_replace(units, "(?<![0-9A-F])D[89AB].. D[C-F].. ", "").rlike("(?<![0-9A-F])D[89A-F]")
    wide = F.when((F.octet_length(content) % 2 == 0) & ~alone, F.decode(content, "UTF-16"))
    return F.when(head.startswith("FFFE") | head.startswith("FEFF"), wide).otherwise(F.try_validate_utf8(body.cast("string")))


def extract_files(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Files (file_id, filename, mime, content) with format, title, sections, warnings and error.

    Formats that need a parser of their own (Office, PDF) are for the caller: their
    sections are given to `finish_sections`.
    """
    kind = document_format(F.col("filename"), F.col("mime"))
    too_large = F.octet_length("content") > settings.max_file_bytes
    readable = F.col("format").isin("markdown", "text") & ~too_large
    # A generator keeps the decoded text a column of its own, not one copied into every use.
    read = files.withColumn("format", kind).select("*", F.inline(F.array(F.struct(decode_text(F.when(readable, F.col("content"))).alias("text")))).alias("_text"))
    sections = F.when(F.col("format") == "markdown", markdown_sections(F.col("_text"))).when(F.col("format") == "text", plain_parts(F.col("_text")))
    error = (
        F.when(~F.coalesce(F.col("format").isin("markdown", "text"), F.lit(False)), F.lit("only Markdown and text files are read"))
        .when(too_large, F.lit("document exceeds the size guard"))
        .when(F.col("_text").isNull(), F.lit("text documents must use UTF-8, UTF-16LE, or UTF-16BE"))
    )
    title = F.when(F.col("format") == "markdown", markdown_first_heading(F.col("_text")))
    finished = finish_sections(F.coalesce(sections, F.array().cast(T.ArrayType(SECTION))))
    shaped = read.withColumns({"title": bind(title, lambda name: F.when(name != "", name)), "sections": finished, "error": error})
    nothing = F.col("error").isNull() & (F.size("sections") == 0)
    return shaped.withColumn("warnings", F.when(nothing, F.array(F.lit("no extractable text was found"))).otherwise(F.array().cast("array<string>"))).drop("_text", "content")


def read_folder(spark, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (file_id, filename, mime, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit("application/octet-stream").alias("mime"), "content")
