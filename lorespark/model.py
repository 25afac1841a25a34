"""Limits, enumerations and schemas shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Limits and enumerations of the data model.
MAX_TITLE_CHARS = 200
MAX_BODY_BYTES = 2 * 1024 * 1024
MAX_TAGS = 50
MAX_TAG_CHARS = 60
MAX_PROPERTIES = 100
MAX_PROPERTY_CHARS = 2000
MAX_ALIAS_CHARS = 200
MAX_PAGE_SIZE = 100
MAX_EXPLORE_SIZE = 50
CANDIDATES_PER_LIST = 100
RRF_CONSTANT = 60
MAX_ATTEMPTS = 3
MIN_REFRESH_SECONDS = 300
ALIAS_PATTERN = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
PROPERTY_KEY_PATTERN = "^[a-z][a-z0-9_.-]{0,63}$"
PAGE_STATUSES = ("draft", "published", "archived")
CHANGE_SOURCES = ("web", "cli", "rest", "mcp")
SECTION_KINDS = ("heading", "paragraph", "table", "slide", "notes", "sheet", "page", "text", "image")
DOCUMENT_FORMATS = ("docx", "xlsx", "pptx", "pdf", "markdown", "text")
OCR_STATUSES = ("not_required", "pending", "completed", "partial", "unavailable")

LOCATOR = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("slide", T.IntegerType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("range", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)

SECTION = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("locator", LOCATOR),
        T.StructField("text", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("needs_ocr", T.BooleanType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("deleted_at", T.TimestampNTZType()),
        T.StructField("deleted_alias", T.StringType()),
    ]
)


class RequestError(ValueError):
    """A request that the archive refuses; `code` is a stable machine-readable name."""

    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code = code
        self.status = status


@dataclass(frozen=True)
class SectionFilters:
    """Facets of a document search. Any facet set excludes pages from the search."""

    source: str = "all"
    document_id: int | None = None
    document_ids: tuple[int, ...] = ()
    format: str | None = None
    version: int | None = None
    ocr_status: str | None = None
    hidden: bool | None = None
    kind: str | None = None
    updated_after: str | None = None
    updated_before: str | None = None

    @property
    def active(self) -> bool:
        facets = (self.document_id, self.format, self.version, self.ocr_status, self.hidden, self.kind, self.updated_after, self.updated_before)
        return bool(self.document_ids) or any(value is not None for value in facets)

    @property
    def pages_eligible(self) -> bool:
        return self.source != "documents" and not self.active


@dataclass(frozen=True)
class Settings:
    """Tunable budgets with their range checks."""

    chunk_chars: int = 1600
    chunk_overlap: int = 200
    embedding_dimensions: int = 1024
    max_evidence_items: int = 4
    max_evidence_chars: int = 3500
    max_prompt_chars: int = 50_000
    max_answer_chars: int = 3000
    tagging_input_chars: int = 16_000
    max_topics: int = 3
    min_topic_confidence: float = 0.65
    max_archive_entries: int = 100_000
    max_expanded_bytes: int = 2 * 1024**3
    max_compression_ratio: float = 1000
    max_spreadsheet_cells: int = 5_000_000
    max_pdf_pages: int = 10_000
    max_file_bytes: int = 512 * 1024**2
    max_extracted_chars: int = 2_000_000
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.chunk_chars < 1 or not 0 <= self.chunk_overlap < self.chunk_chars:
            raise RequestError("invalid_config", "chunk overlap must be smaller than the chunk size")
        if not 0 <= self.min_topic_confidence <= 1:
            raise RequestError("invalid_config", "minimum confidence must lie in 0..1")
        for name in ("max_evidence_items", "max_evidence_chars", "max_prompt_chars", "max_answer_chars", "max_topics", "tagging_input_chars"):
            if getattr(self, name) < 1:
                raise RequestError("invalid_config", f"{name} must be positive")
