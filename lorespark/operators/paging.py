"""Ordered pages of results. Each limit is the page size that the caller asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import strict_limit, decode_id, decode_offset, encode_id, encode_offset
from .filters import active, deleted, with_status


def keyset_page(rows: DataFrame, cursor: str | None, limit: int, key: str = "id") -> DataFrame:
    """Newest first, after the cursor, with one look-ahead row."""
    after = decode_id(cursor)
    if after is not None:
        rows = rows.filter(F.col(key) < after)
    return rows.orderBy(F.desc(key)).limit(strict_limit(limit) + 1)


def list_pages(pages: DataFrame, cursor: str | None = None, limit: int = 50, status: str = "published") -> DataFrame:
    return keyset_page(with_status(active(pages), status), cursor, limit)


def list_trash(pages: DataFrame, cursor: str | None = None, limit: int = 50) -> DataFrame:
    return keyset_page(deleted(pages), cursor, limit)


def list_revisions(revisions: DataFrame, page_id: int, cursor: str | None = None, limit: int = 50) -> DataFrame:
    return keyset_page(revisions.filter(F.col("page_id") == page_id), cursor, limit)


def recent(pages: DataFrame, limit: int = 20, status: str = "published") -> DataFrame:
    return with_status(active(pages), status).orderBy(F.desc("updated_at"), F.desc("id")).limit(strict_limit(limit))


def offset_page(rows: DataFrame, cursor: str | None, limit: int, *order) -> DataFrame:
    return rows.orderBy(*order).offset(decode_offset(cursor)).limit(strict_limit(limit) + 1)


def section_page(sections: DataFrame, version_id: int, offset: int = 0, limit: int = 50) -> DataFrame:
    return sections.filter(F.col("version_id") == version_id).orderBy("ordinal").offset(max(0, offset)).limit(strict_limit(limit) + 1)


def title_order(column: str = "title"):
    return F.lower(F.col(column))


def take_keyset(page: DataFrame, limit: int, key: str = "id") -> tuple[list, str | None]:
    """Rows of one page and the next cursor. At most 101 rows reach the caller."""
    size = strict_limit(limit)
    rows = page.take(size + 1)
    return rows[:size], encode_id(rows[size - 1][key]) if len(rows) > size else None


def take_offset(page: DataFrame, cursor: str | None, limit: int) -> tuple[list, str | None]:
    size = strict_limit(limit)
    rows = page.take(size + 1)
    return rows[:size], encode_offset(decode_offset(cursor) + size) if len(rows) > size else None
