"""Opaque page cursors. Cursors belong to the caller's side, so they are plain strings."""

from __future__ import annotations

import base64
import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_PAGE_SIZE, RequestError


def _encode(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def _decode(cursor: str, message: str) -> str:
    try:
        return base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
    except (ValueError, UnicodeDecodeError):
        raise RequestError("invalid_cursor", message) from None


def encode_id(value: int) -> str:
    return _encode(str(value))


def decode_id(cursor: str | None) -> int | None:
    if not cursor:
        return None
    text = _decode(cursor, "cursor is invalid")
    if not re.fullmatch(r"[0-9]+", text) or not 1 <= int(text) < 2**53:
        raise RequestError("invalid_cursor", "cursor is invalid")
    return int(text)


def encode_offset(offset: int) -> str:
    return _encode(f"search:{offset}")


def decode_offset(cursor: str | None) -> int:
    if not cursor:
        return 0
    found = re.fullmatch(r"search:([0-9]+)", _decode(cursor, "search cursor is invalid"))
    if not found or int(found[1]) >= 2**53:
        raise RequestError("invalid_cursor", "search cursor is invalid")
    return int(found[1])


def fingerprint(**request) -> str:
    """Short hash of everything that defines a result list."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()[:16]


def encode_hybrid(offset: int, request_fingerprint: str) -> str:
    return _encode(json.dumps({"h": request_fingerprint, "o": offset}, separators=(",", ":")))


def decode_hybrid(cursor: str | None, request_fingerprint: str) -> int:
    if not cursor:
        return 0
    message = "search cursor is invalid for this query"
    try:
        content = json.loads(_decode(cursor, message))
        offset = content["o"]
    except (ValueError, KeyError, TypeError):
        raise RequestError("invalid_cursor", message) from None
    if content.get("h") != request_fingerprint or type(offset) is not int or offset < 0:
        raise RequestError("invalid_cursor", message)
    return offset


def strict_limit(limit: int, maximum: int = MAX_PAGE_SIZE) -> int:
    """Limit of an outside request: refused, not clamped, when out of range."""
    if type(limit) is not int or not 1 <= limit <= maximum:
        raise RequestError("invalid_limit", f"limit must be between 1 and {maximum}")
    return limit


def id_cursor(identifier: Column) -> Column:
    """Cursor after a row, as a column."""
    return _url_safe(identifier.cast("string"))


def offset_cursor(offset: Column) -> Column:
    return _url_safe(F.concat(F.lit("search:"), offset.cast("string")))


def _url_safe(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))
