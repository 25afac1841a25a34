"""All registered queries and their SQL checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("reading", "search", "texts", "structure", "answers", "state", "records")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"{__package__}.{name}"), attribute)
        repeated = merged.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(part)
    return merged


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
