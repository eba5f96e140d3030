"""Operators for preparing training text. Nothing outside this package imports it."""

from __future__ import annotations

import importlib
from types import ModuleType

_MODULES = ("splitting", "conversations", "vectors", "personal", "forms", "variants", "tokens", "mixing", "subjects")


def query_modules() -> list[ModuleType]:
    """The modules of this package with QUERIES and SQL."""
    return [importlib.import_module(f"quernlake.llm.{m}") for m in _MODULES]
