"""All registered queries."""

from __future__ import annotations

from . import speech, waves  # noqa: F401 - they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
