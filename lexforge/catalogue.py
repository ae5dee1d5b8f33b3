"""Every registered query outside the llm subpackage, and the SQL that checks it."""

from __future__ import annotations

from .plans import ledgers, more, registers  # noqa: F401  (they register their queries)
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
