"""Registry of queries and their SQL."""

from __future__ import annotations

from . import queries_events, queries_more, queries_objects, queries_samples, queries_space  # noqa: F401
from .registry import ORACLE, QUERIES

FLAGSHIP = "gate_strategy"
__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
