"""The registered queries and their SQL."""

from __future__ import annotations

from . import oracles, queries, stored, stored_oracles

QUERIES = {**queries.QUERIES, **stored.QUERIES}
ORACLES = {**oracles.ORACLES, **stored_oracles.ORACLES}
FLAGSHIP = "o126_threat_levels"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
