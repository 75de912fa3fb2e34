"""The engine's own queries and their oracle SQL, by name."""

from __future__ import annotations

from siltstone.plans.oracles import ORACLES
from siltstone.plans.queries import QUERIES

FLAGSHIP = "compaction_graded"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
