"""Quality rules, line deduplication, near duplicates, secrets and packing, one after the other over ``documents``."""

from __future__ import annotations

from pagewright.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
