"""All named queries of the library and their SQL."""

from tidings.plans import accounts, aggregates, edits, incidents, intake, joining, lists, paging, presence, second_fact, state, texts, tiers, workbooks  # noqa: F401
from tidings.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
