"""All registered queries; importing the modules fills the registry."""

from lorekeep.plans.catalog import chunks_q, pages_q, search_q, store_q, urls_q
from lorekeep.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
