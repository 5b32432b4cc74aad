"""All queries over the reference data, with their SQL."""

from siltstone.queries import logs, more, predicates, star, workloads  # noqa: F401  each registers its queries
from siltstone.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
