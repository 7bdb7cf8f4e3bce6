"""Named queries over the supplied tables, with their SQL."""

from barloom.catalog import cleaning, files, indicators, joins, ledgers, live, market, quality, reference, screening, statements  # noqa: F401
from barloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
