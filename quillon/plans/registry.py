"""Every query by name, with its DuckDB twin or None."""

from . import access, changes, markup, pages, reads, search, streams

QUERIES = pages.QUERIES | access.QUERIES | search.QUERIES | reads.QUERIES | changes.QUERIES | markup.QUERIES | streams.QUERIES
