"""Query catalogue: every named query with its SQL twin."""

from __future__ import annotations


def core_queries() -> dict:
    """name -> (query, SQL or None) of all queries of the core."""
    from . import articles, links

    return {**articles.QUERIES, **links.QUERIES}
