"""Registered queries."""


def all_queries() -> None:
    """Import the modules that register queries."""
    from . import (  # noqa: F401
        date_queries, item_queries, link_queries, parse_queries, seed_queries, stream_queries, table_queries)
