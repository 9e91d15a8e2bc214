"""Keyword scans of document tables and of keyed collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import rank_slice

def parse_slice(address: str) -> tuple[str, int, int | None]:
    """``key[a:b]`` -> (key, a, b); both ends are in, an open end is None."""
    key, bracket, rest = address.partition("[")
    if not bracket:
        rest = ":]"
    ends = rest[:-1].split(":")
    if not key or not rest.endswith("]") or len(ends) != 2 or not all(e == "" or e.isdecimal() for e in ends):
        raise ValueError(f"not a key or slice: {address!r}")
    start, stop = (int(e) if e else None for e in ends)
    return key, start or 0, stop


def document_keywords(table: DataFrame, address: str, order: str) -> DataFrame:
    """Distinct values of one column; ``column[a:b]`` takes rows a to b in ``order``."""
    column, start, stop = parse_slice(address)
    rows = table.select(F.col(column).cast("string").alias("keyword"), F.col(order).alias("_order"))
    if start > 0 or stop is not None:
        rows = rank_slice(rows, [], ["_order"], start, stop)
    return rows.select("keyword").distinct()


def collection_keywords(table: DataFrame, address: str, kind: str) -> DataFrame:
    """Distinct members of one key of ``table(key, member, score)``.

    ``kind``: ``zset`` takes a slice by score, then member; ``set``, ``hash`` and
    ``string`` take all values.
    """
    key, start, stop = parse_slice(address)
    rows = table.filter(F.col("key") == key)
    if kind == "zset":
        rows = rank_slice(rows.select("key", "member", "score"), ["key"], ["score", "member"], start, stop)
    elif kind not in ("set", "hash", "string"):
        raise ValueError(f"unknown collection kind {kind!r}")
    return rows.select(F.col("member").alias("keyword")).distinct()
