"""The seen set: skip known URLs, record new ones, forget old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_sha1

KEEP_DAYS = 7


def with_fingerprint(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows if "url_sha1" in rows.columns else rows.withColumn("url_sha1", url_sha1(F.col(url)))


def drop_seen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Rows whose URL is not in ``seen``; all rows when there is no seen set.

    A fingerprint that fills a third of ``rows`` meets one row of ``seen``; adaptive
    execution splits such a partition on the left side of an anti join.
    """
    rows = with_fingerprint(rows)
    return rows if seen is None else rows.join(seen.select("url_sha1"), "url_sha1", "left_anti")


def seen_counts(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: how many rows were duplicates of seen URLs, and how many there were.

    Counts per fingerprint are made before the join, so the join has no hot key.
    """
    counts = with_fingerprint(rows).groupBy("url_sha1").agg(F.count("*").alias("n"))
    known = seen.select("url_sha1").distinct().withColumn("hit", F.lit(True))
    return counts.join(known, "url_sha1", "left").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("item_duplicated_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def record_seen(seen: DataFrame | None, rows: DataFrame, at: Column) -> DataFrame:
    """The seen set with the URLs of ``rows`` added; the first time stays."""
    new = with_fingerprint(rows).select("url_sha1", at.alias("seen_at"))
    every = new if seen is None else seen.select("url_sha1", "seen_at").unionByName(new)
    return every.groupBy("url_sha1").agg(F.min("seen_at").alias("seen_at"))


def _expired(now: Column, days: int) -> Column:
    return F.col("seen_at") < now - F.make_dt_interval(days=F.lit(days))


def purge_seen(seen: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    return seen.filter(~_expired(now, days))


def purge_counts(seen: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    return seen.agg(F.count_if(_expired(now, days)).alias("removed"), F.count("*").alias("total"))
