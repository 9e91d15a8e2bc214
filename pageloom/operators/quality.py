"""What was lost and how long it took."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import freshness


def field_quality(parsed: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Per field: rows where its list is empty, and all rows.

    ``parsed`` comes from ``extract_*_items(..., drop_incomplete=False)``. One pass and one
    partial result per task; the row per field is made after that.
    """
    fields = list(fields)
    counts = parsed.agg(F.count("*").alias("total"), *[F.count_if(F.size(f) == 0).alias(f"n_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("missing")) for f in fields])
    return counts.select(F.inline(rows), "total")


def run_stats(rows: DataFrame, started: Column, finished: Column, reason: str = "finished",
              counters: Mapping[str, Column] | None = None, **labels: str) -> DataFrame:
    """One row about a run; dots in counter names become ``_``."""
    more = {k.replace(".", "_"): v for k, v in (counters or {}).items()}
    begin, end = F.unix_seconds(started), F.unix_seconds(finished)
    stats = rows.agg(begin.alias("start_time"), end.alias("finish_time"), (end - begin).alias("elapsed_seconds"),
                     F.count("*").alias("item_count"), *[v.alias(k) for k, v in more.items()])
    return stats.select("*", F.lit(reason).alias("finish_reason"), *[F.lit(v).alias(k) for k, v in labels.items()])


def observe_run(rows: DataFrame, name: str = "run", **counters: Column) -> tuple[DataFrame, Observation]:
    """Count while the rows are written, without a second pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("item_count"), *[v.alias(k) for k, v in counters.items()]), seen


def freshness_counts(rows: DataFrame, ts: Column, now: Column) -> DataFrame:
    return rows.groupBy(freshness(ts, now).alias("freshness")).agg(F.count("*").alias("n"))
