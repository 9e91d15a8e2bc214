"""Places in a sort order, per key, without putting a key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PLACE_BITS = 33  # monotonically_increasing_id: partition number above, place in it below


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row within its key.

    Range partitioning on key and order splits even a single key over all tasks. The
    sorted rows are written once, so both reads see the same partitions; what is joined
    back is one row per key and partition. Rows should differ in ``keys`` + ``order``.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    inside = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    placed = placed.select("*", part.alias("_part"), inside.alias("_inside")).drop("_at")

    runs = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_inside").alias("_first"))
    if keys:  # rows of the key in earlier partitions: few rows, one per key and partition
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_run"), *[F.col(k).alias(f"_run_{i}") for i, k in enumerate(keys)], "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_run")
    for i, k in enumerate(keys):  # a null key is a key like any other
        same &= F.col(k).eqNullSafe(F.col(f"_run_{i}"))
    return placed.join(runs, same).select(*df.columns, (F.col("_before") + F.col("_inside") - F.col("_first")).alias("rank"))


def best_per_key(rows: DataFrame, keys: Sequence[str], number: str, ties: Sequence[Column], least: bool = False) -> DataFrame:
    """One row of each key: that with the greatest (or least) ``number``, among equal ones the first by ``ties``.

    The number is found by a hash aggregate, the row by a join whose hot partitions Spark can
    split; only rows that tie are sorted. Rows without a key or number are left out.
    """
    best = rows.groupBy(*keys).agg((F.min if least else F.max)(number).alias("_best"))
    tied = rows.join(best, list(keys)).filter(F.col(number) == F.col("_best")).drop("_best")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ties))
    return tied.withColumn("_n", place).filter("_n = 1").drop("_n")


def rank_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: int = 0,
               stop: int | None = None) -> DataFrame:
    """Rows at places ``start`` to ``stop`` (both in; None is the end) of each key, with ``rank``.

    A short slice is a window whose rank limit Spark applies before the shuffle; a
    long or open one is ranked by ``with_rank``.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if keys and stop is not None and stop < limit:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        first = df.withColumn("rank", place).filter(F.col("rank") <= stop + 1)
        return first.withColumn("rank", (F.col("rank") - 1).cast("bigint")).filter(F.col("rank") >= start)
    if not keys and stop is not None and stop < limit:  # top rows of each partition, merged
        few = df.orderBy(*order).limit(stop + 1)
        return few.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")).filter(
            F.col("rank") >= start)
    ranked = with_rank(df, keys, order)
    inside = F.col("rank") >= start
    return ranked.filter(inside if stop is None else inside & (F.col("rank") <= stop))
