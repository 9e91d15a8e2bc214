"""Keyword sources and their union: exclude, file, range, list, in this order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import strip


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``keyword`` from text lines: trimmed, no blank and no ``#`` lines."""
    words = lines.withColumn("keyword", strip(F.col(column))).drop(column)
    return words.filter((F.col("keyword") != "") & ~F.col("keyword").startswith("#"))


def numbered_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``keyword, ord``; ``ord`` follows the line order inside one file."""
    numbered = lines.select(F.col(column), F.monotonically_increasing_id().alias("ord"))
    return clean_lines(numbered, column).select("keyword", "ord")


def keyword_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return numbered_lines(spark.read.text(path))


def keyword_range(spark: SparkSession, start: int = 0, stop: int = 0, step: int = 1) -> DataFrame:
    """Half-open range of whole numbers, as text."""
    ids = spark.range(start, stop, step)
    return ids.select(F.col("id").cast("string").alias("keyword"), (F.col("id") * (1 if step > 0 else -1)).alias("ord"))


def keyword_list(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "keyword string, ord bigint")


def combine_keywords(sources: Sequence[DataFrame], exclude: DataFrame | None = None) -> DataFrame:
    """Distinct keywords of all sources; a keyword keeps its first source and place.

    ``keyword, source, ord``: ``orderBy("source", "ord")`` is the reading order. One minimum
    per source is kept in a hash aggregate: copies are merged before the shuffle, so a
    keyword with very many copies is no hot key, and nothing is sorted.
    """
    every = None
    for i, source in enumerate(sources):
        rows = source.select("keyword", F.lit(i).alias("source"), "ord")
        every = rows if every is None else every.unionByName(rows)
    places = [f"_ord_{i}" for i in range(len(sources))]
    first = every.groupBy("keyword").agg(
        *[F.min(F.when(F.col("source") == i, F.col("ord"))).alias(place) for i, place in enumerate(places)])
    number = F.coalesce(*[F.when(F.col(place).isNotNull(), i) for i, place in enumerate(places)])
    first = first.select("keyword", number.alias("source"), F.coalesce(*places).alias("ord"))
    return first if exclude is None else first.join(exclude.select("keyword"), "keyword", "left_anti")
