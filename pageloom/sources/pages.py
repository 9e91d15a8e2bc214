"""Page and JSON-page scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A captured-page table: ``page_id, url, html`` and whatever else it holds."""
    return spark.read.format(fmt).options(**options).load(path)
