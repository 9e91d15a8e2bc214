"""Named queries over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from ..sources.pages import read_pages


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read when asked for."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if name == "pages":
            return read_pages(self.spark, path)
        df = self.spark.read.parquet(path)
        local = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name."""
    def add(plan: Plan) -> Plan:
        PLANS[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan
    return add


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(Tables(prepare(spark), folder))
