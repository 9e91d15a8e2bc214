"""Seed URLs from a base address, query fields and keywords."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.macros import Macros, keyword_column
from ..functions.text import substitute
from .ranks import best_per_key


def seed_list(spark: SparkSession, addresses: list[str], macros: Macros = Macros()) -> DataFrame:
    """Fixed seeds with their templates filled in."""
    rows = spark.range(1)
    return rows.select(F.explode(F.array(*[macros.expand(a) for a in addresses])).alias("url"))


def seed_urls(keywords: DataFrame, base: str, name: str, query: Mapping[str, object] | None = None,
              as_query: bool = True, col: int = 0, sep: str | None = None,
              sub: Mapping[str, str] | None = None, macros: Macros = Macros()) -> DataFrame:
    """One URL per row of ``keywords(keyword)``: ``url, keyword``.

    ``as_query`` puts the keyword into query field ``name``; otherwise it replaces ``name``
    in the base. The base is one template, so this is a projection and no join.
    """
    value = keyword_column(F.col("keyword"), col, sep)
    if sub:
        value = substitute(value, sub["from"], sub["to"])
    url = seed_url(macros.expand(base), query or {}, macros, name, value, as_query)
    return keywords.withColumn("url", url)


def seed_url(base: Column, query: Mapping[str, object], macros: Macros = Macros(), name: str | None = None,
             value: Column | None = None, as_query: bool = True) -> Column:
    """Base address and query fields; given fields win over those in the base.

    A ``?`` is always there, also with no fields; fields are in key order.
    """
    split = urls.split_url(base)
    fields = urls.string_map({k: macros.expand(v["val"] if isinstance(v, Mapping) else v) for k, v in query.items()})
    path = split["base"]
    if name is not None and as_query:
        fields = urls.merge_maps(fields, urls.string_map({name: value}))
    elif name is not None:
        path = F.replace(path, F.lit(name), value)
    return F.concat(path, F.lit("?"), urls.query_string(urls.merge_maps(split["query"], fields)))


def bind_keywords(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages with the keyword their URL was made from ('' when it was not).

    If two keywords gave one URL, the later row of ``seeds(url, keyword[, ord])`` counts.
    """
    if "ord" in seeds.columns:
        one = best_per_key(seeds.select("url", "keyword", "ord"), ["url"], "ord", [F.desc("keyword")]).select("url", "keyword")
    else:
        place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("keyword")))
        one = seeds.select("url", "keyword", place.alias("_n")).filter("_n = 1").drop("_n")
    return pages.join(one, "url", "left").withColumn("keyword", F.coalesce("keyword", F.lit("")))
