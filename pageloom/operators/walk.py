"""Follow links page to page over a captured page table."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_sha1
from ..session import cut_lineage
from .links import LinkRule, extract_links


def link_edges(pages: DataFrame, rules: Iterable[LinkRule], domains: Iterable[str] = ()) -> DataFrame:
    """Links as ``(src_sha1, url_sha1, url, do_follow)``, each once."""
    links = extract_links(pages, rules, domains)
    return links.select(url_sha1(F.col("src_url")).alias("src_sha1"), url_sha1(F.col("url")).alias("url_sha1"),
                        "url", "do_follow").distinct()


def walk(pages: DataFrame, seeds: DataFrame, rules: Iterable[LinkRule], max_depth: int | None = None,
         domains: Iterable[str] = ()) -> DataFrame:
    """URLs reached from ``seeds(url)``, in at most ``max_depth`` steps if that is given, else until nothing is new.

    Columns ``url_sha1, url, depth``; depth 0 is a seed. A link that is only parsed
    (``follow`` False) is reached but not walked on from. The pages' source is read
    once, into an edge table. A hop joins the new fingerprints with the edges, keeps one
    row per target (before the shuffle) and drops what was reached before; addresses are
    looked up once, at the end. The edges are laid out by source once, so a hop does not
    move them again.
    """
    edges = cut_lineage(link_edges(pages, rules, domains).repartition("src_sha1"))
    start = seeds.select(url_sha1(F.col("url")).alias("url_sha1"), "url")
    frontier = cut_lineage(start.select("url_sha1", F.lit(True).alias("go_on"), F.lit(0).alias("depth")).distinct())
    reached = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        sources = frontier.filter("go_on").select(F.col("url_sha1").alias("src_sha1"))
        targets = edges.join(sources, "src_sha1", "left_semi")
        targets = targets.groupBy("url_sha1").agg(F.max("do_follow").alias("go_on"))
        # a URL reached before only by a parsed link may now be walked on from
        known = reached.groupBy("url_sha1").agg(F.max("go_on").alias("known_go_on"), F.min("depth").alias("first"))
        new = targets.join(known, "url_sha1", "left").filter(
            F.col("known_go_on").isNull() | (F.col("go_on") & ~F.col("known_go_on")))
        frontier = cut_lineage(new.select("url_sha1", "go_on", F.coalesce("first", F.lit(depth)).alias("depth")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    reached = reached.groupBy("url_sha1").agg(F.min("depth").alias("depth"))
    names = edges.select("url_sha1", "url").union(start).join(reached, "url_sha1", "left_semi")
    names = names.groupBy("url_sha1").agg(F.min("url").alias("url"))
    return reached.join(names, "url_sha1").select("url_sha1", "url", "depth")


def walked_pages(pages: DataFrame, reached: DataFrame) -> DataFrame:
    """The captured pages that were reached, with their depth."""
    keyed = pages.withColumn("url_sha1", url_sha1(F.col("url")))
    return keyed.join(reached.select("url_sha1", "depth"), "url_sha1")
