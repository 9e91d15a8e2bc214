"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a shuffled stream of words, cut into blocks of equally many. A schedule
of slots (golden-ratio points looked up in the cumulative target shares) says which
source gives its next block; the slots of a source are ranked, rank r takes block
``r mod blocks`` of pass ``r div blocks``. Each source gets the slots its target needs:
slots beyond it are left out and missing ones follow at the end. The last block of a
source is cut where the target is met.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

GOLDEN = (math.sqrt(5) - 1) / 2


def source_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target words per source: ``share`` of all words by weight, none above ``most`` times its size.

    What a full source cannot take is shared out again by weight. Ends with every target
    at its limit or at one common rate times its weight.
    """
    total, targets = share * sum(sizes), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / weight >= most * sizes[i]}
        for i in full or open_:
            targets[i] = most * sizes[i] if full else left * weights[i] / weight
        if not full:
            break
        open_ -= full
        left = total - sum(t for i, t in enumerate(targets) if i not in open_)
    return targets


def _slots(goal: int, size: int, block_words: int) -> int:
    """Ranks until ``goal`` words are given: the blocks of whole passes, then those of a part of one."""
    return goal // size * -(-size // block_words) + -(-(goal % size) // block_words) if goal else 0


def _counted(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """id, source, size and a shuffle key; nothing of the text is kept."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("place"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                block_words: int = 4096, seed: int = 7, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``(rows, schedule)``: what the mix takes of every document, and the order of its blocks.

    ``rows`` has one row per input row: ``doc_id, size, source_size, target, taken``.
    ``schedule`` has ``slot, source, epoch, block, words``: the mix in order, a block being
    the words ``[block * block_words, ...)`` of the source's shuffled stream. Sources are
    ordered by code point, null last, and take ``weights`` in turn.

    Texts that are null or empty have size 0, take part in no block and get taken 0; a
    source of only such texts has target 0. Repeated rows are separate rows: their order
    among themselves is by size, and rows equal in id and size are interchangeable. An
    empty table gives no rows. Only ids, sources and sizes are read besides counting
    words, so other columns may have any name. The number of sources is bounded by
    ``max_sources``: more raise an error.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    spark = scratch.spark
    rows = scratch.keep(_counted(docs, id_col, source_col, text_col, seed), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    targets = source_targets([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)

    total, low, quotas = sum(targets), 0.0, []
    for i, (r, target) in enumerate(zip(found, targets, strict=True)):
        high = low + (target / total if total else 0.0)
        quotas.append((i, r.source, r.words, target, int(target), -(-r.words // block_words),
                       _slots(int(target), r.words, block_words), low, high))
        low = high
    quota_rows = spark.createDataFrame(
        quotas, "no int, source string, source_size long, target double, goal long, blocks long, quota long, low double, high double")

    # The schedule: points, their source, and ranks from counts of chunks and places within a chunk.
    slots = sum(q[6] for q in quotas)
    highs = [q[8] for q in quotas]

    @F.pandas_udf("int")
    def drawn_source(point: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(highs, point, side="right"), len(highs) - 1))

    chunk = 1 << 16
    drawn = spark.range(slots).select(
        F.col("id").alias("slot"), drawn_source((F.col("id") + 0.5) * GOLDEN % 1.0).alias("no"),
        F.expr(f"id div {chunk}").alias("chunk"))
    per_chunk = drawn.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    before = per_chunk.select("no", "chunk", (F.sum("n").over(Window.partitionBy("no").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = drawn.join(before, ["no", "chunk"]).select(
        "slot", "no", (F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1 + F.col("before")).alias("rank"))
    had = per_chunk.groupBy("no").agg(F.sum("n").alias("had"))
    missing = (
        quota_rows.join(had, "no", "left").select("no", "quota", F.coalesce("had", F.lit(0)).alias("had")).filter("had < quota")
        .select((F.lit(slots) + F.col("no")).alias("slot"), "no", F.explode(F.sequence("had", F.col("quota") - 1)).alias("rank")))
    schedule = (
        ranked.unionByName(missing).join(F.broadcast(quota_rows), "no").filter("rank < quota")
        .select("slot", "source", "no", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"),
                "source_size", "goal", "blocks")
        .withColumn("length", F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words))
        # A source's words before this slot: whole passes, then whole blocks.
        .withColumn("words", F.greatest(F.lit(0), F.least(
            "length", F.expr(f"goal - epoch * source_size - block * {block_words}")))))
    schedule = scratch.keep(schedule.filter("words > 0"), "schedule")

    taken = _taken(rows, schedule, quota_rows, block_words)
    sources = F.broadcast(quota_rows.select("source", "no", "source_size", "target"))
    out = taken.join(sources.drop("source"), "no").select("doc_id", "size", "source_size", "target", "taken")
    return out, schedule.select("slot", "source", "epoch", "block", "words")


def _taken(rows: DataFrame, schedule: DataFrame, quotas: DataFrame, block_words: int) -> DataFrame:
    """Words taken per row: its place in the source's stream, joined with the blocks it lies in.

    Places are sums over hash ranges, then sums within a range of about a million words, so
    no task gets a whole source. A join key is one block: at most ``block_words`` documents.
    """
    ranges = F.broadcast(quotas.select(
        F.col("source").alias("_source"), "no", F.greatest(F.lit(1), F.expr("source_size div 1000000")).alias("parts")))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "part", F.expr("pmod(shiftright(place, 20), parts)"))
    sums = rows.groupBy("no", "part").agg(F.sum("size").alias("words"))
    sums = sums.select("no", "part", (F.sum("words").over(Window.partitionBy("no").orderBy("part")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("no", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_end", F.sum("size").over(inside)).join(sums, ["no", "part"]).select(
        "doc_id", "size", "no", (F.col("before") + F.col("_end") - F.col("size")).alias("start"))
    uses = schedule.groupBy("no", "block").agg(F.count("*").alias("times"),
                                               F.min("words").alias("least"), F.max("words").alias("whole"))
    within = placed.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    # All uses of a block are whole but the one that meets the target, which has `least` words.
    begin = F.greatest(F.lit(0), F.col("start") - F.col("block") * block_words)
    end = F.least(F.lit(block_words), F.col("start") + F.col("size") - F.col("block") * block_words)
    cut = F.greatest(F.lit(0), F.least(end, F.col("least")) - begin)
    hit = within.join(uses, ["no", "block"]).select(
        "no", "start", "size", "doc_id",
        F.when(F.col("least") == F.col("whole"), F.col("times") * F.greatest(F.lit(0), F.least(end, F.col("whole")) - begin))
        .otherwise((F.col("times") - 1) * (end - begin) + cut).alias("part_taken"))
    per_doc = hit.groupBy("no", "start").agg(F.sum("part_taken").alias("taken"))
    filled = placed.filter("size > 0").join(per_doc, ["no", "start"], "left")
    return filled.select("doc_id", "size", "no", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(
        placed.filter("size = 0").select("doc_id", "size", "no", F.lit(0).cast("long").alias("taken")))
