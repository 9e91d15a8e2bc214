"""Audit of how the sources of a language differ in their words.

Term counts per (language, source) group become probabilities in billionths, in whole
numbers. Every group is compared with each other source of its language (sum of
differences over all kept terms) and with the language as a whole (the terms it uses
most beyond the language's share).

The second part keeps a dominance skyband: a term that at least ``top`` others of its
group beat in all of group count (higher), language count (lower) and UTF-8 order
(earlier) cannot be among the ``top``, whatever the totals are. Partitions keep their
skybands, these are merged in two steps, and only what is left is ranked by value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side

#: Bytes of terms: letters, A-Z lowered, and all that is not ASCII; the others part terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])
_ROWS = "lang string, source string, term string, count long, lang_count long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, by pieces of about a megabyte that end where a term ends."""
    text, low = text.translate(_LETTERS), 0
    while low < len(text):
        high = text.find(b" ", low + _PIECE)
        high = len(text) if high < 0 else high
        yield text[low:high].split()
        low = high


def _count_terms(most: int):
    """Occurrences and documents per group and term, added up within a task until ``most`` entries are held."""
    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            found = list(count)
            for low in range(0, len(found), 1 << 16):
                part = found[low:low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()),
                    pa.array(map(count.__getitem__, part), pa.int64()), pa.array(map(docs.__getitem__, part), pa.int64())], schema=_COUNTED)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for part in parts:
            for text, lang, source in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(count)
                seen: set[bytes] = set()
                for found in _terms(text):
                    count.update(found)
                    seen.update(found)
                docs.update(seen)
                size += len(count)
                if size > most:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)
    return count


def skyband(count: np.ndarray, lang_count: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of rows that fewer than ``k`` others dominate: count as high, language count as low, place before.

    Rows come in order of falling count, so dominators come first; the first ``k`` of a
    row are themselves in the skyband, so comparing with what was kept is enough.
    """
    order = np.lexsort((place, lang_count, -count))
    low, before, kept = lang_count[:0], place[:0], order[:0]
    for start in range(0, len(order), 512):
        now = order[start:start + 512]
        beaten = ((low <= lang_count[now, None]) & (before < place[now, None])).sum(1)
        now, beaten = now[beaten < k], beaten[beaten < k]
        inside = (lang_count[now] <= lang_count[now, None]) & (place[now] < place[now, None])
        now = now[beaten + np.tril(inside, -1).sum(1) < k]
        kept, low, before = np.append(kept, now), np.append(low, lang_count[now]), np.append(before, place[now])
    return kept


def _keep_skyband(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Skybands of all groups of ``rows``."""
    if rows.empty:
        return rows
    found = rows["term"].map(lambda t: t.encode("utf-8", "surrogatepass")).to_numpy()
    place = np.empty(len(rows), np.int64)
    place[np.argsort(found, kind="stable")] = np.arange(len(rows))
    count, lang_count = rows["count"].to_numpy(), rows["lang_count"].to_numpy()
    kept = [at[skyband(count[at], lang_count[at], place[at], k)] for at in rows.groupby(["lang", "source"], sort=False).indices.values()]
    return rows.iloc[np.concatenate(kept)]


def _share(count: Column | str, total: str, terms: str) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 terms))`` in whole numbers of 38 digits."""
    count = F.col(count) if isinstance(count, str) else count
    above = (count.cast("decimal(20,0)") + F.lit(5)).cast("decimal(22,0)") * F.lit(10**9).cast("decimal(11,0)")
    below = F.col(total).cast("decimal(20,0)") + F.col(terms).cast("decimal(18,0)") * F.lit(5).cast("decimal(1,0)")
    return F.floor(F.call_function("div", above, below)).cast("long") + 1


def _differences(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences over the terms of one chunk, for all pairs of sources of two blocks.

    Rows without a term give a source's share of a term that it lacks.
    """
    lang, _, one, two = key
    base = rows[rows["term"].isna()].drop_duplicates("no").sort_values("no")
    cells = rows[rows["term"].notna()]
    sources = base["no"].to_numpy()
    terms, at = np.unique(cells["term"].to_numpy(str), return_inverse=True) if len(cells) else (np.empty(0, str), np.empty(0, int))
    table = np.repeat(base["p"].to_numpy()[:, None], len(terms), axis=1)
    table[np.searchsorted(sources, cells["no"].to_numpy()), at] = cells["p"].to_numpy()
    block, out = base["block"].to_numpy(), []
    for i in np.flatnonzero(block == one):
        others = np.flatnonzero((block == two) & (sources > sources[i]))
        out.append(pd.DataFrame({"a": sources[i], "b": sources[others], "f": np.abs(table[others] - table[i]).sum(1)}))
    found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "f": []})
    return found.assign(lang=lang, terms=len(terms))[["lang", "a", "b", "f", "terms"]].astype({"a": int, "b": int, "f": int, "terms": int})


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source",
                  text_col: str = "text", most_entries: int = 400_000, chunk_terms: int = 4096, block_sources: int = 128) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from others and from its language.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps
    the terms that occur in ``least_docs`` of its documents or more. Part ``pair`` has one
    row for every other source of the language, part ``term`` the first ``top`` terms that the
    group has more of than the language. Ranks are by value descending, then item.

    Null text, language or source count as empty. Empty texts still make their group
    occur. Repeated rows are separate documents. An empty table gives no rows. Only the three named
    columns are read. A language without kept terms has pairs of value 0 and no terms.
    A task holds ``most_entries`` counts, or a table of ``2 * block_sources`` by about ``chunk_terms`` shares.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counted = named.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(
        _count_terms(most_entries), "lang string, source string, term binary, count long, docs long")
    counts = scratch.keep(counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")

    whole = counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = scratch.keep(counts.select("lang", "source", "term", "count").join(whole.drop("docs"), ["lang", "term"]).select(
        "lang", "source", "term", "count", "lang_count"), "kept")
    scratch.drop("counts")

    # One row for each group, with its total, and its language's.
    langs = kept.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    groups = named.select("lang", "source").distinct().join(
        kept.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = scratch.keep(groups.na.fill(0, ["total", "terms", "lang_total"]).withColumn("no", F.row_number().over(by_name).cast("long")), "groups")
    some = small_side(groups)
    return _pairs(kept, groups, some, chunk_terms, block_sources).unionByName(_top_terms(kept, some, top))


def _pairs(kept: DataFrame, groups: DataFrame, some: DataFrame, chunk_terms: int, block_sources: int) -> DataFrame:
    """All pairs of sources of a language: differences over chunks of terms and blocks of sources, added up.

    Terms that neither block has differ by the shares of absent terms, so are only counted.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk_terms)).cast("long")
    blocks = F.max("no").over(Window.partitionBy("lang")) / block_sources
    absent = F.when(F.col("terms") > 0, _share(F.lit(0), "total", "terms")).otherwise(0)
    base = groups.withColumns({"block": F.floor((F.col("no") - 1) / block_sources), "blocks": F.ceil(blocks), "p": absent})
    cells = kept.join(some, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), chunks).alias("chunk"), "no", F.floor((F.col("no") - 1) / block_sources).alias("block"),
        "term", _share("count", "total", "terms").alias("p"))
    number = base.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    rows = cells.join(small_side(number), "lang").select("lang", "chunk", "no", "block", "blocks", "term", "p").unionByName(base.select(
        "lang", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "no", "block", "blocks", F.lit(None).cast("string").alias("term"), "p"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    sums = met.groupBy("lang", "chunk", "one", "two").applyInPandas(_differences, "lang string, a long, b long, f long, terms long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("terms").alias("seen"))
    side = {n: base.select("lang", F.col("no").alias(n), F.col("source").alias(f"source_{n}"), F.col("p").alias(f"p_{n}"), *more)
            for n, more in (("a", ["terms"]), ("b", []))}
    value = F.col("f") + (F.col("terms") - F.col("seen")) * F.abs(F.col("p_a") - F.col("p_b"))
    both = sums.join(side["a"], ["lang", "a"]).join(side["b"], ["lang", "b"]).select("lang", "source_a", "source_b", value.alias("value"))
    both = both.select("lang", "value", F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("pair"))
    rows = both.select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _top_terms(kept: DataFrame, some: DataFrame, top: int, salts: int = 32) -> DataFrame:
    """The ``top`` terms of each group: skybands of partitions, merged by salts, then whole, then ranked exactly."""
    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        limit, size = 1 << 17, 0
        for part in parts:
            held.append(part.to_pandas())
            size += part.num_rows
            if size > limit:
                held = [_keep_skyband(pd.concat(held, ignore_index=True), top)]
                size = len(held[0])
                limit = max(limit, 2 * size)
        if held:
            out = _keep_skyband(pd.concat(held, ignore_index=True), top)
            for low in range(0, len(out), 1 << 14):
                yield pa.RecordBatch.from_pandas(out.iloc[low:low + (1 << 14)], preserve_index=False)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _keep_skyband(rows, top)[["lang", "source", "term", "count", "lang_count"]]

    parts = kept.mapInArrow(local, _ROWS).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    band = parts.groupBy("lang", "source", "salt").applyInPandas(merge, _ROWS).groupBy("lang", "source").applyInPandas(merge, _ROWS)
    value = _share("count", "total", "terms") - _share("lang_count", "lang_total", "terms")
    found = band.join(some, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.filter("value > 0").withColumn("rank", place).filter(F.col("rank") <= top)
