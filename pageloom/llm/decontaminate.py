"""Benchmark decontamination: item-sized windows, SimHash search and prefixes of shingles, exact verification.

A window has as many words as the item it is compared with. Its fingerprint is the SimHash
of its words. Fingerprints are cut into one block more than the radius has bits, so two
within the radius agree in a block: an equi-join on length, block number and block value
finds them all. Similar windows whose fingerprints lie further apart are found by prefixes:
of two lists of shingles that share enough, ordered by hash, the least shared one is among
the first of both, so an equi-join on length and those shingles misses none. What is found
is verified by the weighted similarity of the five-word shingles (minima over maxima of
their counts).

Both are made only where they can matter: a window can reach the similarity only
if six sevenths of its shingles are shingles of items of its length, which a Bloom filter
of bounded size answers without ever saying no wrongly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, mixed, shingle_hashes, small_side, word_hashes, words

SHINGLE = 5


def fingerprints(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit SimHashes of the windows of ``length`` words: each bit by majority of the words' bits, a tie is 0."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.vstack([np.zeros((1, 64), np.int32), bits.cumsum(0, dtype=np.int32)])
    majority = 2 * (sums[starts + length] - sums[starts]) > length
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingles_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs that windows of ``length`` words are compared by: five words, or all of a shorter window."""
    size = min(SHINGLE, length)
    return shingle_hashes(hashes, size) if len(hashes) >= size else np.zeros(0, np.uint64)


def weighted_similarity(a: list[int], b: list[int]) -> float:
    """Sum of the smaller over sum of the larger counts."""
    one, two = Counter(a), Counter(b)
    both = sum((one & two).values())
    return both / (len(a) + len(b) - both) if a or b else 0.0


def of_length(shingles: np.ndarray, length: int) -> np.ndarray:
    return mixed(shingles ^ np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))


def bloom_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places per key."""
    mask = np.uint64(bits - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def in_bloom(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in bloom_places(keys, 64 * len(table)):
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def windows(hashes: np.ndarray, table: np.ndarray, lengths: list[int], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``item length, starts, shingles`` of a document's windows that may reach the similarity.

    A document shorter than an item has one window for it, the whole document.
    """
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in lengths:
        size = min(SHINGLE, length)
        if size not in known:
            runs = shingles_of(hashes, size)
            known[size] = runs, np.flatnonzero(in_bloom(table, mixed(runs + np.uint64(size))))
        runs, maybe = known[size]
        wanted = length - size + 1
        own = min(wanted, len(runs))
        # Shared shingles that a window of `own` needs against an item of `wanted`.
        least = -(-percent * (wanted + own) // (100 + percent))
        if not own or len(maybe) < least:
            continue
        hit = maybe[in_bloom(table, of_length(runs[maybe], length))]
        if len(hit) >= least:
            sums = np.zeros(len(runs) + 1, np.int64)
            sums[hit + 1] = 1
            sums = sums.cumsum()
            starts = np.flatnonzero(sums[own:] - sums[:len(sums) - own] >= least)
            if len(starts):
                yield length, starts, runs


def prefix(shingles: np.ndarray, shared: int) -> list[int]:
    """The different ones of the least shingles of which one must be shared if ``shared`` are."""
    return np.unique(np.sort(shingles)[:max(1, len(shingles) - shared + 1)]).view(np.int64).tolist()


def _items(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for item_id, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            h = word_hashes(words(text))
            if len(h):
                rows.append((item_id, len(h), fingerprints(h, np.zeros(1, np.int64), len(h)).view(np.int64)[0],
                             shingles_of(h, len(h)).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([int(r[2]) for r in rows], pa.int64()), pa.array([r[3].tolist() for r in rows], pa.list_(pa.int64()))],
            ["item_id", "length", "mark", "shingles"])


def _bloom(items: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of all items' shingles, alone and with their length; at most ``bits`` bits reach the driver."""
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for length, found in zip(part.column("length").to_pylist(), part.column("shingles").to_pylist(), strict=True):
                runs = np.array(found, np.int64).view(np.uint64)
                keys = np.concatenate([mixed(runs + np.uint64(min(SHINGLE, length))), of_length(runs, length)])
                at = np.concatenate(bloom_places(keys, bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> np.uint64(6)).astype(np.int64)),
                     pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    table = np.zeros(bits // 64, np.uint64)
    found = items.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toPandas()
    table[found.word.to_numpy(np.int64)] = found.bit.to_numpy(np.int64).view(np.uint64)
    return table


def _blocks(mark: Column, radius: int) -> list[Column]:
    """One bit field more than ``radius`` has bits, as even as can be."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [F.shiftrightunsigned(mark, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:])]


def find_contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 75, radius: int = 9, most_bits: int = 1 << 28,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity``: the best window of each document for each item it holds.

    Whole texts are read. Null, empty and blank texts hold nothing, and such items are held
    by nothing. Of windows equally similar the first counts. Repeated rows of an id count as
    one document. Rows with a null id or a null item id take no part. Other columns are not
    read; empty tables give no rows. ``most_bits`` bounds the Bloom filter that every task
    holds; a fuller one costs time, not results. The number of different item lengths is
    held by the driver, items are not.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.keep(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null")
        .mapInArrow(_items, "item_id long, length int, mark long, shingles array<long>"), "items")
    lengths = [r.length for r in items.select("length").distinct().orderBy("length").collect()]
    total = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    bits = min(most_bits, 1 << max(16, (32 * int(total)).bit_length()))
    table = scratch.spark.sparkContext.broadcast(_bloom(items, bits))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                h = word_hashes(words(text))
                for length, starts, runs in windows(h, table.value, lengths, percent):
                    own = min(length, len(h))
                    count = own - min(SHINGLE, length) + 1
                    for start, mark in zip(starts.tolist(), fingerprints(h, starts, own).view(np.int64).tolist(), strict=True):
                        out.append((doc_id, length, start, own, mark, runs[start:start + count].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                ["doc_id", "length", "first_word", "n_words", "mark", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    found = scratch.keep(
        texts.mapInArrow(run, "doc_id long, length int, first_word int, n_words int, mark long, shingles array<long>"), "windows")

    def indexed(df: DataFrame, prefix: str) -> DataFrame:
        fields = F.array(*(F.struct(F.lit(i).alias("no"), b.cast("long").alias("value")) for i, b in enumerate(_blocks(F.col("mark"), radius))))
        return df.select(*(F.col(c).alias(c if c == "length" else f"{prefix}{c}") for c in df.columns), F.inline(fields))

    near = indexed(found, "w_").join(indexed(items, "i_"), ["length", "no", "value"]).withColumn(
        "differ", F.col("w_mark").bitwiseXOR(F.col("i_mark"))).filter(F.bit_count("differ") <= radius)
    # A pair agrees in several blocks: it counts at the first.
    first = F.array_position(F.array(*(b.cast("long") for b in _blocks(F.col("differ"), radius))), F.lit(0).cast("long")) - 1
    pair = ["w_doc_id", "w_first_word", "w_n_words", "w_shingles", "i_item_id", "i_shingles"]
    near = near.filter(first == F.col("no")).select(*pair)

    def led(df: DataFrame, side: str) -> DataFrame:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                firsts = []
                for length, found in zip(part.column("length").to_pylist(), part.column("shingles").to_pylist(), strict=True):
                    wanted = length - min(SHINGLE, length) + 1
                    # An item must do for windows of any size, the least similar of which has no other shingles than shared ones.
                    shared = -(-percent * (wanted + len(found)) // (100 + percent)) if side == "w_" else -(-percent * wanted // 100)
                    firsts.append(prefix(np.array(found, np.int64).view(np.uint64), shared))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(firsts, pa.list_(pa.int64()))], [*part.schema.names, "firsts"])

        kinds = ", ".join(f"{c} {kind}" for c, kind in [*df.dtypes, ("firsts", "array<bigint>")])
        return df.mapInArrow(run, kinds).select(
            *(F.col(c).alias(c if c == "length" else f"{side}{c}") for c in df.columns), F.explode("firsts").alias("lead"))

    far = led(found, "w_").join(led(items, "i_"), ["length", "lead"]).filter(
        F.bit_count(F.col("w_mark").bitwiseXOR(F.col("i_mark"))) > radius)
    near = near.union(far.select(*pair))

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            alike = [weighted_similarity(a, b) for a, b in zip(
                part.column("w_shingles").to_pylist(), part.column("i_shingles").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("w_doc_id", "i_item_id", "w_first_word", "w_n_words")] + [pa.array(alike, pa.float64())],
                ["doc_id", "item_id", "first_word", "n_words", "similarity"])
            yield out.filter(pa.array([100 * s >= percent - 1e-9 for s in alike], pa.bool_()))

    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_words")).alias("best")
    return near.mapInArrow(verify, "doc_id long, item_id long, first_word int, n_words int, similarity double").groupBy(
        "doc_id", "item_id").agg(best).select(
            "doc_id", "item_id", (-F.col("best.at")).alias("first_word"), "best.n_words", "best.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no benchmark item; rows with a null id stay."""
    name = fresh(docs, "_found")
    found = find_contamination(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(name)).distinct()
    found = small_side(Scratch(docs.sparkSession, "contaminated").keep(found, "ids"))
    return docs.join(found, docs[id_col].cast("long") == found[name], "left_anti")
