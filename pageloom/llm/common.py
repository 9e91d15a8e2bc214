"""What several operators share: kept tables, words and shingles, samples of labelled rows, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import prepare, scratch_folder

#: A word, for the JVM and DuckDB: no blank and none of the five control blanks.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables in a new folder beside the checkpoints, which all executors share.

    A kept table cuts the lineage: a lost executor costs no more than the stage that
    is running. ``drop`` frees a table that no later one reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.folder = scratch_folder(spark, name)

    def keep(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """The table as read from its files; with ``folders``, rows lie in a folder for each value of these columns."""
        df.write.mode("overwrite").partitionBy(*folders).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; the bytes that ``split`` parts at are those of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for every run of ``size`` words, in order; fewer words count as one run; none as none."""
    runs = len(hashes) - size + 1
    if runs < 1:
        size, runs = len(hashes), min(len(hashes), 1)
    out = np.full(runs, size, np.uint64)
    for i in range(size if runs else 0):
        out = mixed(out + hashes[i:i + runs])
    return out


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's digits leaves ``part`` when divided by ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def least_hashed(rows: DataFrame, bound: int, at: str, *ties: str) -> DataFrame:
    """The ``bound`` rows with the least hashes in column ``at``, then by ``ties``.

    A sort with a limit sends so many rows from every task to the driver. Hashes are
    even, so beyond twice the share that is wanted no row is sorted at all.
    """
    total = rows.count()
    if total > 2 * bound:
        rows = rows.filter(F.col(at) < F.lit(int(-2**63 + 2**64 * (2 * bound / total))))
    return rows.orderBy(at, *ties).limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep: Column,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``label`` of at most ``bound`` rows of ``labels`` for which ``keep`` holds, by id hash.

    The chosen ids are few enough to broadcast by their bound, so no text is shuffled.
    """
    able = labels.filter(keep & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"), F.xxhash64(id_col).alias("_at"))
    chosen = least_hashed(able, bound, "_at", "_id", "label").drop("_at")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "text", "label")


def small_side(df: DataFrame, numbers: int = 4_000_000) -> DataFrame:
    """``df`` to be broadcast in a join if it holds at most ``numbers`` numbers (those in arrays count each), else as it is.

    Without the broadcast Spark shuffles both sides; the result is the same.
    """
    arrays = [F.size(c) for c, kind in df.dtypes if kind.startswith("array")]
    held = df.agg(F.coalesce(F.sum(sum(arrays, F.lit(len(df.columns)))), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= numbers else df


def _local_stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch, replaced by edges to the smallest node that they connect to within it."""
    for part in parts:
        ends = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        nodes, at = np.unique(ends, return_inverse=True)
        one, two = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(one):
            before = root.copy()
            low = np.minimum(root[one], root[two])
            for end in (root[one], root[two], one, two):
                np.minimum.at(root, end, low)
            root = root[root]
            if (root == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``node, component_id`` (the smallest node reachable) for all nodes of ``edges`` (``a, b`` longs).

    Edges of one batch become stars first. Then alternating stars: every node hands its smallest neighbour first to its larger, then
    to its smaller neighbours, until each edge ends at its component's smallest node. A
    round has one grouped minimum (combined before its shuffle) and one join, whose hot
    partitions Spark can split.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    now, turn = scratch.keep(pairs(edges.select("a", "b").mapInArrow(_local_stars, "a long, b long")), f"{tag}0"), 0
    seen = mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = pairs(large.join(low, "a").select("b", "m").toDF("a", "b").union(low.toDF("a", "b")))
        turn += 1
        now = scratch.keep(small, f"{tag}{turn}")
        if (found := mark(now)) == seen:
            break
        seen = found
        scratch.drop(f"{tag}{turn - 1}")
    # Each edge now leads from a node to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(
        now.select("b", "b").distinct().toDF("node", "component_id"))
