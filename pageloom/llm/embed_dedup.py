"""Near-duplicate embeddings by a pivot-permutation index.

Every vector is described by its nearest reference vectors (pivots) in order. Inverted
lists, one per label and pivot, bring together vectors that have the pivot among their
nearest; pairs that share enough pivots are candidates, and their cosine is verified in
double precision. A long list is cut into blocks and its pairs of blocks are spread over
tasks, so no task holds a whole list. Equal vectors of a label are one class.

Pivots say little inside a large group of near vectors, so such groups have an exact way:
vectors near a leader (a sampled vector, leaders being far from each other) are in its
cell, and by the triangle inequality all that may link with a member of the cell lie
within its radius and the angle of a link. These are compared with the members one by one;
only pairs of which neither vector is in a cell depend on shared pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Scratch, components, least_hashed

BLOCK = 512
#: Numbers of one block of a cell, and cells that a vector may be compared in on average.
CELL_NUMBERS, MOST_CELLS = 4_000_000, 8


def usable(vector) -> np.ndarray | None:
    """The vector as doubles if it has a direction: no null or non-finite component, not all zero."""
    if vector is None or not len(vector):
        return None
    x = np.array(vector, np.float64)  # None becomes NaN
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so squares neither overflow nor vanish."""
    x = x / abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Per row the places of its ``near`` closest pivots, closest first."""
    near = min(near, len(pivots))
    close = unit(x) @ pivots.T
    some = np.argpartition(-close, near - 1, axis=1)[:, :near]
    order = np.argsort(-np.take_along_axis(close, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def spread_out(units: np.ndarray, least: float, most: int) -> np.ndarray:
    """The first ``most`` rows, in order, that have no cosine of ``least`` or more with one taken before."""
    taken = np.zeros((0, units.shape[1]))
    for lo in range(0, len(units), BLOCK):
        some = units[lo:lo + BLOCK]
        some = some[(some @ taken.T < least).all(1)]
        far, keep = some @ some.T < least, []
        for i in range(len(some)):
            if far[i, keep].all():
                keep.append(i)
        taken = np.vstack([taken, some[keep]])[:most]
    return taken


def leaders_of(units: np.ndarray, least: float, most: int) -> tuple[np.ndarray, float]:
    """Leaders and the widest radius of their cells: the link's angle twice, once or half, so that cells overlap little."""
    link = float(angles(np.array(least)))
    for radius in (2 * link, link, link / 2):
        leaders = spread_out(units, math.cos(min(radius, math.pi)), most)
        reached = sum(int((angles(units[lo:lo + BLOCK] @ leaders.T) <= radius + link).sum()) for lo in range(0, len(units), BLOCK))
        if reached <= MOST_CELLS * len(units):
            return leaders, radius
    return leaders[:0], 0.0


def links_in_cell(home: np.ndarray, x: np.ndarray, blocks: np.ndarray, pair: tuple[int, int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell (of its block pair) that reach the cosine and have a member of the cell."""
    one, two = np.flatnonzero(blocks == pair[0]), np.flatnonzero(blocks == pair[1])
    u, found = unit(x), [(np.zeros(0, int), np.zeros(0, int))]
    for lo in range(0, len(one), BLOCK):
        some = one[lo:lo + BLOCK]
        i, j = np.nonzero((u[some] @ u[two].T >= least - 1e-9) & (home[some][:, None] | home[two]))
        a, b = some[i], two[j]
        once = a < b if pair[0] == pair[1] else np.ones(len(a), bool)
        a, b = a[once], b[once]
        for at in range(0, len(a), 1 << 16):
            c, d = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
            near = np.einsum("ij,ij->i", u[c], u[d]) >= least
            found.append((c[near], d[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def links_in_blocks(pivot: int, lists: np.ndarray, x: np.ndarray, blocks: np.ndarray, pair: tuple[int, int],
                    shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list (of its block pair) that share ``shared`` pivots and reach the cosine.

    A pair is given in the list of its smallest shared pivot only.
    """
    named, place = np.unique(lists, return_inverse=True)
    member = np.zeros((len(lists), len(named)), np.float32)
    member[np.arange(len(lists))[:, None], place.reshape(lists.shape)] = 1
    one = np.flatnonzero(blocks == pair[0])
    two = np.flatnonzero(blocks == pair[1])
    smaller = member[:, named < pivot]
    i, j = np.nonzero((member[one] @ member[two].T >= shared) & (smaller[one] @ smaller[two].T == 0))
    a, b = one[i], two[j]
    once = a < b if pair[0] == pair[1] else np.ones(len(a), bool)
    a, b = a[once], b[once]
    u = unit(x)
    near = np.einsum("ij,ij->i", u[a], u[b]) >= least if len(a) else np.zeros(0, bool)
    return a[near], b[near]


def near_vectors(rows: DataFrame, least: float = 0.93, near: int = 12, shared: int = 3, most_pivots: int = 16_384,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Only vectors of equal, not null label and equal length are compared. Null, empty and zero
    vectors and those with a null or non-finite component link with nothing. Rows with a
    null id link with nothing, get a null component and are not kept. Rows of one id are one
    node of the components, but each counts as a vector. Other columns are not read; an
    empty table gives no rows.

    Twice the root of the number of different vectors are pivots, ``most_pivots`` at most:
    those of least id hash, without those that link with one taken before. Leaders are
    drawn from the same sample. Every pair with a vector in a leader's cell is compared; the
    other vectors are indexed by pivots. A pair of vectors with fewer pivots than ``shared``
    between them needs all they have.
    """
    scratch = Scratch(rows.sparkSession, "vectors")

    def described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, sizes = [], []
            for v in part.column("vector").to_pylist():
                x = usable(v)
                keys.append(None if x is None else xxh3_128_digest((x + 0.0).tobytes()))
                sizes.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), part.column("vector"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())],
                ["vec_id", "label", "vector", "key", "size"])

    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                        F.col(vector_col).cast("array<double>").alias("vector"))
    all_ = scratch.keep(given.mapInArrow(described, "vec_id long, label string, vector array<double>, key binary, size int"), "vectors")
    able = all_.filter("key is not null and label is not null and vec_id is not null")
    classes = able.groupBy("label", "key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    own = scratch.keep(able.select("label", "key", "vec_id", "vector", "size").join(
        classes.withColumnRenamed("class_id", "vec_id"), ["label", "key", "vec_id"]).dropDuplicates(["label", "key"]), "own")

    total = classes.count()
    wanted = min(most_pivots, max(16, math.ceil(2 * math.sqrt(total))))
    chosen = least_hashed(own.select("size", "vector", F.xxhash64("vec_id").alias("at"), "vec_id"), 2 * wanted, "at", "vec_id").toPandas()
    by_size = {}
    for s, g in chosen.groupby("size"):
        units = unit(np.array(g.vector.tolist(), float))
        by_size[int(s)] = spread_out(units, least, wanted), *leaders_of(units, least, wanted)
    pivots = scratch.spark.sparkContext.broadcast(by_size)
    link = float(angles(np.array(least)))

    def indexed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = np.array(part.column("size").to_pylist(), int)
            vectors = part.column("vector").to_pylist()
            lists: list = [None] * len(sizes)
            homes: list = [None] * len(sizes)
            aways: list = [0.0] * len(sizes)
            cells: list = [[] for _ in sizes]
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                x = np.array([vectors[i] for i in at], float)
                # A length without pivots has one list of all its vectors.
                known, leaders, radius = pivots.value.get(int(s), (None, np.zeros((0, s)), 0.0))
                found = nearest_pivots(x, known, near) if known is not None else np.zeros((len(at), 1), int)
                for i, f in zip(at, found.tolist(), strict=True):
                    lists[i] = f
                if len(leaders):
                    away = angles(unit(x) @ leaders.T)
                    for i, row, home in zip(at, away, away.argmin(1).tolist(), strict=True):
                        aways[i] = float(row[home])
                        if row[home] <= radius:
                            homes[i] = home
                        cells[i] = [{"cell": int(c), "away": float(row[c])} for c in np.flatnonzero(row <= radius + link + 1e-6)]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("label", "vec_id", "copies", "size", "vector")] + [
                    pa.array(lists, pa.list_(pa.int32())), pa.array(homes, pa.int32()), pa.array(aways, pa.float64()),
                    pa.array(cells, pa.list_(pa.struct([("cell", pa.int32()), ("away", pa.float64())])))],
                ["label", "vec_id", "copies", "size", "vector", "pivots", "home", "away", "cells"])

    index = scratch.keep(own.select("label", "vec_id", "copies", "size", "vector").mapInArrow(
        indexed, "label string, vec_id long, copies long, size int, vector array<double>, pivots array<int>, home int, away double, "
        "cells array<struct<cell:int,away:double>>"), "index")
    entries = index.filter("home is null").drop("home", "away", "cells").withColumn("pivot", F.explode("pivots"))
    lengths = entries.groupBy("label", "size", "pivot").agg(F.count("*").alias("n")).filter("n > 1").withColumn(
        "cut", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("cut")).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row once for every block that its own is compared with."""
        return (rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
                .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "cut", "n"))

    spread = dealt(entries.join(lengths, ["label", "size", "pivot"]))
    radii = index.filter("home is not null").groupBy("label", "size", F.col("home").alias("cell")).agg(F.max("away").alias("radius"))
    # A pair of two members of cells is compared in the lower cell.
    visits = index.select("label", "vec_id", "copies", "size", "vector", "home", F.inline("cells")).filter("home is null or home >= cell")
    visits = visits.join(radii, ["label", "size", "cell"]).filter(F.col("away") <= F.col("radius") + link + 1e-6).drop("away", "radius")
    visits = scratch.keep(visits, "visits")
    crowds = visits.groupBy("label", "size", "cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn("cut", F.ceil(F.greatest(
        F.sqrt(F.col("n") / BLOCK), F.col("n") * F.col("size") / CELL_NUMBERS)).cast("int"))
    crowded = dealt(visits.join(crowds, ["label", "size", "cell"]))

    def stars(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        counts = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = np.arange(len(ids))
        while len(a):  # each row takes the smallest row it is linked to, until nothing changes
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(counts > 0)
        return pd.DataFrame({"vec_id": ids[some], "links": counts[some].astype(np.int64), "root": ids[root[some]]})

    def compared(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, size, pivot, low, high = key
        group = group.sort_values("vec_id")
        lists = np.array(group.pivots.tolist(), int)
        x = np.array(group.vector.tolist(), float).reshape(len(group), size)
        a, b = links_in_blocks(pivot, lists, x, group.block.to_numpy(), (low, high), min(shared, lists.shape[1]), least)
        return stars(group.vec_id.to_numpy(), group.copies.to_numpy(), a, b)

    def in_cell(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, size, cell, low, high = key
        group = group.sort_values("vec_id")
        x = np.array(group.vector.tolist(), float).reshape(len(group), size)
        a, b = links_in_cell((group.home == cell).to_numpy(), x, group.block.to_numpy(), (low, high), least)
        return stars(group.vec_id.to_numpy(), group.copies.to_numpy(), a, b)

    shape = "vec_id long, links long, root long"
    found = scratch.keep(
        spread.groupBy("label", "size", "pivot", "low", "high").applyInPandas(compared, shape).union(
            crowded.groupBy("label", "size", "cell", "low", "high").applyInPandas(in_cell, shape)), "links")
    copies = able.select("label", "key", "vec_id").join(classes, ["label", "key"]).filter("vec_id != class_id")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).union(
        copies.select(F.col("vec_id").alias("a"), F.col("class_id").alias("b"))), scratch, "near")
    counted = classes.join(found.groupBy("vec_id").agg(F.sum("links").alias("links")),
                           F.col("class_id") == F.col("vec_id"), "left").select(
        "label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = all_.select("vec_id", "label", "key").withColumn("able", F.col("vec_id").isNotNull() & F.col("label").isNotNull()).join(
        counted, ["label", "key"], "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.when(F.col("able"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
