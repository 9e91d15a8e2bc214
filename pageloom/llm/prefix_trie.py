"""A trie of shared conversation beginnings, built by van Emde Boas recursion.

Turns are named by a digest; a node is named by its depth and the smallest conversation
through it. A block of ``2^k`` depths below a node holds items: what is left of
conversations there. A round cuts all blocks of one size at half depth, wherever they are:

* the first halves of a block are grouped by a fingerprint of their turns, and each
  distinct one gets its name and the number of conversations it stands for;
* the upper trie is built, in the next round, from one item for each name;
* second halves are items of the lower forest below that name.

Items of one turn are the nodes. As every item leads from the root of its block, items
that fill a block also are links over ``2^k`` depths. Totals are grafted along these:
upwards, sums below a node at a multiple of ``2^k`` reach ever further; downwards, the
nodes half way between get the whole sums of those below. Both together touch every node a
bounded number of times, in as many rounds as the depth has bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_rank
from .common import Scratch

#: Turns in one row of an item.
BLOCK = 64
_ITEM = ["low", "root", "conv"]
_COLUMNS = [*_ITEM, "block", "turns", "length", "convs", "ends", "level"]


def _turns(talks: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, name, size``: the name is a digest of role and text, the size the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = talks.filter(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), name.alias("name"), F.length(text).cast("long").alias("size"))


def own_turns(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, name, size``: turns in order from place 1, null turn first, ties by digest.

    Places come from a range-partitioned sort, so a conversation may have any number of turns.
    """
    rows = _turns(talks, conv_col, turn_col, role_col, text_col)
    return with_rank(rows, ["conv"], ["turn", "name"]).select("conv", (F.col("rank") + 1).alias("pos"), "name", "size")


def graft_openings(own: DataFrame, scratch: Scratch, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(turns, convs)`` after each conversation got the first turns of the first of its hundred.

    ``h = crc32(id) mod (most + 1)`` turns come from conversation ``id - id % group`` (as many as it has),
    those from place ``h + 1`` on are its own. ``convs`` has ``conv, length``, also of those left without turns.
    """
    own = scratch.keep(own, "own")
    donor = F.col("conv") - F.col("conv") % group
    heads = own.filter((F.col("conv") == donor) & (F.col("pos") <= most)).groupBy(F.col("conv").alias("donor")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "size"))).alias("head"))
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).withColumns(
        {"donor": donor, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)})
    convs = convs.join(heads, "donor", "left").withColumn("given", F.expr("slice(coalesce(head, array()), 1, cast(h as int))"))
    convs = scratch.keep(convs.select("conv", "h", "given", (F.size("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    first = convs.select("conv", F.explode("given").alias("t")).select("conv", "t.pos", "t.name", "t.size")
    rest = own.join(convs.select("conv", "h", F.size("given").alias("given")), "conv").filter("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "name", "size")
    return first.unionByName(rest), convs.select("conv", F.col("length").cast("long").alias("length"))


def _bits(n: Column) -> Column:
    """The number of bits of a whole number; 0 has none."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def _fingerprint(turns: Column | str, block: Column) -> list[Column]:
    """Two 64-bit numbers of turns and their place, to be combined by exclusive or."""
    names = F.transform(turns, lambda t: t["name"])
    return [F.xxhash64(F.lit(seed), block, names).alias(f"f{seed}") for seed in (1, 2)]


def _items(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Whole conversations as items of the block below the root, in rows of at most ``BLOCK`` turns."""
    block = F.expr(f"(pos - 1) div {BLOCK}")
    rows = turns.groupBy("conv", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "size"))).alias("turns"))
    rows = rows.join(convs, "conv").withColumn("turns", F.transform("turns", lambda t: F.struct(t["name"], t["size"])))
    return rows.select(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("root"), "conv", "block", "turns", "length",
                       F.lit(1).cast("long").alias("convs"), F.lit(True).alias("ends"), _bits(F.col("length")).alias("level"))


def _cut(items: DataFrame, level: int) -> DataFrame:
    """One round over the items of a level: items of the upper tries and lower forests, and, with level -1, conversations that end at a cut."""
    half = 1 << (level - 1)
    one_row = half < BLOCK
    if one_row:
        heads = items = items.select("*", *_fingerprint(F.slice("turns", 1, half), F.lit(0).cast("long")))
    else:
        heads = items.filter(F.col("block") < half // BLOCK).select(*_ITEM, "convs", *_fingerprint("turns", F.col("block"))).groupBy(*_ITEM).agg(
            F.max("convs").alias("convs"), F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"))
        items = items.join(heads.drop("convs"), _ITEM)
    names = heads.groupBy("low", "root", "f1", "f2").agg(F.min("conv").alias("name"), F.sum("convs").alias("through"))
    named = items.join(names, ["low", "root", "f1", "f2"])

    long, no = F.lit(0).cast("long"), F.lit(False)
    blocks = 0 if one_row else half // BLOCK
    front = F.slice("turns", 1, half) if one_row else F.col("turns")
    back = F.slice("turns", half + 1, BLOCK) if one_row else F.col("turns")
    left = F.col("length") - half

    def item(when: Column, low, root, block, turns, length, convs, ends, level) -> Column:
        given = zip((low, root, F.col("conv"), block, turns, length, convs, ends, level), _COLUMNS, strict=True)
        return F.when(when, F.struct(*(c.alias(n) for c, n in given)))

    upper = item((F.col("conv") == F.col("name")) & (one_row | (F.col("block") < blocks)),
                 F.col("low"), F.col("root"), F.col("block"), front, long + half, F.col("through"), no, F.lit(level - 1))
    lower = item((left > 0) & (F.col("block") >= blocks), F.col("low") + half, F.col("name"), F.col("block") - blocks, back, left,
                 F.col("convs"), F.col("ends"), F.least(_bits(left), F.lit(level - 1)))
    ended = item(F.col("ends") & (left == 0) & (F.col("block") == 0), F.col("low") + half, F.col("name"), long, F.slice("turns", 1, 0), long,
                 long, no, F.lit(-1))
    return named.select(F.explode(F.array_compact(F.array(upper, lower, ended))).alias("item")).select("item.*")


def _digest_ends(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """``depth, name, ends_sha256``: of the comma-joined conversations that end at a node, in ascending order.

    Ids are sorted over all tasks and joined to texts of at most ``chunk`` ids there; a node's
    texts are then hashed one after the other as they are read, so no list of ids is ever held.
    """
    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, rows = None, [], []

        def flush() -> None:
            if held:
                rows.append((*node, held[0], ",".join(map(str, held))))

        for part in parts:
            for depth, name, conv in zip(*(part.column(c).to_pylist() for c in ("depth", "name", "conv")), strict=True):
                if (depth, name) != node or len(held) == chunk:
                    flush()
                    node, held = (depth, name), []
                held.append(conv)
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True))), names=["depth", "name", "first", "text"])
                rows = []
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True))), names=["depth", "name", "first", "text"])

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, rows = None, None, []
        for part in parts:
            for depth, name, text in zip(*(part.column(c).to_pylist() for c in ("depth", "name", "text")), strict=True):
                if (depth, name) == node:
                    digest.update(f",{text}".encode())
                    continue
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (depth, name), hashlib.sha256(text.encode())
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True))), names=["depth", "name", "ends_sha256"])
                rows = []
        if node:
            rows.append((*node, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True))), names=["depth", "name", "ends_sha256"])

    order = ["depth", "name"]
    joined = ends.repartitionByRange(*order, "conv").sortWithinPartitions(*order, "conv").mapInArrow(texts, "depth long, name long, first long, text string")
    return joined.repartition(*order).sortWithinPartitions(*order, "first").mapInArrow(digests, "depth long, name long, ends_sha256 string")


_SUMS = ["leaves", "saved"]


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "name").agg(*(F.sum(c).alias(c) for c in _SUMS))


def _handed(rows: DataFrame, links: DataFrame, span: int) -> DataFrame:
    """Sums of ``rows`` at the nodes that lie ``span`` above them."""
    return rows.join(links, ["depth", "name"]).select((F.col("depth") - span).alias("depth"), F.col("root").alias("name"), *_SUMS)


def _totals(nodes: DataFrame, links: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``depth, name, leaves, saved``: sums over all that is below a node; nodes with nothing below have no row."""
    below = [scratch.keep(_added(nodes.select((F.col("depth") - 1).alias("depth"), F.col("root").alias("name"), *_SUMS)), "below0")]
    for k in range(len(links)):  # sums over 2^k depths below the nodes at multiples of 2^k
        far = F.col("depth") % (2 << k) == 0
        below.append(scratch.keep(_added(below[k].filter(far).unionByName(_handed(below[k].filter(~far), links[k], 1 << k))), f"below{k + 1}"))
    whole = below[-1]
    for k in reversed(range(len(links))):  # of nodes half way, all that is below: what is near, and all below the next known ones
        known = whole.filter(F.col("depth") >= (2 << k))
        found = _added(below[k].filter(F.col("depth") % (2 << k) == 1 << k).unionByName(_handed(known, links[k], 1 << k)))
        whole = scratch.keep(whole.unionByName(found), f"whole{k}")
    return whole


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node.

    ``turns``: ``conv, pos, name, size`` with places from 1 without gaps; ``convs``: ``conv, length`` for every
    conversation, also those without turns. The root, depth 0, has no parent. No conversations: no rows.
    """
    items = scratch.keep(_items(turns, convs), "items", "level")
    depth, least, count = convs.agg(F.max("length"), F.min("conv"), F.count("*")).first()
    top = (depth or 0).bit_length()
    tables, links = [items], []
    for level in range(top, 0, -1):
        now = _union([t.filter(F.col("level") == level) for t in tables])
        tables.append(scratch.keep(_cut(now, level), f"items{level}", "level"))
    ends = [convs.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv")]
    ends += [t.filter("level = -1").select(F.col("low").alias("depth"), F.col("root").alias("name"), "conv") for t in tables[1:]]
    for k in range(top):  # items that fill a block of 2^k; of several rows each the first
        full = _union([t.filter((F.col("level") == k) & (F.col("length") == 1 << k) & (F.col("block") == 0)) for t in tables[1:]])
        links.append(full.select((F.col("low") + (1 << k)).alias("depth"), F.col("conv").alias("name"), "root"))

    nodes = convs.limit(0).select(*(F.lit(0).cast("long").alias(c) for c in ("depth", "name", "root", "n_convs", "size")))
    if top:
        nodes = _union([t.filter("level = 0") for t in tables[1:]]).select(
            (F.col("low") + 1).alias("depth"), F.col("conv").alias("name"), "root", F.col("convs").alias("n_convs"), F.col("turns")[0]["size"].alias("size"))
    root = convs.limit(1).select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(None).cast("long").alias("root"),
                                 F.lit(count).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("root").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.unionByName(root).join(children, ["depth", "name"], "left").withColumns({
        "leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}), "nodes")

    below = _totals(nodes.filter("depth > 0"), links, scratch).select("depth", "name", *(F.col(c).alias(f"{c}_below") for c in _SUMS))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(below, ["depth", "name"], "left").join(_digest_ends(_union(ends)), ["depth", "name"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("depth") == 0, F.lit(least).cast("long")).otherwise(F.col("name")).alias("conv_id"), "depth",
        F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("root")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), (F.col("leaves") + F.coalesce("leaves_below", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def conversation_trie(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      group: int = 100, most: int = 5) -> DataFrame:
    """The trie of all conversations after their openings were grafted (see ``graft_openings``).

    Null role or text counts as empty, a null turn comes first, turns that tie are ordered by a
    digest of role and text, so repeated rows are turns of their own. Rows without a conversation id belong to none and
    are left out. An empty table gives no rows. Other columns may have any name.
    """
    scratch = Scratch(talks.sparkSession, "trie")
    turns, convs = graft_openings(own_turns(talks, conv_col, turn_col, role_col, text_col), scratch, group, most)
    return prefix_trie(turns, convs, scratch)
