"""Line dedup by pairwise alignment: overlapping documents are aligned line by line, common blocks leave the later one.

Only lines in a run of repeated lines with ``min_words`` words or more can be part of a
common block. Pairs of documents come from such lines: a rare line pairs all documents
that have it, any line pairs its later documents with its earliest (so a line that a third
of the corpus has costs one pair per document). The shortest runs of lines that reach
``min_words`` pair likewise, so a block finds its earliest owner also where each of its
lines has an earlier one. Pairs are aligned by patience diff: lines that both documents
have once, in the longest order they share, then the gaps between; a gap without such
lines by its longest common subsequence.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, fresh, small_side, words


def line_hash(line: str) -> tuple[int, int]:
    """A signed hash of the line's lower-cased words, and how many they are."""
    found = words(line)
    h = xxh3_64_intdigest(b" ".join(found))
    return h - (1 << 64) if h >= 1 << 63 else h, len(found)


def repeated_runs(repeated: list[bool], sizes: list[int], min_words: int) -> list[int]:
    """Places of the lines in runs of repeated lines with at least ``min_words`` words. Blank lines end no run."""
    out, run, total = [], [], 0
    for i, (r, n) in enumerate(zip([*repeated, False], [*sizes, 1], strict=True)):
        if r or not n:
            run.append(i)
            total += n
        else:
            if total >= min_words:
                out += run
            run, total = [], 0
    return out


def shortest_runs(able: list[int], hashes: list[int], sizes: list[int], min_words: int) -> list[int]:
    """Hashes of the shortest runs of lines that reach ``min_words``, from every line on and up to every line.

    Each common block of so many words is covered by such runs. Blank lines neither begin nor end one.
    """
    def ends(places: list[int], step: int) -> list[tuple[int, int]]:
        out, total, at = [], 0, 0
        for i in places:
            while at < len(places) and total < min_words:
                total += sizes[places[at]]
                at += 1
            if total < min_words:
                break
            if sizes[i]:
                out.append((i, places[at - 1])[::step])
            total -= sizes[i]
        return out

    found, parts = set(), []
    for i in able:
        if parts and parts[-1][-1] == i - 1:
            parts[-1].append(i)
        else:
            parts.append([i])
    for part in parts:
        for lo, hi in {*ends(part, 1), *ends(part[::-1], -1)}:
            h = xxh3_64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in hashes[lo:hi + 1]))
            found.add(h - (1 << 64) if h >= 1 << 63 else h)
    return sorted(found)


def _subsequence(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence, a row of its table being the bits of one number."""
    both = set(a[lo_a:hi_a]) & set(b[lo_b:hi_b])
    rows, columns = ([i for i in range(lo, hi) if x[i] in both] for x, lo, hi in ((a, lo_a, hi_a), (b, lo_b, hi_b)))
    at: dict[int, int] = {}
    for k, j in enumerate(columns):
        at[b[j]] = at.get(b[j], 0) | 1 << k
    full = (1 << len(columns)) - 1
    now, table = full, []
    for i in rows:
        match = now & at[a[i]]
        now = ((now + match) | (now - match)) & full
        table.append(now)
    out, i, j = [], len(rows), len(columns)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((rows[i], columns[j]))
    return out


def _anchors(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Lines that each side has once, in the longest order that both share."""
    count_a, count_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    at_b = {h: j for j, h in enumerate(b[lo_b:hi_b], lo_b) if count_b[h] == 1}
    both = [(i, at_b[h]) for i, h in enumerate(a[lo_a:hi_a], lo_a) if count_a[h] == 1 and h in at_b]
    tails, ends, back = [], [], []
    for k, (_, j) in enumerate(both):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        tails[at:at + 1] = [j]
        ends[at:at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two lists of line hashes, by patience diff."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        found = _anchors(a, b, lo_a, hi_a, lo_b, hi_b) if lo_a < hi_a and lo_b < hi_b else []
        for i, j in found:
            todo.append((lo_a, i, lo_b, j))
            out.append((i, j))
            lo_a, lo_b = i + 1, j + 1
        if found:
            todo.append((lo_a, hi_a, lo_b, hi_b))
        elif lo_a < hi_a and lo_b < hi_b:
            out += _subsequence(a, b, lo_a, hi_a, lo_b, hi_b)
    return sorted(out)


def common_lines(a: list[int], b: list[int], sizes: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of aligned blocks (lines that follow each other in both) of at least ``min_words`` words."""
    out, block, total, last = [], [], 0, (-2, -2)
    for i, j in [*align(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if total >= min_words:
                out += block
            block, total = [], 0
        if j >= 0:
            block.append(j)
            total += sizes[j]
        last = (i, j)
    return out


def _lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids, marks, places, hashes, sizes, first = [], [], [], [], [], []
        for doc_id, mark, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
            seen = set()
            for place, line in enumerate(text.split("\n")):
                h, n = line_hash(line)
                ids.append(doc_id)
                marks.append(mark)
                places.append(place)
                hashes.append(h)
                sizes.append(n)
                first.append(int(n > 0 and h not in seen))
                seen.add(h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(hashes, pa.int64()),
             pa.array(sizes, pa.int32()), pa.array(first, pa.int32())], ["doc_id", "mark", "place", "line", "n", "first"])


def _sequences(min_words: int):
    """A document's lines in order, and those that can be part of a common block with their owners."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc_id, found in zip(part.column("doc_id").to_pylist(), part.column("lines").to_pylist(), strict=True):
                mark = min(x["mark"] for x in found)
                lines = [x for _, x in sorted({x["place"]: x for x in found if x["mark"] == mark}.items())]
                able = repeated_runs([x["owner"] is not None for x in lines], [x["n"] for x in lines], min_words)
                if able:
                    asked = {lines[i]["line"]: lines[i] for i in able if lines[i]["owner"] is not None}
                    rows.append((doc_id, mark, [x["line"] for x in lines], [x["n"] for x in lines],
                                 [{"line": x["line"], "owner": x["owner"], "docs": x["docs"]} for x in asked.values()],
                                 shortest_runs(able, [x["line"] for x in lines], [x["n"] for x in lines], min_words)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(SEQUENCE.names, r, strict=True)) for r in rows], schema=SEQUENCE)
    return run


SEQUENCE = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
    ("able", pa.list_(pa.struct([("line", pa.int64()), ("owner", pa.int64()), ("docs", pa.int64())]))),
    ("runs", pa.list_(pa.int64()))])


def repeated_lines(docs: DataFrame, min_words: int = 30, rare: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, places``: lines (counted from 0) of each document that repeat a block of an earlier one.

    Earlier means a smaller id. ``mark`` is the hash of the text that the places belong to.
    Null ids and null texts take no part. Of rows with one id but different texts that with
    the least hash takes part; equal rows count once. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"),
                        F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    lines = scratch.keep(texts.mapInArrow(_lines, "doc_id long, mark long, place int, line long, n int, first int"), "lines")
    owners = (
        lines.filter("n > 0").groupBy("line")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.sum("first").alias("docs"))
        .filter("owner < last").drop("last"))
    sequences = scratch.keep(
        lines.join(owners, "line", "left")
        .groupBy("doc_id").agg(F.collect_list(F.struct("mark", "place", "line", "n", "owner", "docs")).alias("lines"))
        .mapInArrow(_sequences(min_words), "doc_id long, mark long, lines array<long>, sizes array<int>, "
                    "able array<struct<line:long,owner:long,docs:long>>, runs array<long>"), "sequences")
    able = sequences.select("doc_id", F.inline("able"))
    few = able.filter(F.col("docs") <= rare).select("line", "doc_id")
    runs = sequences.select("doc_id", F.explode("runs").alias("run"))
    earliest = runs.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).filter("a < last").drop("last")
    pairs = (
        able.filter("owner < doc_id").select(F.col("owner").alias("a"), F.col("doc_id").alias("b"))
        .union(few.toDF("line", "a").join(few.toDF("line", "b"), "line").filter("a < b").select("a", "b"))
        .union(runs.join(earliest, "run").filter("a < doc_id").select("a", F.col("doc_id").alias("b"))).distinct())

    def aligned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(doc_id, mark, common_lines(a, b, sizes, min_words)) for doc_id, mark, a, b, sizes in zip(
                *(part.column(c).to_pylist() for c in ("b", "mark", "lines_a", "lines_b", "sizes")), strict=True)]
            found = [x for x in found if x[2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                 pa.array([x[2] for x in found], pa.list_(pa.int32()))], ["doc_id", "mark", "places"])

    later = sequences.select(F.col("doc_id").alias("b"), "mark", F.col("lines").alias("lines_b"), "sizes")
    earlier = sequences.select(F.col("doc_id").alias("a"), F.col("lines").alias("lines_a"))
    found = pairs.join(later, "b").join(earlier, "a").select("b", "mark", "lines_a", "lines_b", "sizes").mapInArrow(
        aligned, "doc_id long, mark long, places array<int>")
    return scratch.keep(
        found.select("doc_id", "mark", F.explode("places").alias("place")).distinct()
        .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("place")).alias("places")), "places")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, with their columns, without the lines that repeat earlier documents.

    A document of which no words are left goes; all other rows stay, null texts too.
    """
    found = repeated_lines(docs, id_col=id_col, text_col=text_col, **options)
    one, two, three = (fresh(docs, f"_{c}") for c in ("doc", "mark", "places"))
    found = small_side(found.toDF(one, two, three))
    text = F.col(text_col)
    both = docs.join(found, (docs[id_col].cast("long") == found[one]) & (F.xxhash64(docs[text_col]) == found[two]), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.col(three), i)), "\n")
    changed = both.withColumn(text_col, F.when(F.col(three).isNull(), text).otherwise(left))
    return changed.filter(F.col(three).isNull() | text.rlike(r"[^\s]")).select(*(F.col(f"`{c}`") for c in docs.columns))
