"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles; two link when their Jaccard similarity reaches
``percent``. All sets are ordered alike, rare shingles first. If two sets are similar
enough, the first ``n - ceil(t n) + l`` of each share at least ``l``; every document picks
the ``l`` for which its prefix is cheapest by the counts of its shingles. A pair must share
as many prefix shingles as its overlap needs beyond what lies behind the prefixes: the
longer the prefixes, the more.

Documents with equal sets are one class from the start. Classes that share a prefix
shingle are first compared with a few of them (stars, linear in the list's length), in
turns with others each time, which joins groups of near copies; when a turn's pairs hardly
link any more, all pairs of different components that share enough prefix shingles, and whose
sketches (parities of shingle classes) differ in no more bits than similar sets can, are
compared. So every link that could join two components is tried, and a large group of near
copies does not become all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Scratch, components, fresh, shingle_hashes, small_side, word_hashes, words

MOST_MATCHES = 4
#: Comparing two sets costs about as much as reading so many prefix entries.
COMPARE_COST = 20.0
CHUNK = 2_000_000
#: Entries of a list that all others are compared with in the first turn (twice as many in each next one), and turns
#: at most before all pairs left are.
PIVOTS = 4
MOST_TURNS = 6
#: Longs of a set's sketch.
SKETCH = 8


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(words(text)), size))


def set_key(found: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxh3_128_digest(found.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether two sorted sets without repeats are similar enough."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix_length(n: int, matches: int, percent: int) -> int:
    """Of any similar pair, so many first shingles share ``matches``."""
    return min(n, n + (-percent * n) // 100 + matches)


def shared_needed(n_a: int, n_b: int, length_a: int, length_b: int, percent: int) -> int:
    """So many of their prefixes' shingles two similar sets share.

    What they share besides lies behind the prefix of the one whose prefix ends first.
    """
    overlap = -(-percent * (n_a + n_b) // (100 + percent))
    return max(1, overlap - max(n_a - length_a, n_b - length_b))


def prefix(found: np.ndarray, common: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set, rare shingles first, and the number of matches it asks for.

    ``common`` are frequent shingles (sorted), ``levels`` the logarithms of their counts. A
    match number costs reading the prefix, and comparing as many candidates as the lists
    can give: their entries divided by the matches each candidate needs.
    """
    level = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hit = common[at] == found
        level[hit] = levels[at[hit]]
    order = np.lexsort((found, level))
    others = (2.0 ** level[order] - 1).cumsum()
    best, matches = np.inf, 1
    for m in range(1, MOST_MATCHES + 1):
        length = prefix_length(len(found), m, percent)
        cost = length + others[length - 1] * (1 + COMPARE_COST / m)
        if cost < best and length >= m:
            best, matches = cost, m
    return found[order[:prefix_length(len(found), matches, percent)]], matches


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """For each of ``SKETCH`` * 64 classes of shingles whether the set has an odd number of them, as longs.

    A shingle that only one of two sets has turns one bit, so sketches differ in at most as many bits as the sets in shingles.
    """
    odd = np.bincount((found % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SETS = "doc_id long, n long, k1 long, k2 long, sketch array<long>, token long, times long"


def _describe(size: int):
    """Per document its set's size and key; per chunk of documents the shingles that several sets have."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def shared():
            tokens, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            several = times > 1
            none = pa.nulls(int(several.sum()), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(len(none), pa.list_(pa.int64())), pa.array(tokens[several].view(np.int64)),
                 pa.array(times[several].astype(np.int64))], ["doc_id", "n", "k1", "k2", "sketch", "token", "times"])

        for part in parts:
            sizes, keys, sketches = [], [], []
            for text in _column(part, "text"):
                found = shingle_set(text, size)
                key = set_key(found)
                sizes.append(len(found))
                keys.append(key)
                sketches.append(parity_sketch(found))
                if key not in seen and len(found):
                    seen.add(key)
                    held.append(found)
                    total += len(found)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([k for k, _ in keys], pa.int64()),
                 pa.array([k for _, k in keys], pa.int64()), pa.array(sketches, pa.list_(pa.int64())), none, none],
                ["doc_id", "n", "k1", "k2", "sketch", "token", "times"])
            if total >= CHUNK:
                yield shared()
                held, total, seen = [], 0, set()
        yield shared()
    return run


#: ``meta``: set size and prefix length in one number, as millions of rows are moved.
POSTINGS = "token long, key long, meta long, hot boolean"
SIZE_OF, LENGTH_OF = "shiftright({}, 32)", "({} & 4294967295)"
SIZE_FITS = "100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _postings(size: int, percent: int, counts):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, levels = counts.value
        seen: set[tuple[int, int]] = set()
        for part in parts:
            tokens, keys, metas, hot = [], [], [], []
            for text in _column(part, "text"):
                found = shingle_set(text, size)
                if not len(found) or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                first, _ = prefix(found, common, levels, percent)
                tokens.append(first.view(np.int64))
                keys.append(np.full(len(first), key[0]))
                metas.append(np.full(len(first), (len(found) << 32) + len(first)))
                hot.append(common[np.minimum(np.searchsorted(common, first), len(common) - 1)] == first if len(common) else np.zeros(len(first), bool))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, metas, hot)], ["token", "key", "meta", "hot"])
    return run


def _frequent(described: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest counts, at most ``most``, sorted, and their counts' logarithms.

    Counts come from chunks of documents, over all documents; they are never above the
    truth. The bound on what goes to the driver and to every task is ``most``.
    """
    counted = described.filter("times is not null").groupBy("token").agg(F.sum("times").alias("n")).select(
        "token", F.floor(F.log2("n")).cast("int").alias("level"))
    sizes = sorted(counted.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level)
    least, total = 64, 0
    for r in sizes:
        total += r.n
        if total > most:
            break
        least = r.level
    found = counted.filter(F.col("level") >= least).toArrow()  # never as Python objects: a million of them fill a driver
    tokens = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["level"].to_numpy().astype(np.int8)[order]


def _own_text(size: int):
    """An id that several rows have brings all their texts: keep that of the class."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fits = [set_key(shingle_set(t, size)) == (k1, k2)
                    for t, k1, k2 in zip(*(_column(part, c) for c in ("text", "key", "k2")), strict=True)]
            yield part.filter(pa.array(fits, pa.bool_())).select(["class_id", "key", "text"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (keys ``a, b``) whose sets are similar enough, as ids of their classes ``a, b``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for part in parts:
            left, right = [], []
            for a, b, one, two in zip(*(_column(part, c) for c in ("a", "b", "one", "two")), strict=True):
                if b != last:
                    last, known = b, shingle_set(two, size)
                if linked(shingle_set(one, size), known, percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    ones = texts.select(F.col("key").alias("a"), F.col("class_id").alias("id_a"), F.col("text").alias("one"))
    twos = texts.select(F.col("key").alias("b"), F.col("class_id").alias("id_b"), F.col("text").alias("two"))
    both = pairs.join(ones, "a").join(twos, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "one", "two")
    return both.mapInArrow(run, "a long, b long")


def _needed(a: str, b: str, percent: int) -> str:
    """``shared_needed`` as SQL, of two ``meta`` columns."""
    n_a, n_b = SIZE_OF.format(a), SIZE_OF.format(b)
    behind = f"greatest({n_a} - {LENGTH_OF.format(a)}, {n_b} - {LENGTH_OF.format(b)})"
    overlap = f"({percent} * ({n_a} + {n_b}) + {99 + percent}) div {100 + percent}"
    return f"greatest(1, {overlap} - {behind})"


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (keys ``a, b``) whose prefixes share enough shingles."""
    one = prefixes.toDF("a", "meta_a", "tokens_a")
    two = prefixes.toDF("b", "meta_b", "tokens_b")
    return pairs.join(one, "a").join(two, "b").filter(
        F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.expr(_needed("meta_a", "meta_b", percent))).select("a", "b")


def _may_link(a: str, b: str, percent: int) -> str:
    """Whether a shingle at the ``rank`` it has in two prefixes can be the first that two similar sets share.

    Prefixes are ordered alike, by how many prefixes have a shingle. After the first shared
    shingle come all others that the two need.
    """
    needed = _needed(f"{a}.meta", f"{b}.meta", percent)
    return f"""{SIZE_FITS.format(a=SIZE_OF.format(f"{a}.meta"), b=SIZE_OF.format(f"{b}.meta"), percent=percent)}
        AND {a}.rank + {needed} <= {LENGTH_OF.format(f"{a}.meta")} AND {b}.rank + {needed} <= {LENGTH_OF.format(f"{b}.meta")}"""


def _near_enough(a: str, b: str, percent: int) -> str:
    """Whether the sketches differ in no more bits than two similar sets may in shingles."""
    both = f"({SIZE_OF.format(f'{a}.meta')} + {SIZE_OF.format(f'{b}.meta')})"
    bits = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(SKETCH))
    return f"{bits} <= {both} - 2 * (({percent} * {both} + {99 + percent}) div {100 + percent})"


def _stars(ranked: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs ``a < b`` of keys of different components: of each shingle's list all entries with a few, others each turn."""
    few = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("key", F.lit(turn))))
    pivots = ranked.withColumn("no", few).filter(f"no <= {PIVOTS << turn}").drop("no")
    return _pairs(ranked, pivots, "a.key <> b.key", percent)


def _pairs(one: DataFrame, two: DataFrame, test: str, percent: int) -> DataFrame:
    a, b = one.alias("a"), two.alias("b")
    return a.join(b, F.expr(f"a.token = b.token AND {test} AND a.component <> b.component AND {_may_link('a', 'b', percent)}")).select(
        F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, most_frequent: int = 1 << 20,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links. Null and empty texts have no
    shingles and link with nothing; fewer than ``size`` words are one shingle. Rows with a
    null id link with nothing and get a null component. Rows with the same id are one
    node: links of either join it. Other columns are not read; an empty table gives no rows.
    ``most_frequent`` bounds the table of frequent shingles that every task holds (12 bytes
    each); the rest count as equally rare, which changes cost, not results.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = scratch.keep(texts.mapInArrow(_describe(size), SETS), "sets")
    sets = described.filter("times is null").select("doc_id", "n", "k1", "k2")
    classes = scratch.keep(
        sets.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")), "classes")

    counts = scratch.spark.sparkContext.broadcast(_frequent(described, most_frequent))
    found = texts.filter("doc_id is not null").mapInArrow(_postings(size, percent, counts), POSTINGS)
    # A frequent shingle's list is counted in parts, then the parts' counts; the many others have lists short enough to be counted whole.
    parted = Window.partitionBy("token", "part")
    counted = scratch.keep(
        found.withColumn("part", F.when(F.col("hot"), F.pmod("key", F.lit(256)) + 1).otherwise(0)).select(
            "token", "key", "meta", "part", F.min("key").over(parted).alias("first"), F.max("key").over(parted).alias("last"),
            F.count("*").over(parted).alias("lists")).filter("part > 0 or first < last"), "counted")
    frequent = counted.filter("part > 0").select("token", "key", "meta")
    totals = frequent.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("lists"))
    shared = counted.filter("part = 0").drop("part").unionByName(frequent.join(totals, "token")).filter("first < last").select(
        "token", "key", "meta", "lists").distinct()
    prefixes = scratch.keep(
        shared.groupBy("key").agg(F.min("meta").alias("meta"), F.array_sort(F.collect_list(F.struct("lists", "token"))).alias("t"))
        .select("key", "meta", F.col("t.token").alias("tokens")), "prefixes")
    scratch.drop("counted")
    counts.destroy()
    # Shingles that no other prefix has come before the shared ones.
    ranked = prefixes.select(
        "key", "meta", F.expr(f"{LENGTH_OF.format('meta')} - size(tokens)").alias("alone"), F.posexplode("tokens").alias("place", "token"))
    ranked = ranked.select("token", "key", "meta", (F.col("alone") + F.col("place")).alias("rank"))

    def compared(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The pairs that were compared, and those of them that link."""
        pairs = scratch.keep(_promising(pairs, prefixes, percent), f"{name}_pairs")
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = scratch.keep(classes.join(keys, classes.k1 == keys.key).select("class_id", "key", "k2"), f"{name}_keys")
        own = scratch.keep(
            texts.join(small_side(wanted, 1_000_000), texts.doc_id == wanted.class_id).select("class_id", "key", "k2", "text")
            .mapInArrow(_own_text(size), "class_id long, key long, text string").dropDuplicates(["class_id", "key"]), f"{name}_texts")
        links = scratch.keep(_verified(pairs, own, size, percent), f"{name}_links")
        scratch.drop(f"{name}_texts")
        return pairs, links

    # The graph is contracted as it grows: a turn's links join components of the turns before.
    of_class = scratch.keep(classes.select(F.col("k1").alias("key"), "class_id").join(prefixes.select("key"), "key").withColumn(
        "component", F.col("class_id")), "classes0")
    open_ = ranked.withColumn("component", F.col("key"))
    tried = None

    def joined(found: DataFrame, turn: int) -> DataFrame:
        side = {c: of_class.select(F.col("class_id").alias(c), F.col("component").alias(f"{c}_in")).distinct() for c in ("a", "b")}
        ends = found.join(side["a"], "a").join(side["b"], "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).filter("a != b").distinct()
        groups = components(ends, scratch, f"near{turn}_").toDF("component", "into")
        return scratch.keep(of_class.join(groups, "component", "left").select(
            "key", "class_id", F.coalesce("into", "component").alias("component")), f"classes{turn + 1}")

    for turn in range(MOST_TURNS):
        pairs = _stars(open_, turn, percent)
        pairs = pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs
        pairs, found = compared(pairs, f"star{turn}")
        tried = tried.union(pairs) if tried else pairs
        of_class = joined(found, turn)
        scratch.drop(f"classes{turn}")
        of_key = of_class.groupBy("key").agg(F.min("component").alias("component"))
        rows = scratch.keep((open_.drop("component") if turn else ranked).join(of_key, "key"), f"rows{turn}")
        ends = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        open_ = scratch.keep(rows.join(ends.select("token"), "token", "left_semi"), f"open{turn}")
        scratch.drop(f"rows{turn}", f"open{turn - 1}")
        if 10 * found.count() <= pairs.count():
            break
    # Near copies of one text that do not link share most prefix shingles: their sketches tell them apart before they are a pair.
    sketches = described.filter("n > 0").select(F.col("k1").alias("key"), "sketch").distinct()
    last = scratch.keep(open_.join(sketches, "key"), "last")
    rest = _pairs(last, last, f"a.key < b.key AND {_near_enough('a', 'b', percent)}", percent).join(tried, ["a", "b"], "left_anti")
    of_class = joined(compared(rest, "rest")[1], MOST_TURNS)
    links = of_class.filter("class_id != component").select(F.col("class_id").alias("a"), F.col("component").alias("b"))

    copies = sets.filter("n > 0 and doc_id is not null").join(classes, ["k1", "k2"]).filter("doc_id != class_id").select(
        F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    groups = components(links.union(copies), scratch, "all")
    scratch.drop("prefixes", *(f"open{turn}" for turn in range(MOST_TURNS)))
    return sets.join(groups, sets.doc_id == groups.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose id is the smallest of its component.

    Rows with a null id stay. Equal rows of one id become one; different texts under one id
    are one document and stay together.
    """
    found = jaccard_components(docs, id_col=id_col, **options)
    name = fresh(docs, "_component")
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = small_side(Scratch(docs.sparkSession, "copies").keep(gone, "gone"), 1_000_000)
    kept = docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
    name = fresh(kept, "_repeated")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(name))
    repeated = Scratch(docs.sparkSession, "copies").keep(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    same = kept[id_col].cast("long") == F.col(name)
    again = kept.join(repeated, same, "left_semi")
    # Maps cannot be compared, their text can.
    written = {fresh(kept, f"_{i}_text"): F.to_json(F.struct(c)) for i, (c, kind) in enumerate(again.dtypes) if "map<" in kind or kind == "variant"}
    plain = [c for c, kind in again.dtypes if "map<" not in kind and kind != "variant"]
    once = again.withColumns(written).dropDuplicates([*plain, *written]).select(*kept.columns)
    return kept.join(repeated, same, "left_anti").unionByName(once)
