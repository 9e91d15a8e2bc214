"""Packing documents into sequences by lexical retrieval.

Every document becomes token ids with an end id. Full sequences are cut off its front;
what is left, a tail shorter than a sequence, is packed with tails that are like it.

Tails are sorted by the least hashes of their words, so that like ones lie close, and
range-partitioned, so that no group of copies is in one task. Each task goes through its
tails in order and cuts them into shards of ``shard_tails``, each with an inverted index
whose postings hold BM25 weights. The next unused tail is a seed: the index returns the
unused tails by falling score, and the best that still fits is taken, until none fits;
then the best of all is cut to fill the window, and its rest seeds the next one. What a
shard leaves open goes on to the next; the task's last window is cut into powers of two.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mixed

#: What byte-level vocabularies part texts at, and the same without looking ahead: of a run of blanks before
#: other characters, the last blank starts a part of its own, so texts are cut there first.
_PARTS = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_BLANKS = "\t-\r \x85\xa0"

_PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_TOKEN = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, near long, next long, tail long, tail_ids binary"
_TOKENS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("near", pa.int64()), ("next", pa.int64()), ("tail", pa.int64()), ("tail_ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Vocabulary:
    """Ids of texts by the vocabulary file ``path`` of the tokenizers library, and which ids begin a word."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, shown = given["model"], _shown_bytes()
        try:
            tokens = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items()}
        except KeyError:
            tokens = {}
        special = [t["content"] for t in given.get("added_tokens") or ()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.begins = np.ones(1 + max(model["vocab"].values(), default=0), bool)
        for t, i in model["vocab"].items():
            self.begins[i] = not (t[:1].isalnum() and ord(t[0]) < 128 or ord(t[0]) >= 0xA1 and t[0] not in "ĠĊĉ")
        self.fast = self._merges_in_order(given, tokens) and self._encoding({t: i for t, i in tokens.items() if t.decode("latin-1") not in special})
        self.cut = re.compile(f"(?<=[{_BLANKS}])(?=[{_BLANKS}][^{_BLANKS}])")
        self.plain = re.compile("[\x00-\x1b\x20-\x7e\xa0-\xffŒœŸ–—‘-„…€]*")

    @staticmethod
    def _merges_in_order(given: dict, tokens: dict[bytes, int]) -> bool:
        """Whether it is a plain byte-level vocabulary in which earlier merges have lower ids."""
        before, model = given.get("pre_tokenizer") or {}, given["model"]
        joined = [m if isinstance(m, str) else "".join(m) for m in model.get("merges") or ()]
        ids = [model["vocab"].get(m.replace(" ", ""), -1) for m in joined]
        return bool(tokens) and model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") \
            and before.get("use_regex", True) and not given.get("normalizer") and ids == sorted(ids) and min(ids, default=-1) >= 256

    @staticmethod
    def _encoding(ranks: dict[bytes, int]):
        import tiktoken

        return tiktoken.Encoding("vocabulary", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text. Texts of plain western letters take the short way, with equal ids; others the library's own."""
        if self.fast and self.plain.fullmatch(text) and not (self.special and self.special.search(text)):
            parts = self.cut.split(text)
            found = self.fast.encode_ordinary(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.fast.encode_ordinary(p)]
        else:
            found = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(found, np.uint32)

    def words(self, ids: np.ndarray) -> np.ndarray:
        """A hash for each word: a run of ids from one that begins a word to the next."""
        if not len(ids):
            return np.empty(0, np.uint64)
        begin = self.begins[np.minimum(ids, len(self.begins) - 1)].copy()
        begin[0] = True
        first = np.flatnonzero(begin)
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        return np.add.reduceat(mixed(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), first)


def _shown_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary at ``path`` (none: the 50,257 byte-level ids), read once per Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    # This module is sent by value, anew for each task, so what a worker keeps is held by a module that is installed there.
    import tokenizers

    held = tokenizers.__dict__.setdefault("_pageloom_vocabularies", {})
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _batches(schema: pa.Schema, rows: Iterator[tuple], most: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _rows(schema, held)
            held = []
    if held:
        yield _rows(schema, held)


def _tokenize(path: str | None, width: int, end: int):
    """Full sequences of every document, and its tail with two sort keys: the least hashes of its words."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        voc, no = vocabulary(path), TaskContext.get().partitionId() << 36
        for part in parts:
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(voc.ids(text), np.uint32(end)).astype("<u4")
                cut = len(ids) // width * width
                for start in range(0, cut, width):
                    no += 1
                    yield doc, start, ids[start:start + width].tobytes(), len(ids), 2 * no, None, None, None, None
                if cut < len(ids):
                    no += 1
                    found = voc.words(ids[cut:])
                    yield (doc, cut, None, len(ids), None, int(mixed(found).min().view(np.int64)),
                           int(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).min().view(np.int64)), no, ids[cut:].tobytes())

    def tokenize(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_TOKENS, rows(parts))
    return tokenize


class Index:
    """An inverted index over a shard: postings of BM25 weights by term, and the terms of each entry.

    Terms of half the entries or more weigh nothing, those of one entry find nothing: neither has postings.
    """

    def __init__(self, words: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        self.n = len(words)
        entry = np.repeat(np.arange(self.n), [len(w) for w in words])
        both = np.concatenate(words) if words else np.empty(0, np.uint64)
        terms, term = np.unique(both, return_inverse=True)
        cell, tf = np.unique(entry * max(len(terms), 1) + term, return_counts=True)
        entry, term = np.divmod(cell, max(len(terms), 1))
        length = np.array([len(w) for w in words], float)
        df = np.bincount(term, minlength=len(terms))
        idf = np.maximum(0, np.log((self.n - df + 0.5) / (df + 0.5)))
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[entry] / max(length.mean(), 1e-9))) if self.n else tf
        some = (df[term] > 1) & (idf[term] > 0)
        entry, term, weight = entry[some], term[some], weight[some]
        self.entry_terms, self.entry_at = term, np.searchsorted(entry, np.arange(self.n + 1))
        by_term = np.argsort(term, kind="stable")
        self.entries, self.weights = entry[by_term], weight[by_term]
        self.term_at = np.searchsorted(term[by_term], np.arange(len(terms) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every entry for the terms of entry ``seed``."""
        terms = self.entry_terms[self.entry_at[seed]:self.entry_at[seed + 1]]
        low, high = self.term_at[terms], self.term_at[terms + 1]
        size = high - low
        at = np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())
        return np.bincount(self.entries[at], self.weights[at], self.n)


def _pack_shard(tails: list[tuple], words: list[np.ndarray], width: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows of ``(tail, start, length)`` that are full, and what is left over.

    ``tails``: ``(start, length)`` each. With ``last``, the window left open is among the windows too.
    """
    index = Index(words)
    start, left = (np.array([t[i] for t in tails], np.int64) for i in (0, 1))
    windows: list[list[tuple]] = []
    first, cut = 0, -1
    while True:
        while first < len(tails) and not left[first]:
            first += 1
        if first == len(tails):
            return windows, []
        now = first if cut < 0 else cut  # the rest of what was cut seeds the next window
        window, room, scores = [], width, index.scores(now)
        while True:
            take = min(room, int(left[now]))
            window.append((now, int(start[now]), take))
            start[now] += take
            left[now] -= take
            room -= take
            if not room:
                break
            fits = (left > 0) & (left <= room)
            able = fits if fits.any() else left > 0
            if not able.any():
                return (windows + [window], []) if last else (windows, window)
            now = int(np.argmax(np.where(able, scores, -1.0)))
        windows.append(window)
        cut = now if left[now] else -1


def _pack(path: str | None, width: int, shard_tails: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        voc, no = vocabulary(path), TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens

        def pieces(window: list[tuple]) -> Iterator[tuple]:
            """A window as pieces; one that is not full is cut into sequences of powers of two."""
            nonlocal no
            size = sum(p[2] for p in window)
            room, offset = 0, 0
            for at, start, length in window:
                doc, first, ids, total = held[at]
                while length:
                    if not room:
                        no += 1
                        room, offset = width if size >= width else 1 << (size.bit_length() - 1), 0
                        size -= room
                    take = min(room, length)
                    yield doc, start, ids[start - first:start - first + take].tobytes(), total, 2 * no + 1, offset
                    start, length, room, offset = start + take, length - take, room - take, offset + take

        def shard(last: bool) -> Iterator[tuple]:
            nonlocal held
            windows, open_ = _pack_shard([(h[1], len(h[2])) for h in held], [voc.words(h[2]) for h in held], width, last)
            for window in windows:
                yield from pieces(window)
            held = [(held[at][0], start, held[at][2][start - held[at][1]:start - held[at][1] + length], held[at][3]) for at, start, length in open_]

        for part in parts:
            for doc, start, ids, total in zip(*(part.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                held.append((doc, start, np.frombuffer(ids, "<u4"), total))
                if len(held) >= shard_tails:
                    yield from shard(False)
        yield from shard(True)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_PIECES, rows(parts))
    return pack


def pack_documents(docs: DataFrame, path: str | None = None, width: int = 1024, end: int = 0, shard_tails: int = 512,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, ids, doc_tokens, sequence_id, offset``: the pieces of all documents and where they are packed.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit numbers, ``start`` the ids of
    its document before it, ``offset`` those of its sequence before it. A sequence has
    ``width`` ids, or a smaller power of two: nothing is padded. ``path`` is a vocabulary
    file of the tokenizers library that every worker can read (none: the public byte-level one).

    Null and empty texts are the end id alone. Null ids stay null. Repeated rows are documents
    of their own. An empty table gives no pieces. Other columns may have any name. Sequence
    numbers differ, but neither follow on one another nor stay the same when run again.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Full sequences and tails keep their ids in different columns, so reading the ones leaves the others' files alone.
    tokens = scratch.keep(named.mapInArrow(_tokenize(path, width, end), _TOKEN), "tokens")
    tails = tokens.filter("tail is not null").drop("ids", "sequence_id").repartitionByRange("near", "next", "tail").sortWithinPartitions("near", "next", "tail")
    packed = tails.select("doc_id", "start", F.col("tail_ids").alias("ids"), "doc_tokens").mapInArrow(_pack(path, width, shard_tails), _PIECE)
    full = tokens.filter("tail is null").select("doc_id", "start", "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)
