import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, documents, prose  # noqa: E402

from pageloom.llm import packing, queries  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return packing.Vocabulary(PATH)


def test_the_short_way_is_taken_and_gives_the_librarys_ids(vocabulary, library):
    assert vocabulary.fast
    rng = random.Random(1)
    blanks = [" ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "\xa0", " \xa0x", "\x0b", "   "]
    for _ in range(3000):
        text = "".join(rng.choice(["don't", "I'LL", "'s", "été", "Straße", "x1y22", "...", "—", "“q”", "A", *blanks, *blanks]) for _ in range(rng.randrange(20)))
        assert vocabulary.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_has_the_librarys_ids(text):
    voc = packing.vocabulary(PATH)
    assert voc.ids(text).tolist() == voc.slow.encode(text, add_special_tokens=False).ids


def test_special_texts_as_the_library_reads_them(vocabulary, library):
    for text in ("a<|endoftext|>b", "<|endoftext|>", "<|endo", "\x1c \x1d\n\x85 x"):
        assert vocabulary.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def check(rows, pieces, library, width):
    """All ids once, in order, and sequences without gaps or padding."""
    left = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, _ in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    for p in pieces:
        assert p.offset + len(p.ids) // 4 <= width
    for (doc, total), found in by_doc.items():
        same = [ids for (i, ids), n in left.items() for _ in range(n) if i == doc and len(ids) == total]
        assert sum(len(p.ids) for p in found) // 4 == total * len(same)
        covered = Counter(x for p in found for x in range(p.start, p.start + len(p.ids) // 4))
        assert covered == Counter({x: len(same) for x in range(total)})
        for p in found:
            ids = tuple(np.frombuffer(p.ids, "<u4"))
            assert any(s[p.start:p.start + len(ids)] == ids for s in same)
    assert len(by_doc) == len({(i, len(ids)) for i, ids in left})
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert at == width or at & (at - 1) == 0
    return by_sequence


def test_every_id_lies_in_one_piece(spark, library):
    rng = random.Random(2)
    rows = awkward() + [(100 + i, " ".join(prose(rng, rng.randrange(0, 150))), "s") for i in range(150)]
    rows += [(1000 + i, "the same copy of a text " * 12, "s") for i in range(60)]
    pieces = packing.pack_documents(documents(spark, rows), PATH, width=128, shard_tails=32).collect()
    found = check(rows, pieces, library, 128)
    short = [s for s in found.values() if sum(len(p.ids) for p in s) < 4 * 128]
    assert len(short) <= 7 * 8  # at most one window a task is cut into powers of two


def test_windows_hold_like_documents(spark):
    rng = random.Random(3)
    topics = [[f"{a}{b}" for b in prose(rng, 60)] for a in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(25)), "s") for i in range(400)]
    pieces = packing.pack_documents(documents(spark, rows), width=512).collect()
    by_sequence = defaultdict(set)
    for p in pieces:
        by_sequence[p.sequence_id].add(p.doc_id)
    met = [(a % 8 == b % 8) for s in by_sequence.values() for a in s for b in s if a < b]
    assert len(met) > 300 and sum(met) / len(met) > 0.7  # by chance one in eight


def test_index_scores_by_the_formula():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 12, rng.integers(0, 9)).astype(np.uint64) for _ in range(30)]
    index, mean = packing.Index(words), np.mean([len(w) for w in words])
    df = Counter(t for w in words for t in set(w.tolist()))

    def score(seed, entry):
        total = 0
        for t in set(words[seed].tolist()):
            idf = max(0, np.log((30 - df[t] + 0.5) / (df[t] + 0.5)))
            tf = words[entry].tolist().count(t)
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[entry]) / mean)) if df[t] > 1 else 0
        return total
    for seed in range(30):
        assert index.scores(seed) == pytest.approx([score(seed, e) for e in range(30)])


def test_other_vocabularies_go_the_librarys_way(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    voc = packing.Vocabulary(path)
    assert not voc.fast and voc.ids("Some Words").tolist() == Tokenizer.from_file(path).encode("Some Words", add_special_tokens=False).ids
    rows = [(i, "some words", "s") for i in range(9)]
    pieces = packing.pack_documents(documents(spark, rows), path, width=16).collect()
    check(rows, pieces, Tokenizer.from_file(path), 16)


def test_empty_table_and_bad_width(spark):
    assert packing.pack_documents(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(documents(spark, []), width=1000)


def test_query_digests(spark, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = queries.QUERIES["op13_pack_documents"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in out} == set(rows)
    for r in out:
        ids = np.array(library.encode(rows[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
