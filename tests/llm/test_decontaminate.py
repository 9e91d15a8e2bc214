import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, documents, prose  # noqa: E402

from pageloom.llm import decontaminate as dc  # noqa: E402
from pageloom.llm.common import word_hashes  # noqa: E402


def runs(w):
    size = min(5, len(w))
    return [tuple(w[i:i + size]) for i in range(len(w) - size + 1)] if w else []


def plain(rows, items):
    out = set()
    for d, text, _ in rows:
        w = (text or "").lower().split()
        for i, t in items:
            own = (t or "").lower().split()
            if d is None or not own or not w:
                continue
            best = 0
            for s in range(max(1, len(w) - len(own) + 1)):
                size = min(5, len(own))
                part = w[s:s + len(own)]
                a = [tuple(part[k:k + size]) for k in range(len(part) - size + 1)]
                b = runs(own)
                both = sum((Counter(a) & Counter(b)).values())
                best = max(best, both / (len(a) + len(b) - both) if a else 0)
            if best >= 0.75:
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, rng.choice((3, 14, 20, 37, 37, 59))))) for i in range(40)]
    rows = []
    for d in range(250):
        w = prose(rng, rng.randrange(0, 90))
        if d % 4 == 0:
            own = items[rng.randrange(40)][1].split()
            if d % 8 == 0 and len(own) > 30:
                own[-1 if d % 16 else len(own) // 2] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in own] if d % 12 == 0 else own
        rows.append((d, " ".join(w), "s"))
    return rows, items


def test_finds_what_brute_force_finds(spark, corpus):
    rows, items = corpus
    found = dc.find_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got, wanted = {(r.doc_id, r.item_id) for r in found.collect()}, plain(rows, items)
    assert got <= wanted
    exact = {(d, i) for d, i in wanted if f" {dict(items)[i]} " in f" {rows[d][1].lower()} "}
    assert exact <= got and len(got) >= 0.95 * len(wanted)


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "one two"), (4, "first text of five")],
                                  "item_id long, text string")
    docs = documents(spark, awkward())
    found = {(r.doc_id, r.item_id) for r in dc.find_contamination(docs, items).collect()}
    assert found == {(4, 3), (5, 4), (8, 3)}
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id in (4, 5, 8)").count() == 0
    assert kept.filter("doc_id is null").count() == 1 and kept.count() == len(awkward()) - 5
    assert dc.find_contamination(documents(spark, []), items).count() == 0
    assert dc.drop_contaminated(docs, items.limit(0)).count() == len(awkward())


def test_full_bloom_filter_changes_nothing(spark, corpus):
    rows, items = corpus
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = dc.find_contamination(documents(spark, rows), bench, most_bits=64).select("doc_id", "item_id").collect()
    usual = dc.find_contamination(documents(spark, rows), bench).select("doc_id", "item_id").collect()
    assert sorted(small) == sorted(usual)


def test_blocks_hold_every_fingerprint_within_the_radius(spark):
    rng, radius = random.Random(5), 9
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(radius + 1)):
            b ^= 1 << bit
        rows.append(tuple(int(np.array(x, np.uint64).view(np.int64)) for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    same = [x == y for x, y in zip(dc._blocks(df.a, radius), dc._blocks(df.b, radius))]
    any_same = same[0]
    for s in same[1:]:
        any_same = any_same | s
    assert df.filter(any_same).count() == 300


def test_fingerprint_is_the_majority_of_bits():
    h = word_hashes([b"a", b"b", b"c", b"a"])
    mark = dc.fingerprints(h, np.array([0, 1]), 3)
    for start, m in zip((0, 1), mark.tolist()):
        want = sum(1 << k for k in range(64) if sum(int(x) >> k & 1 for x in h[start:start + 3]) >= 2)
        assert m == want


def test_edited_edges_and_cut_items_are_found_as_by_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate((12, 15, 20, 25, 30, 40, 50, 60, 80, 120) * 3)]
    rows, d = [], 0
    for _, text in items:
        w = text.split()
        cut = len(w) // 5 if len(w) > 20 else 2
        least = [w[:-cut], w[cut:], w[:-1], [f"x{k}" for k in range(cut)] + w[cut:], w[:-cut] + [f"y{k}" for k in range(cut)]]
        few = max(1, len(w) // 12)
        for own in [*least, ["p"] * few + w[few:], w[:-few] + ["q"] * few, w[:len(w) // 2] + ["z"] + w[len(w) // 2 + 1:]]:
            around = prose(rng, 30) if d % 2 else []
            rows.append((d, " ".join([*around, *own, *around]), "s"))
            d += 1
    found = dc.find_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == plain(rows, items)
