import random
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import Groups, awkward, documents, prose  # noqa: E402

from pageloom.llm import jaccard  # noqa: E402


def sets_of(rows):
    out = []
    for i, text, _ in rows:
        w = (text or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def plain(rows):
    sets, groups = sets_of(rows), Groups()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                groups.link(i, j)
    return sorted((str(i), len(s), str(None if i is None else groups.find(i))) for i, s in sets)


def found(spark, rows, **options):
    df = jaccard.jaccard_components(documents(spark, rows), **options)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def near_copies(seed=1):
    rng, rows = random.Random(seed), []
    line = prose(rng, 12)
    for g in range(25):
        base = prose(rng, rng.randrange(6, 120))
        for _ in range(rng.choice((1, 2, 3, 12))):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = line
            rows.append((len(rows) * 3 % 1000, " ".join(w), "s"))
    rows += [(2000 + i, " ".join([*line, *prose(rng, i % 3)]), "s") for i in range(40)]
    return rows


def test_links_as_brute_force(spark):
    rows = near_copies()
    assert found(spark, rows) == plain(rows)


def test_few_frequent_shingles_change_nothing(spark):
    rows = near_copies(2)
    assert found(spark, rows, most_frequent=1) == plain(rows)


def test_awkward_rows(spark):
    assert found(spark, awkward()) == plain(awkward())
    assert found(spark, []) == []


def test_one_of_each_group_stays(spark):
    rows = [*near_copies(3), *near_copies(3)[:5]]
    docs = documents(spark, rows)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    roots = {c for _, _, c in plain(rows)}
    ids = [str(r.doc_id) for r in kept.collect()]
    assert set(ids) == roots and len(ids) == len(set(ids))
    assert jaccard.keep_one_of_each(documents(spark, awkward())).filter("doc_id is null").count() == 1


def test_large_group_of_near_copies_is_not_paired(spark):
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = []
    for i in range(1500):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "s"))
    assert {c for _, _, c in found(spark, rows)} == {"0"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.lists(st.integers(0, 40), min_size=1, max_size=40),
       st.lists(st.integers(0, 40), max_size=20))
def test_prefixes_of_similar_sets_share_enough(x, y, frequent):
    a, b = (np.unique(np.array(v, np.uint64)) for v in (x, y))
    common = np.unique(np.array(frequent, np.uint64))
    levels = np.array([3 + int(c) % 5 for c in common], np.int8)
    first, _ = jaccard.prefix(a, common, levels, 75)
    second, _ = jaccard.prefix(b, common, levels, 75)
    similar = 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b))
    assert jaccard.linked(a, b) == similar
    if similar:
        assert len(set(first) & set(second)) >= jaccard.shared_needed(len(a), len(b), len(first), len(second), 75)


def test_sketches_never_part_similar_sets_and_part_most_others(spark):
    import numpy as np

    from pageloom.llm import jaccard
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 4, 40, 180, 1100):
        one = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for share in (0, 0.05, 0.1, 0.14, 0.15, 0.3, 0.6):
            gone = round(share * len(one))
            other = np.unique(np.concatenate([one[gone:], rng.integers(0, 2**63, gone, np.uint64)]))
            rows.append((len(one) << 32, jaccard.parity_sketch(one).tolist(), len(other) << 32, jaccard.parity_sketch(other).tolist(),
                         n, float(share), bool(jaccard.linked(one, other, 75))))
    test = jaccard._near_enough("a", "b", 75)
    found = spark.createDataFrame(rows, "ma long, sa array<long>, mb long, sb array<long>, n int, share double, linked boolean").selectExpr(
        "struct(ma as meta, sa as sketch) as a", "struct(mb as meta, sb as sketch) as b", "n", "share", "linked").selectExpr(
        "*", f"{test} as near").collect()
    assert all(r.near for r in found if r.linked) and sum(r.linked for r in found) >= 15
    assert not any(r.near for r in found if r.n in (40, 180) and r.share >= 0.3)
