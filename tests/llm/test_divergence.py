import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, documents  # noqa: E402

from pageloom.llm import divergence  # noqa: E402

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(rows, least, top=50):
    """``rows``: ``(text, lang, source)``; whole numbers all through."""
    groups, often, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        often[lang or ""].update(set(found))
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in often[lang].items() if n >= least]
        of = {s: Counter({t: n for t, n in c.items() if t in set(kept)}) for (l, s), c in groups.items() if l == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        for s in of:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in of if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:limit])]
    return sorted(out)


def check(spark, rows, least=3, **sizes):
    docs = documents(spark, [(i, t, None) for i, (t, _, _) in enumerate(rows)]).drop("lang", "source")
    docs = docs.join(spark.createDataFrame([(i, la, so) for i, (_, la, so) in enumerate(rows)], "doc_id long, lang string, source string"), "doc_id")
    got = sorted(tuple(r) for r in divergence.audit_sources(docs, least, **sizes).collect())
    assert got == audit(rows, least, sizes.get("top", 50))
    return got


def corpus(rng, n, sources=6, words=400):
    """Words by rank, shifted by source, so that every source has words of its own."""
    return [(" ".join(f"W{chr(97 + k % 26)}{chr(97 + k // 26)}" + "é" * (k % 3 == 0) for k in
                      (int(words * rng.random() ** 3 + 17 * s) % words for _ in range(rng.randrange(0, 60)))), f"l{s % 2}", f"s{s}" if s else None)
            for s in (min(rng.randrange(2 * sources), sources - 1) for _ in range(n))]


def test_as_by_counting(spark):
    check(spark, corpus(random.Random(1), 900))


def test_small_blocks_chunks_and_tops(spark):
    check(spark, corpus(random.Random(2), 500), top=5, chunk_terms=16, block_sources=2, most_entries=50)


def test_awkward_texts(spark):
    rows = [(t, None if i % 3 else "en", s) for i, (_, t, s) in enumerate(awkward())]
    got = check(spark, rows * 2, least=2)
    assert {r[0] for r in got} == {"", "en"}
    check(spark, [("a b", "en", "s1"), (None, "en", "s2"), ("", "fr", "s1")], least=5)  # no kept terms: pairs of 0
    check(spark, [("only one source", "en", "s1")] * 4)


def test_long_texts_are_cut_between_terms():
    text = ("Ab1cd é" * 400_000).encode()
    assert sum(divergence._terms(text), []) == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]


def test_empty_table(spark):
    assert divergence.audit_sources(documents(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=60), st.integers(1, 4), st.randoms())
def test_skyband_by_counting_dominators(rows, k, rng):
    place = list(range(len(rows)))
    rng.shuffle(place)
    beaten = [sum(c >= a and d <= b and place[j] < place[i] for j, (c, d) in enumerate(rows)) for i, (a, b) in enumerate(rows)]
    got = divergence.skyband(np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], int), np.array(place, int), k)
    assert sorted(got) == [i for i, n in enumerate(beaten) if n < k]


def test_no_task_has_all_counts_of_a_group(spark):
    rng = random.Random(3)
    plan = divergence.audit_sources(documents(spark, [(i, t, "s1") for i, (t, _, _) in enumerate(corpus(rng, 200))]), 3)
    assert "salt" in plan._jdf.queryExecution().toString() and "CartesianProduct" not in plan._jdf.queryExecution().toString()
