import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, documents  # noqa: E402

from pageloom.llm import mixing  # noqa: E402


def reshared(sizes, weights, share=1.5, most=2.0):
    """Round by round: cap, and share the excess out again among those below their cap."""
    targets = [share * sum(sizes) * w / sum(weights) for w in weights]
    for _ in range(10_000):
        excess = sum(max(0, t - most * s) for t, s in zip(targets, sizes))
        targets = [min(t, most * s) for t, s in zip(targets, sizes)]
        free = [i for i, (t, s) in enumerate(zip(targets, sizes)) if t < most * s]
        if excess < 1e-9 or not free:
            return targets
        for i in free:
            targets[i] += excess * weights[i] / sum(weights[j] for j in free)
    return targets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10_000), st.sampled_from([1, 2, 3])), min_size=1, max_size=12))
def test_targets_as_reshared_round_by_round(rows):
    sizes, weights = [r[0] for r in rows], [r[1] for r in rows]
    got = mixing.source_targets(sizes, weights)
    assert got == pytest.approx(reshared(sizes, weights), rel=1e-6, abs=1e-6)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s for t, s in zip(got, sizes))


def corpus(n=400):
    return [(i, " ".join(["word"] * (i * 37 % 90)), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(n)]


def test_sources_reach_their_targets(spark):
    rows = corpus()
    mix, schedule = mixing.mix_sources(documents(spark, rows), block_words=64)
    out = {r.doc_id: r for r in mix.collect()}
    assert len(out) == len(rows)
    by_source = {}
    for i, text, source in rows:
        r = out[i]
        assert r.size == len(text.split()) and 0 <= r.taken <= 2 * r.size
        total, size = by_source.setdefault(source, [0, 0])
        by_source[source] = [total + r.taken, size + r.size]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.source_targets([by_source[s][1] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])))
    for i, _, source in rows:
        assert out[i].source_size == by_source[source][1] and out[i].target == want[source]
    assert all(by_source[s][0] == int(want[s]) for s in order)
    slots = schedule.collect()
    assert sum(r.words for r in slots) == sum(int(t) for t in want.values())


def test_early_part_of_the_schedule_follows_the_shares(spark):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(600)]
    mix, schedule = mixing.mix_sources(documents(spark, rows), block_words=32)
    targets = {r.source: r.target for r in mix.join(documents(spark, rows).select("doc_id", "source"), "doc_id").collect()}
    slots = sorted((r.slot, r.source) for r in schedule.collect())
    for part in (100, 300, 600):
        for s, target in targets.items():
            share = sum(x[1] == s for x in slots[:part]) / part
            assert abs(share - target / sum(targets.values())) < 6 / part


def test_reruns_and_partitions_agree(spark):
    rows = corpus(150)
    docs = documents(spark, rows)
    one = sorted(mixing.mix_sources(docs, block_words=16)[0].collect())
    two = sorted(mixing.mix_sources(docs.repartition(5, "text"), block_words=16)[0].collect())
    assert one == two


def test_awkward_rows(spark):
    out = mixing.mix_sources(documents(spark, awkward()))[0].collect()
    assert sorted(str((r.doc_id, r.size)) for r in out) == sorted(str((i, len((t or "").encode().split()))) for i, t, _ in awkward())
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert mixing.mix_sources(documents(spark, []))[0].count() == 0
    empty = mixing.mix_sources(documents(spark, [(1, None, None), (2, "", "a")]))[0].collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 2
    with pytest.raises(ValueError):
        mixing.mix_sources(documents(spark, awkward()), max_sources=2)
