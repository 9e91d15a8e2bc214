import random
import sys
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, documents, prose  # noqa: E402

from pageloom.llm import line_dedup  # noqa: E402


def texts(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_common_block_leaves_the_later_document(spark):
    rng = random.Random(1)
    passage = [" ".join(prose(rng, 20)) for _ in range(3)]
    own = [" ".join(prose(rng, 15)) for _ in range(8)]
    rows = [
        (10, "\n".join([own[0], *passage, own[1]]), "s"),
        (20, "\n".join([own[2], own[3], *passage]), "s"),
        (5, "\n".join([own[4], passage[0], own[5]]), "s"),          # one line alone is no block of 30 words
        (30, "\n".join([own[6], passage[0].upper(), passage[1], own[7]]), "s"),  # two lines that doc 10 has in a row
    ]
    out = dict((int(i), t) for i, t in texts(line_dedup.drop_repeated_lines(documents(spark, rows))))
    assert out[10] == rows[0][1] and out[5] == rows[2][1]
    assert out[20] == "\n".join([own[2], own[3]])
    assert out[30] == "\n".join([own[6], own[7]])


def test_copies_go_and_frequent_passage_stays_once(spark):
    rng = random.Random(2)
    passage = " ".join(prose(rng, 60))
    rows = [(i, "\n".join([" ".join(prose(rng, 9)), passage, " ".join(prose(rng, 9))]), "s") for i in range(300)]
    rows.append((999, rows[7][1], "s"))
    out = dict(texts(line_dedup.drop_repeated_lines(documents(spark, rows))))
    assert [i for i, t in out.items() if passage in t] == ["0"]
    assert "999" not in out and len(out) == 300


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    # Only the repeated row and no other text repeats an earlier id: nothing changes.
    assert texts(kept) == sorted((str(i), str(t)) for i, t, _ in awkward())
    assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_matches_equal_lines_in_order(a, b):
    found = line_dedup.align(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    if a == b:
        assert len(found) == len(a)


def test_runs_cross_blank_lines():
    assert line_dedup.repeated_runs([True, False, True, False], [5, 0, 6, 9], 11) == [0, 1, 2]
    assert line_dedup.repeated_runs([True, False, True, False], [5, 1, 6, 9], 11) == []


def test_block_whose_lines_have_earlier_owners(spark):
    rng = random.Random(4)
    one, two = (" ".join(prose(rng, 20)) for _ in range(2))
    rows = [(1, one, "s"), (2, two, "s")] + [(i, f"own {i}\n{one}\n{two}\nend {i}", "s") for i in range(5, 101)]
    out = dict(texts(line_dedup.drop_repeated_lines(documents(spark, rows))))
    assert [i for i, t in out.items() if f"{one}\n{two}" in t] == ["5"]


def test_runs_cover_a_block():
    hashes, sizes = [1, 2, 3, 4], [20, 0, 15, 5]
    runs = line_dedup.shortest_runs([0, 1, 2, 3], hashes, sizes, 30)
    assert len(runs) == 2  # from the first line to the third, and from the first to the last
    assert set(line_dedup.shortest_runs([1, 2, 3, 4], [9, *hashes], [7, *sizes], 30)) == set(runs)


def test_passage_twice_without_a_unique_line():
    a, b = [1, 9, 2], [3, 9, 4, 9, 5]
    assert [a[i] for i, _ in line_dedup.align(a, b)] == [9]
    assert len(line_dedup.common_lines(a, b, [60] * 5, 30)) == 1
    assert len(line_dedup.common_lines(b, a, [60] * 3, 30)) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_subsequence_is_a_longest_one(a, b):
    found = sorted(line_dedup._subsequence(a, b, 0, len(a), 0, len(b)))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
