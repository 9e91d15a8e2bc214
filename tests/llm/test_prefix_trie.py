import hashlib
import math
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import connect, difference  # noqa: E402

from pageloom.llm import prefix_trie, queries  # noqa: E402

TALKS = "conv_id long, turn long, role string, text string, low long, name string, level int"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TALKS)


def trie(rows):
    """Every node by plain dictionaries."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    through, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            through[path[:d]].append(c)
            if d:
                below[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in sorted(through, key=len, reverse=True):
        saved[n] += (len(through[n]) - 1) * len(n[-1][1]) if n else 0
        leaves[n] += not below[n]
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(map(repr, ((min(through[n]), len(n), min(through[n[:-1]]) if n else None, len(through[n]), len(below[n]),
                              leaves[n], saved[n], sha(n)) for n in through)))


def found(spark, rows):
    return sorted(repr(tuple(r)) for r in prefix_trie.conversation_trie(talks(spark, rows)).collect())


def grown(rng, convs, most, words=("a", "b", "é😀")):
    return [(c, t, rng.choice(["user", None]), rng.choice(words)) for c in convs for t in range(rng.randrange(1, most))]


def test_nodes_as_by_dictionaries(spark):
    rng = random.Random(4)
    rows = grown(rng, range(0, 320), 12) + grown(rng, range(-130, -90), 4) + grown(rng, [901, 905], 3)  # 900 is absent
    rows += [(c, t, "user", "same") for c in range(400, 500) for t in range(9)]  # a group of copies
    rng.shuffle(rows)
    assert found(spark, rows) == trie(rows)


def test_awkward_turns(spark):
    rows = [(None, 1, "user", "lost"), (0, None, "user", "first"), (0, 3, None, None), (0, 3, "user", ""), (0, 3, "user", ""), (0, 1, "r:1", "x"),
            (1, 5, "r", ":1x"), (7, 1, "user", "one"), (107, 1, "user", "one"), (3, 2, "user", "t" * 100_000)]
    assert found(spark, rows) == trie(rows)


def test_only_conversations_without_turns(spark):
    turnless = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6)
    assert found(spark, [(turnless, 1, "user", "gone")]) == trie([(turnless, 1, "user", "gone")])
    assert len(trie([(turnless, 1, "user", "gone")])) == 1


def test_conversations_longer_than_a_row(spark):
    rng = random.Random(5)
    long = [(0, t, "user", f"w{t % 7}") for t in range(300)]
    rows = long + [(c, t, r, x) for c in (100, 200) for _, t, r, x in long[:rng.randrange(130, 290)]]
    rows += [(300, t, "user", "end" if t == 200 else x) for _, t, _, x in long[:260]] + grown(rng, range(1, 40), 150, ("a",))
    assert found(spark, rows) == trie(rows)


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(talks(spark, [])).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_as_sql(spark, folder):
    query = queries.QUERIES["op11_trace_prefixes"](spark, folder)
    assert difference(query, connect(folder), queries.ORACLE_SQL["op11_trace_prefixes"]) is None
