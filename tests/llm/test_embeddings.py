import math
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import Groups  # noqa: E402

from pageloom.llm import embed_dedup  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, links string, root int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA)


def plain(rows, least=0.93):
    def direction(v):
        x = None if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, np.float32).astype(float)
        return None if x is None else x / np.linalg.norm(x)

    groups, links = Groups(), [0] * len(rows)
    units = [direction(v) for _, v, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            ok = all(rows[x][0] is not None and rows[x][2] is not None and units[x] is not None for x in (a, b))
            if ok and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                groups.link(rows[a][0], rows[b][0])
    return sorted((str(i), n, str(None if i is None else groups.find(i))) for (i, _, _), n in zip(rows, links))


def found(spark, rows):
    out = embed_dedup.near_vectors(table(spark, rows)).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out)


def clusters(seed, n=400, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    rows = []
    for i in range(n):
        c = i % 40
        v = centres[c] if i % 7 == 0 else centres[c] + rng.normal(size=width) * rng.choice([0.05, 0.25, 0.5])
        rows.append((i * 3 % 1009, v.astype(np.float32).tolist(), int(c % 3)))
    return rows


def test_recall_and_no_wrong_link(spark):
    rows = clusters(1)
    got, want = found(spark, rows), plain(rows)
    assert sum(n for _, n, _ in got) >= 0.95 * sum(n for _, n, _ in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_block_pairs_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), 1) for i in range(60)]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1),
        (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
        (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1e30, 1.0], 1), (14, [0.0, 1.0], 1)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def crowd(n, cosine, seed=5, width=64):
    """Vectors of one label, a third of them near each other with this mean cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = rng.permutation(n)[:n // 3]
    x[group] = np.sqrt(cosine) * x[group[0]] + np.sqrt(1 - cosine) * x[group]
    return x.astype(np.float32)


def test_a_third_of_near_vectors_has_all_its_links(spark):
    for n, cosine in ((2000, 0.96), (6000, 0.95)):
        x = crowd(n, cosine)
        u = x.astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want = sum(int((u[i:i + 500] @ u.T >= 0.93).sum()) for i in range(0, n, 500)) - n
        got = embed_dedup.near_vectors(table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).agg({"n_links": "sum"}).first()[0]
        assert got == want


def test_the_exact_way_alone(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "links_in_blocks", None)  # all vectors are in cells
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.3).astype(np.float32).tolist(), i % 2) for i in range(150)]
    assert found(spark, rows) == plain(rows)
