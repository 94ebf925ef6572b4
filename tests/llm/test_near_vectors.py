import math
import random

import numpy as np
import pytest

from shelfmark.llm import cover_tree, near_vectors
from shelfmark.llm.cover_tree import CoverTree, Links, normalized


def slow(rows, threshold):
    """Every two rows of a label by the cosine of their vectors."""

    def fit(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    near = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a is None or a != b or not fit(v) or not fit(w) or len(v) != len(w):
                continue
            s, t = max(map(abs, v)), max(map(abs, w))
            v1, w1 = np.array(v, float) / s, np.array(w, float) / t
            if v1 @ w1 / (math.sqrt(v1 @ v1) * math.sqrt(w1 @ w1)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (name, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((name, len(near[i]), least, name is not None and name == least))
    return sorted(out, key=str)


def check(spark, rows, threshold=0.93, kind="double"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, vector string, node long")
    got = near_vectors.near_duplicates(df.repartition(3), threshold)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows, threshold)


def clustered(n, dim, seed, labels=(1, 2, None)):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(max(1, n // 6), dim))
    found = centers[r.integers(0, len(centers), n)] + r.normal(size=(n, dim)) * r.choice([0, 0.1, 0.3], (n, 1))
    return [(int(i), found[i].tolist(), labels[int(r.integers(len(labels)))]) for i in r.permutation(n)]


def test_by_brute_force(spark):
    rows = clustered(150, 6, 0)
    rows += [(300, [1.0, 0.0], 1), (301, [2.0, 0.0], 1), (302, [0.0, 0.0], 1), (303, None, 1), (304, [], 1), (305, [None, 1.0], 1)]
    rows += [(306, [math.nan, 1.0], 1), (307, [math.inf, 1.0], 1), (None, [3.0, 0.0], 1), (None, [7.0, 7.0, 7.0], 2), (300, [1.0, 0.0], 1)]
    rows += [(308, [-0.0, 1.0], 1), (309, [0.0, 1.0], 1), (310, [1e300, 1e300, 0.0], 2), (311, [1e-300, 1e-300, 0.0], 2)]
    check(spark, rows)
    check(spark, [])


@pytest.mark.parametrize(("block", "pivots", "split"), [(16, 2, 3), (40, 100, 100)])
def test_many_blocks_pivots_in_rounds_and_split_copies(spark, monkeypatch, block, pivots, split):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "PIVOTS", pivots)
    monkeypatch.setattr(near_vectors, "SPLIT", split)
    rows = clustered(200, 3, 1, labels=(1, 1, 2)) + [(1000 + i, [1.0, 2.0, 3.0], 1) for i in range(60)]
    check(spark, rows)


def test_at_the_threshold(spark):
    """0.6 and 0.8 are exact; one step of a double below is no link."""
    rows = [(1, [1.0, 0.0], 1), (2, [3.0, 4.0], 1), (3, [4.0, 3.0], 1), (4, [4.0, math.nextafter(3.0, 4.0)], 1)]
    check(spark, rows, threshold=0.8)
    check(spark, rows, threshold=0.6)


def test_group_of_near_copies_gives_rows_in_proportion(spark):
    r = np.random.default_rng(2)
    center = r.normal(size=16)
    vectors = center + r.normal(size=(600, 16)) * 0.02
    points = spark.createDataFrame([(i, 1, 16, v.tolist(), 1) for i, v in enumerate(vectors)], "node long, label int, dim int, vector array<double>, weight long")
    found = near_vectors.links(points, 0.93).collect()
    assert len(found) == 600 and {x.links for x in found} == {599}


@pytest.mark.parametrize("seed", range(12))
def test_trees_by_brute_force(monkeypatch, seed):
    r = random.Random(seed)
    for name, sizes in {"LEAF": (1, 8), "TILE": (2, 512), "BATCH": (2, 256), "DENSE": (1, 1000)}.items():
        monkeypatch.setattr(cover_tree, name, r.choice(sizes))
    raw = [np.array([v for _, v, _ in clustered(n, 5, seed)]) for n in (90, 61)]
    raw[1][:20] = raw[0][:20]
    weights = [np.arange(len(x)) % 3 + 1 for x in raw]
    a, b = (CoverTree(normalized(x)) for x in raw)
    near = normalized(raw[0]) @ normalized(raw[1]).T >= 0.9
    counts = Links(a, b, weights, raw, 0.9).counts()
    assert (counts[0] == near @ weights[1]).all() and (counts[1] == near.T @ weights[0]).all()
    near = normalized(raw[0]) @ normalized(raw[0]).T >= 0.9
    np.fill_diagonal(near, False)
    found = Links(a, a, (weights[0], weights[0]), (raw[0], raw[0]), 0.9)
    assert (found.counts()[0] == near @ weights[0]).all()
    label = np.arange(90)
    while (label != (new := np.minimum(label, np.where(near, label, 90).min(1)))).any():
        label = new
    roots = found.roots()[0]
    assert len(set(zip(roots, label))) == len(set(roots)) == len(set(label))
    for t in (a, b):
        for k in range(len(t.start)):
            assert np.sqrt(np.maximum(2 - 2 * t.points[t.start[k] : t.end[k]] @ t.centers[k], 0)).max() <= t.radius[k] + 1e-6
