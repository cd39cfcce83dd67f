"""Dual-tree clustering, against SQL and plain rounds."""

import hashlib

import numpy as np
import pytest
from helpers import same_rows

from breathline.llm import lloyd as L
from breathline.llm.queries import OP13_SQL, op13_centroid_clusters


def plain(rows, k, rounds, dim, scale=256):
    """Assign and move in plain integers; rows are (vec_id, vector)."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for (_, v), c in zip(kept, own) if c == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted((i, c, d, sum(x[2] for x in found if x[1] == c), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_sql(spark, sf, duck):
    found = op13_centroid_clusters(spark, sf).collect()
    result = duck.execute(OP13_SQL)
    assert same_rows(found, [c[0] for c in result.description], result.fetchall())


def test_equals_plain_rounds_with_ties_and_repeats(spark, monkeypatch):
    """Vectors on a small grid: equal vectors, equal centroids, ties, empty clusters."""
    monkeypatch.setattr(L, "BLOCK", 50)
    rng = np.random.default_rng(4)
    data = [(int(i), (rng.integers(-2, 3, 3) / 256).tolist()) for i in range(160)] + [(7, [0.0, 0.0, 0.0])] * 5
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    assert rows(L.lloyd(df, k=12, rounds=3, dim=3)) == plain(data, 12, 3, 3)


def test_clustered_vectors_are_pruned(spark):
    """Well-parted groups: trees hand whole nodes to clusters, with the plain result."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(6, 8)) * 5
    data = [(i, (middles[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(600)]
    x = np.floor(256 * np.array([v for _, v in data])).astype(np.int64)
    tree = L.cover_tree(x)
    found = list(L.walk(L.Tree(np.arange(len(x)), np.argsort(tree.order)[tree.center], tree.low, tree.high, tree.child, tree.n_child, tree.radius), x[tree.order], L.Centroids(np.floor(256 * middles).astype(np.int64))))
    whole = sum(b - a for a, b, c in found if isinstance(c, int))
    assert whole > 0.9 * len(x) and sum(b - a for a, b, _ in found) == len(x)
    assert rows(L.lloyd(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=9, rounds=2, dim=8)) == plain(data, 9, 2, 8)


@pytest.mark.parametrize("n,dim,spread", [(1, 4, 1), (40, 4, 0), (700, 4, 300), (700, 64, 300), (500, 1, 3)])
def test_cover_tree(n, dim, spread):
    x = np.random.default_rng(n).integers(-spread, spread + 1, (n, dim))
    t = L.cover_tree(x, leaf=4, few=2)
    assert sorted(t.order) == list(range(n)) and (t.low[0], t.high[0]) == (0, n)
    for node in range(len(t.center)):
        own = t.order[t.low[node] : t.high[node]]
        assert t.center[node] in own
        assert np.isclose(L._far(x[own].astype(float), x[t.center[node]]).max(), t.radius[node])
        children = range(t.child[node], t.child[node] + t.n_child[node])
        if children:
            assert [t.low[c] for c in children] + [t.high[node]] == [t.low[node]] + [t.high[c] for c in children]
            assert t.center[children[0]] == t.center[node]
            limit, middles = t.radius[node] / L.BASE, x[t.center[list(children)]].astype(float)
            assert all(t.radius[c] <= limit + 1e-9 for c in children)
            apart = np.sqrt(((middles[:, None] - middles[None]) ** 2).sum(-1)) + np.eye(len(middles)) * 1e9
            assert (apart > limit).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, 1.0]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [1.0]), (6, []), (7, [None, 1.0]), (None, [0.1, 0.1]), (8, [0.25, -3.0]), (8, [0.25, -3.0]), (8, [0.25, 9.0])]
    wide = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, cluster int, s string")
    assert rows(L.lloyd(wide, k=40, rounds=5, dim=2)) == plain(data, 40, 5, 2)
    none = L.lloyd(wide.where("vec_id = 2"), dim=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert none.dtypes == L.lloyd(wide, dim=2).dtypes
    with pytest.raises(Exception, match="components of"):
        L.lloyd(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dim=2).count()
