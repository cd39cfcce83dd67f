"""Exact Lloyd clustering of integer vectors with two trees.

The vectors are cut into blocks; each has a cover tree, built and written once. The
centroids of a round have a tree of the same kind, which is broadcast. A walk takes
a vector node and centroid nodes. Every node's centre is one of its own points, so from
a vector node's points the nearest centroid is at most as far as the nearest centre of a
centroid node and the vector node's radius; a centroid node all of whose centroids are
farther is pruned. One centroid left takes the whole vector node with its sum; at leaves
the vectors are compared exactly with the centroids that are left.

Of a round, only sums by cluster move. All sums and distances are 64-bit integers;
bounds are doubles with a slack that rounding can't reach.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .topk import _product, quantised

#: Vectors of a block with its own tree, and of a leaf.
BLOCK, LEAF = 2_048, 32
#: Vectors that children hold on average at least; a node of points too even for that stays a leaf.
FEW = 8
#: Ratio of the distances that two levels of a tree cover.
BASE = 1.3
#: Components are smaller than this, so that distances stay within 64 bits.
LARGEST = 1 << 25

BLOCKS = "vec_id array<long>, v array<int>, center array<int>, low array<int>, high array<int>, child array<int>, n_child array<int>, radius array<double>"
ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, n long, s array<long>"


@dataclass
class Tree:
    """Nodes level by level; a node's points are those from low to high in ``order``.

    ``center`` is a row of the points, ``radius`` the largest distance of a node's points
    from it. The n_child children follow each other from ``child``; a leaf has none.
    """

    order: np.ndarray
    center: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    n_child: np.ndarray
    radius: np.ndarray


def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def cover_tree(points: np.ndarray, leaf: int = LEAF, few: int = FEW, base: float = BASE) -> Tree:
    """A cover tree of some points, one at least.

    A node's centre is the centre of its first child; children's points lie within a
    base-th of the node's radius of their centres, which are farther apart than that.
    """
    x = points.astype(np.float64)
    order = np.arange(len(x))
    center, low, high, far = [0], [0], [len(x)], [_far(x, x[0])]
    child, n_child, radius = [], [], []
    for node, c in enumerate(center):  # grows while it is read
        a, b, d = low[node], high[node], far[node]
        far[node] = None
        radius.append(float(d.max()))
        child.append(len(center))
        parts = _parts(x, order[a:b], c, d, radius[-1] / base, (b - a) // few) if b - a > leaf and radius[-1] > 0 else []
        for own_center, rows, own_far in parts:
            order[a : a + len(rows)] = rows
            center.append(own_center)
            low.append(a)
            a += len(rows)
            high.append(a)
            far.append(own_far)
        n_child.append(len(parts))
    return Tree(order, *(np.array(values) for values in (center, low, high, child, n_child, radius)))


def _parts(x: np.ndarray, rows: np.ndarray, c: int, d: np.ndarray, limit: float, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centre, rows, distances) of children within ``limit``; none where there would be more than ``most``."""
    parts, own = [], d
    while len(rows):
        if len(parts) == most:
            return []
        near = own <= limit
        parts.append((c, rows[near], own[near]))
        rows, d = rows[~near], d[~near]
        if len(rows):
            c = int(rows[d.argmax()])  # what is farthest from the node's centre comes next
            own = _far(x[rows], x[c])
    return parts


class Centroids:
    """Centroids with a tree down to single ones; equal centroids are one node."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.tree = cover_tree(values, leaf=1, few=1)
        self.centers = values[self.tree.center].astype(np.float64)

    def members(self, nodes: np.ndarray) -> np.ndarray:
        """Numbers of the nodes' centroids, ascending."""
        t = self.tree
        return np.sort(np.concatenate([t.order[t.low[n] : t.high[n]] for n in nodes]))

    def near(self, centre: np.ndarray, radius: float, nodes: np.ndarray, leaf: bool) -> np.ndarray:
        """Nodes below ``nodes`` that hold every centroid nearest to any point within ``radius`` of a centre.

        Larger nodes than the vectors' own are opened, for a leaf all of them.
        """
        t = self.tree
        while True:
            d = _far(self.centers[nodes], centre)
            upper = d.min() + radius
            nodes = nodes[d - radius - t.radius[nodes] <= upper * (1 + 1e-9) + 1e-6]
            wide = (t.n_child[nodes] > 0) & (leaf | (t.radius[nodes] > radius))
            if not wide.any():
                return nodes
            opened = [np.arange(t.child[n], t.child[n] + t.n_child[n]) for n in nodes[wide]]
            nodes = np.concatenate([nodes[~wide], *opened])


def walk(tree: Tree, x: np.ndarray, centroids: Centroids):
    """Yield (low, high, cluster) of a node's points in the tree's order: a number, or one a point.

    ``x`` has the points in the tree's order, whose centres are places in it.
    """
    stack = [(0, np.array([0]))]
    t = centroids.tree
    while stack:
        node, nodes = stack.pop()
        leaf = not tree.n_child[node]
        nodes = centroids.near(x[tree.center[node]].astype(np.float64), tree.radius[node], nodes, leaf)
        a, b = int(tree.low[node]), int(tree.high[node])
        if len(nodes) == 1 and t.radius[nodes[0]] == 0:
            yield a, b, int(centroids.members(nodes)[0])
        elif leaf:
            own = centroids.members(nodes)
            yield a, b, own[distances(x[a:b], centroids.values[own]).argmin(axis=1)]
        else:
            first = tree.child[node]
            stack.extend((n, nodes) for n in range(first, first + tree.n_child[node]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs of rows."""
    return (a**2).sum(axis=1)[:, None] - 2 * _product(a, b) + (b**2).sum(axis=1)[None, :]


def blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """One row a block of vec_id and v: vectors in their tree's order, and the tree."""

    def build(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            values = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            for i in range(0, len(ids), BLOCK):
                x = values[i : i + BLOCK]
                if np.abs(x).max() >= LARGEST:
                    raise ValueError(f"components of {LARGEST} or more")
                tree = cover_tree(x)
                place = np.empty(len(x), np.int32)
                place[tree.order] = np.arange(len(x), dtype=np.int32)
                columns = [(ids[i : i + BLOCK][tree.order], pa.int64()), (x[tree.order].ravel(), pa.int32()), (place[tree.center], pa.int32())]
                columns += [(a, pa.int32()) for a in (tree.low, tree.high, tree.child, tree.n_child)] + [(tree.radius, pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a).cast(kind)) for a, kind in columns], [f.split()[0] for f in BLOCKS.split(", ")])

    return vectors.mapInArrow(build, BLOCKS)


def _read(batches, dim: int):
    """(ids, vectors, tree) of each block."""
    for batch in batches:
        for r in range(batch.num_rows):
            own = {c: batch.column(c)[r].values.to_numpy() for c in batch.schema.names}
            ids, v = own.pop("vec_id"), own.pop("v").astype(np.int64).reshape(-1, dim)
            yield ids, v, Tree(np.arange(len(ids)), *(own[c] for c in ("center", "low", "high", "child", "n_child", "radius")))


def _sums(trees: DataFrame, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors and their sum for each centroid."""
    k, dim = values.shape

    def add(batches):
        centroids = Centroids(values)
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x, tree in _read(batches, dim):
            for a, b, cluster in walk(tree, x, centroids):
                if isinstance(cluster, int):
                    n[cluster] += b - a
                    s[cluster] += x[a:b].sum(axis=0)
                else:
                    n += np.bincount(cluster, minlength=k)
                    np.add.at(s, cluster, x[a:b])
        own = np.flatnonzero(n)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(s[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    part = trees.mapInArrow(add, SUMS)
    total = part.select("cluster", "n", F.posexplode("s").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for r in total.collect():  # clusters x components
        n[r.cluster], s[r.cluster, r.j] = r.n, r.s
    return n, s


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2:", scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part.

    Vectors of exactly ``dim`` components take part, none null or non-finite, with a
    vec_id; a component x becomes floor(scale * x). The first centroids are the k vectors
    of smallest sha256 of salt and vec_id, in that order; repeated ids go by vector, and
    each row may be one. A round moves every non-empty centroid to the floor of its
    vectors' mean; of equally near centroids the smaller number wins, so of equal ones the
    others stay empty and where they are. Fewer than k vectors are that many centroids.
    Repeated rows count each; columns other than vec_id and embedding are ignored. An
    empty table gives an empty result; components of 2**25 or more are an error.
    """
    spark = vectors.sparkSession
    own = quantised(vectors, scale).where(F.size("v") == dim)
    chosen = own.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "v").limit(k).collect()
    values = np.array([r.v for r in chosen], np.int64).reshape(-1, dim)
    if not len(values):
        return own.selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    trees, path = materialise(blocks(own, dim), "vector-trees")
    for _ in range(rounds):
        n, s = _sums(trees, values)
        values = np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], values)

    def assign(batches):
        centroids = Centroids(values)
        for ids, x, tree in _read(batches, dim):
            cluster = np.empty(len(ids), np.int32)
            for a, b, found in walk(tree, x, centroids):
                cluster[a:b] = found
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster), pa.array(((x - values[cluster]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])

    assigned, _ = materialise(trees.mapInArrow(assign, ASSIGNED), "assigned-vectors")
    discard(spark, path)
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in values.tolist()]
    rows = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
