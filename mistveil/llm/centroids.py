"""Centroid clustering of integer vectors: k-means rounds by filtering kd-trees.

Vectors are dealt once into blocks, each with a kd-tree whose nodes hold their
count, integer sums and box. A round walks the trees with the list of
centroids: one that is strictly farther than another from every point of a
node's box leaves the list, a node with one centroid left is taken whole by
its count and sums, and leaves are resolved point by point. Partial counts and
sums are added up by Spark; only the k centroids pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Integer components stop at this size, so that distances fit a long.
LARGEST = 1 << 26
LEAF, BLOCK = 48, 4096
#: Parts of a stored tree and their number types.
PACKED = {"points": "<i4", "spans": "<i4", "children": "<i4", "lows": "<i4", "highs": "<i4", "sums": "<i8"}


class KdTree:
    """Points reordered so that each node is a slice, and per node: start, end, children (-1: leaf), sums, lowest and highest components."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, children = [(0, len(points))], [(-1, -1)]
        self._split(points, spans, children)
        self.points = points[self.order]
        self.spans, self.children = np.array(spans), np.array(children)
        self.lows = np.array([self.points[a:b].min(0) for a, b in spans])
        self.highs = np.array([self.points[a:b].max(0) for a, b in spans])
        self.sums = np.array([self.points[a:b].sum(0) for a, b in spans])

    def packed(self) -> list[bytes]:
        """The tree as the binary columns of PACKED."""
        return [getattr(self, name).astype(kind).tobytes() for name, kind in PACKED.items()]

    @classmethod
    def unpacked(cls, columns: list[bytes], dims: int) -> "KdTree":
        """A tree again from packed(); its points are in its own order."""
        tree = cls.__new__(cls)
        for (name, kind), data in zip(PACKED.items(), columns, strict=True):
            setattr(tree, name, np.frombuffer(data, kind).astype(np.int64).reshape(-1, 2 if name in ("spans", "children") else dims))
        return tree

    def _split(self, points: np.ndarray, spans: list, children: list) -> None:
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = spans[node]
            if b - a <= LEAF:
                continue
            here = self.order[a:b]
            low, high = points[here].min(0), points[here].max(0)
            widest = int(np.argmax(high - low))
            if low[widest] == high[widest]:
                continue  # equal points: their node has a box of one point
            half = (b - a) // 2
            self.order[a:b] = here[np.argpartition(points[here, widest], half)]
            left = len(spans)
            spans += [(a, a + half), (a + half, b)]
            children += [(-1, -1), (-1, -1)]
            children[node] = (left, left + 1)
            todo += [left, left + 1]


def _near(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place of the nearest of a few centroids, the first of equals, and the squared distance."""
    d = np.empty((len(points), len(centroids)), np.int64)
    for i, c in enumerate(centroids):
        gap = points - c
        d[:, i] = np.einsum("ij,ij->i", gap, gap)
    best = d.argmin(1)
    return best, d[np.arange(len(points)), best]


def undominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest (or tie) to a point of the box, as booleans.

    The one nearest to the box's middle is the rival. How much farther another
    one is grows linearly along their difference, so the corner of the box in
    its direction decides; equal distance is no domination.
    """
    doubled = 2 * centroids - (low + high)
    rival = centroids[np.einsum("ij,ij->i", doubled, doubled).argmin()]
    corner = np.where(centroids > rival, high, low)
    own, its = centroids - corner, rival - corner
    return np.einsum("ij,ij->i", own, own) <= np.einsum("ij,ij->i", its, its)


def walk(tree: KdTree, centroids: np.ndarray):
    """(node, centroid) for nodes taken whole and (node, centroid of each point, distances) for leaves."""
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, left = todo.pop()
        left = left[undominated(tree.lows[node], tree.highs[node], centroids[left])]
        if len(left) == 1:
            yield node, int(left[0]), None
        elif tree.children[node][0] < 0:
            a, b = tree.spans[node]
            best, distance = _near(tree.points[a:b], centroids[left])
            yield node, left[best], distance
        else:
            todo += [(int(child), left) for child in tree.children[node]]


def sums_of(tree: KdTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid: how many points are nearest to it, and their sum."""
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for node, best, distance in walk(tree, centroids):
        a, b = tree.spans[node]
        if distance is None:
            n[best] += b - a
            total[best] += tree.sums[node]
        else:
            for c in np.unique(best):
                mine = tree.points[a:b][best == c]
                n[c] += len(mine)
                total[c] += mine.sum(0)
    return n, total


def nearest_of(tree: KdTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point, in the tree's order: its centroid and the squared distance."""
    which, far = np.empty(len(tree.points), np.int32), np.empty(len(tree.points), np.int64)
    for node, best, distance in walk(tree, centroids):
        a, b = tree.spans[node]
        if distance is None:
            gap = tree.points[a:b] - centroids[best]
            distance = np.einsum("ij,ij->i", gap, gap)
        which[a:b], far[a:b] = best, distance
    return which, far


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _planted(points: DataFrame, dims: int) -> DataFrame:
    """points (_id, _ints) as stored trees, one row a block: ids in the tree's order and its packed parts."""

    def grow(ids: pa.Array, ints: np.ndarray) -> pa.RecordBatch:
        tree = KdTree(ints)
        mine = ids.take(pa.array(tree.order))
        listed = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine)
        return pa.RecordBatch.from_arrays([listed, *[pa.array([b], pa.binary()) for b in tree.packed()]], names=["ids", *PACKED])

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield held
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield held

    def plant(batches):
        for parts in blocks(batches):
            yield grow(pa.concat_arrays([p.column(0) for p in parts]), np.vstack([_matrix(p.column(1), dims) for p in parts]))

    kind = points.schema["_id"].dataType.simpleString()
    return stored(points.mapInArrow(plant, ", ".join([f"ids array<{kind}>", *[f"{c} binary" for c in PACKED]])), "trees")


def _trees(batches, dims: int):
    """(ids, tree) of each row of stored trees."""
    for batch in batches:
        columns = [batch.column(c) for c in PACKED]
        for i in range(batch.num_rows):
            yield batch.column("ids")[i].values, KdTree.unpacked([c[i].as_py() for c in columns], dims)


def whole_numbers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component, at most LARGEST in size; null unless there are dims finite components."""
    x = lambda v: v.cast("double")
    sound = (F.size(vector) == dims) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    ints = F.transform(vector, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-2.0 * LARGEST), F.least(F.lit(2.0 * LARGEST), x(v) * scale))))).cast("int"))
    return F.when(F.coalesce(sound, F.lit(False)), ints)


def _first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k points with the smallest hashes of seed and id; k is a parameter, so the driver gets k rows."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select("_ints", name.alias("_hash")).orderBy("_hash", "_ints").limit(k).collect()
    return np.array([r["_ints"] for r in rows], np.int64)


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; one without points stays."""
    k, dims = centroids.shape

    def partial(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, tree in _trees(batches, dims):
            more, sums = sums_of(tree, centroids)
            n, total = n + more, total + sums
        held = np.flatnonzero(n)
        columns = [pa.array(held.astype(np.int32)), pa.array(n[held]), *[pa.array(total[held, i]) for i in range(dims)]]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["cluster", "n", *[f"s{i}" for i in range(dims)]]
    schema = ", ".join(["cluster int", *[f"{c} long" for c in names[1:]]])
    added = trees.mapInArrow(partial, schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names[1:]])
    out = centroids.copy()
    for r in added.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row a kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (its integers).

    Components become floor(scale * x), at most LARGEST in size either way. Kept are vectors of dims
    components, none null or non-finite; others are left out. Centroids start as the k kept vectors with
    the smallest hashes (of equal ids the smaller vector first; a null id hashes as empty), fewer vectors
    make fewer clusters, and an empty table gives no rows. Each round moves every centroid with vectors to
    the floor of their mean; then vectors are assigned once more. Ties go to the smaller number. Repeated
    rows count as often as they come; other columns, whatever their names, are not looked at.
    """
    points = vectors.select(F.col(id).alias("_id"), whole_numbers(F.col(vector), dims, scale).alias("_ints")).where("_ints IS NOT NULL")
    points = stored(points, "points")
    centroids = _first_centroids(points, k, seed)
    schema = f"`{id}` {points.schema['_id'].dataType.simpleString()}, cluster int, distance long"
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    trees = _planted(points, dims)
    for _ in range(rounds):
        centroids = _moved(trees, centroids)

    def assign(batches):
        for ids, tree in _trees(batches, dims):
            which, far = nearest_of(tree, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(which), pa.array(far)], names=[id, "cluster", "distance"])

    assigned = stored(trees.mapInArrow(assign, schema), "clusters")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    text = {c: ",".join(map(str, centroids[c].tolist())) for c in sums}
    about = [(c, s, sum(sums.values()), hashlib.sha256(text[c].encode()).hexdigest(), centroids[c].tolist()) for c, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(table), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
