"""Near-duplicate vectors by a forest of random-projection trees with overlapping leaves.

A tree halves the vectors again and again at the median along a random
direction; rows within a margin of the median go both ways. Trees are fitted
on a bounded sample, as many as pairs right at the wanted similarity need to
meet with the wanted chance; every row is led through all of them. Within a
leaf short sign sketches are compared, pairs that may be close are verified on
the vectors, and linked ones united.

Dense groups are condensed first. A cell is a set of vectors within half the
wanted angle of its centre, so all of them are linked with each other. Leaves
hold cells, not their members. If the angle between two cells' centres and
both radii stay within the wanted angle, all members are linked, by counts
alone; if not even the nearest members can be close, none are; what lies
between is compared member by member, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, cos, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, maybe_among, stored
from .graph import components

#: Bits of a sketch, in two longs, and how many standard deviations of its error a pair may be off.
SKETCH_BITS, SLACK = 128, 4.5
#: Rows of a block in which cells are formed, and of one side of a comparison in blocks.
BLOCK, TILE = 4096, 2048
#: Angles are certain up to this.
FUZZ = 1e-7


@dataclass(frozen=True)
class Settings:
    """least: cosine from which on vectors are linked. leaf: rows wanted in a leaf. margin: how far from a median
    rows go both ways, in standard deviations. recall: share of pairs right at `least` that shall meet, measured
    on the sample. sample: rows to fit the trees on, at most. dense: members from which on a cell is formed."""

    least: float = 0.9
    leaf: int = 1024
    margin: float = 0.08
    recall: float = 0.98
    sample: int = 32_768
    dense: int = 16
    seed: int = 1

    @property
    def angle(self) -> float:
        return acos(self.least)


def units(column, dims: int) -> np.ndarray:
    """A list column as rows of length 1."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # before squares, so that they cannot overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between rows of x and y, pair by pair; exact near 0 too."""
    gap = x - y
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(np.einsum("ij,ij->i", gap, gap)) / 2))


class Tree:
    """Random directions, one a level, and a threshold a node: the median of the sample there, or of the whole level below what the sample can tell."""

    def __init__(self, sample: np.ndarray, depth: int, margin: float, rng: np.random.Generator):
        self.directions = rng.standard_normal((sample.shape[1], depth))
        at = sample @ self.directions
        self.margins = margin * at.std(0) if len(at) else np.zeros(depth)
        self.level = np.median(at, axis=0) if len(at) else np.zeros(depth)
        self.fitted = min(depth, max(0, int(log2(max(1, len(sample)) / 64))))
        self.nodes = np.zeros(1 << self.fitted)
        node = np.ones(len(sample), np.int64)
        for d in range(self.fitted):
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange(1 << d, (2 << d) + 1))
            for i in range(1 << d):
                mine = order[edges[i] : edges[i + 1]]
                self.nodes[(1 << d) + i] = np.median(at[mine, d]) if len(mine) else self.level[d]
            node = 2 * node + (at[:, d] >= self.nodes[node])

    def route(self, x: np.ndarray, spill: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a row of x comes to; without spill one a row."""
        at = x @ self.directions
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for d in range(at.shape[1]):
            off = at[row, d] - (self.nodes[node] if d < self.fitted else self.level[d])
            right = off >= 0
            twice = (np.abs(off) < self.margins[d]) if spill else np.zeros(len(row), bool)
            node = np.concatenate([2 * node + right, (2 * node + ~right)[twice]])
            row = np.concatenate([row, row[twice]])
        return row, node


class Forest:
    """Trees, and the hyperplanes of sketches."""

    def __init__(self, sample: np.ndarray, n: int, dims: int, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.settings, self.dims = settings, dims
        self.planes = rng.standard_normal((dims, SKETCH_BITS))
        self.depth = max(0, ceil(log2(max(1, n) / settings.leaf)))
        x = sample[: 4096]
        y = rng.standard_normal(x.shape)
        y -= np.einsum("ij,ij->i", x, y)[:, None] * x
        y = settings.least * x + sqrt(1 - settings.least**2) * y / np.maximum(np.linalg.norm(y, axis=1), 1e-300)[:, None]
        met, self.trees = np.zeros(len(x), bool), []
        while not self.trees or (len(x) and met.mean() < settings.recall):
            tree = Tree(sample, self.depth, settings.margin, rng)
            self.trees.append(tree)
            a, b = (set(zip(*(v.tolist() for v in tree.route(side)), strict=True)) for side in (x, y))
            met[list({row for row, _ in a & b})] = True
        self.recall = float(met.mean()) if len(x) else 1.0

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """Two longs a row: the sides of the hyperplanes it lies on."""
        return np.packbits(x @ self.planes >= 0, axis=1).view("<i8")

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) over all trees."""
        found = [t.route(x) for t in self.trees]
        return np.concatenate([r for r, _ in found]), np.concatenate([leaf * len(found) + i for i, (_, leaf) in enumerate(found)])


def cells_of(x: np.ndarray, least: float, most: float, dense: int):
    """(members, centre, radius) of cells of at least `dense` rows of x, none farther than the angle `most` from its centre."""
    single = x.astype(np.float32)
    near = single @ single.T >= least
    degree, free = near.sum(1), np.ones(len(x), bool)
    while len(x):
        seed = int(degree.argmax())
        if degree[seed] < dense:
            return
        centre = x[near[seed] & free].sum(0)
        centre /= np.linalg.norm(centre)
        far = angles(x, centre[None])
        members = free & (far <= most)
        if members.sum() < dense or not members[seed]:
            degree[seed] = 0
            continue
        yield np.flatnonzero(members), centre, float(far[members].max())
        free &= ~members
        degree = np.where(free, degree - near[:, members].sum(1), 0)


def _condensed(rows: DataFrame, forest: Forest, sample: np.ndarray, total: int) -> DataFrame:
    """Stored rows (_row, _id, _v) with _cell and _many (whether that has several members); one row of such a cell has its _centre, _radius and _n."""
    s, dims, tree = forest.settings, forest.dims, forest.trees[0]
    # A leaf that holds more of the sample than a block may is dealt over several blocks.
    home, n = np.unique(tree.route(sample, spill=False)[1], return_counts=True)
    shares = {int(h): ceil(c * total / len(sample) / BLOCK) for h, c in zip(home, n, strict=True)}

    def deal(batches):
        for batch in batches:
            home = tree.route(units(batch.column("_v"), dims), spill=False)[1]
            row = batch.column("_row").to_numpy()
            salt = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            parts = np.array([shares.get(h, 1) for h in home.tolist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array((salt % parts).astype(np.int64))], names=[*batch.schema.names, "_home", "_salt"])

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def condense(block: pa.Table) -> pa.Table:
        row = block.column("_row").to_numpy()
        x = units(block.column("_v"), dims)
        cell, many, heads = row.copy(), np.zeros(len(row), bool), {}
        for at in range(0, len(row), BLOCK):  # a block larger than planned is cut
            for members, middle, far in cells_of(x[at : at + BLOCK], s.least, s.angle / 2 - FUZZ, s.dense):
                members = members + at
                cell[members], many[members] = row[members[0]], True
                heads[members[0]] = (middle.tolist(), far, len(members))
        about = [[heads.get(i, (None, None, None))[k] for i in range(len(row))] for k in range(3)]
        columns = [*(block.column(c) for c in ("_row", "_id", "_v")), pa.array(cell), pa.array(many), pa.array(about[0], pa.list_(pa.float64())), pa.array(about[1], pa.float64()), pa.array(about[2], pa.int64())]
        return pa.table(columns, names=["_row", "_id", "_v", "_cell", "_many", "_centre", "_radius", "_n"])

    dealt = rows.mapInArrow(deal, f"{given}, _home long, _salt long")
    return stored(dealt.groupBy("_home", "_salt").applyInArrow(condense, f"{given}, _cell long, _many boolean, _centre array<double>, _radius double, _n long"), "cells")


def merged(x: np.ndarray, n: np.ndarray, most: float):
    """(members, centre) of groups of centres within the angle `most` of one of them, the heaviest first; every centre is in one."""
    left = np.argsort(-n, kind="stable")
    while len(left):
        near = angles(x[left], x[left[0]][None]) <= most
        members, left = left[near], left[~near]
        middle = (x[members] * n[members, None]).sum(0)
        yield members, middle / np.linalg.norm(middle)


def _united(cells: DataFrame, forest: Forest) -> DataFrame:
    """Stored: for each cell of several members (_cell, _v, _radius, _n) its union's number _super and centre _middle.

    A group spread over many blocks has a cell in each. Rounds of unions within blocks of centres bring them
    together; a union has the heaviest cell's number.
    """
    dims, most = forest.dims, forest.settings.angle / 4
    heads, count, turn = cells.select("_cell", "_v", "_n"), cells.count(), 0
    known = cells.select("_cell", "_radius", F.col("_cell").alias("_super"), F.col("_v").alias("_middle"))
    while count > 1:
        tree = forest.trees[turn % len(forest.trees)]

        def deal(batches, tree=tree):
            for batch in batches:
                home = tree.route(units(batch.column("_v"), dims), spill=False)[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=[*batch.schema.names, "_home"])

        def unite(block: pa.Table) -> pa.Table:
            cell, n = block.column("_cell").to_numpy(), block.column("_n").to_numpy()
            into, size, centre = cell.copy(), n.copy(), [None] * len(cell)
            for members, middle in merged(units(block.column("_v"), dims), n, most):
                into[members], size[members] = cell[members[0]], n[members].sum()
                for m in members:
                    centre[m] = middle.tolist()
            return pa.table([pa.array(cell), pa.array(into), pa.array(centre, pa.list_(pa.float64())), pa.array(size)], names=["_cell", "_into", "_v", "_n"])

        if count <= BLOCK:  # few enough for one block
            salted = heads.withColumns({"_home": F.lit(0).cast("long"), "_salt": F.lit(0).cast("long")})
        else:
            homed = heads.mapInArrow(deal, "_cell long, _v array<double>, _n long, _home long")
            sizes = homed.groupBy("_home").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
            salted = homed.join(sizes, "_home").withColumn("_salt", F.pmod(F.xxhash64(F.lit(turn), "_cell"), F.col("_parts")))
        step = stored(salted.groupBy("_home", "_salt").applyInArrow(unite, "_cell long, _into long, _v array<double>, _n long"), "unions")
        onward = step.select(F.col("_cell").alias("_super"), "_into", F.col("_v").alias("_middle"))
        known = stored(known.drop("_middle").join(onward, "_super").select("_cell", "_radius", F.col("_into").alias("_super"), "_middle"), "united")
        heads = step.where("_cell = _into").select("_cell", "_v", "_n")
        before, count, turn = count, heads.count(), turn + 1
        if before <= BLOCK or count > 0.9 * before:
            break
    return known


def _settled(members: DataFrame, unions: DataFrame, forest: Forest) -> DataFrame:
    """Stored: members of cells of several rows (_row, _id, _v) with their last _cell, _far and _centre.

    A member near enough to its union's centre is in the union's cell, numbered below 0; others stay in the cell they
    were in. _far is the angle to the union's centre, or the old cell's radius.
    """
    dims, most = forest.dims, forest.settings.angle / 2 - FUZZ

    def settle(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = angles(units(batch.column("_v"), dims), units(batch.column("_middle"), dims))
            fits = far <= most
            cell = np.where(fits, -1 - batch.column("_super").to_numpy(), batch.column("_cell").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_id", "_v")), pa.array(cell), pa.array(np.where(fits, far, batch.column("_radius").to_numpy()))], names=["_row", "_id", "_v", "_cell", "_far"])

    joined = members.select("_row", "_id", "_v", "_cell").join(unions, "_cell")
    given = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in ("_row", "_id", "_v"))
    return stored(joined.select("_row", "_id", "_v", "_cell", "_radius", "_super", "_middle").mapInArrow(settle, f"{given}, _cell long, _far double"), "settled")


def _entries(rows: DataFrame, cells: DataFrame, forest: Forest) -> DataFrame:
    """Stored: leaf, cell, s0, s1 (sketch), radius; each cell once in each leaf that one of its members comes to."""
    dims = forest.dims

    def lead(batches, sketched: bool):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column("_v"), dims)
            row, leaf = forest.leaves(x)
            cell = batch.column("_cell").to_numpy()[row]
            if sketched:
                sketch = forest.sketches(x)[row]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(cell), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(np.zeros(len(row), np.float32))], names=["leaf", "cell", "s0", "s1", "radius"])
            else:
                both = np.unique(np.stack([leaf, cell], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["leaf", "cell"])

    def sketch(batches):
        for batch in batches:
            bits = forest.sketches(units(batch.column("_v"), dims)) if batch.num_rows else np.zeros((0, 2), np.int64)
            radius = np.nextafter(batch.column("_radius").to_numpy().astype(np.float32), np.float32(9))
            yield pa.RecordBatch.from_arrays([batch.column("_cell"), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(radius)], names=["cell", "s0", "s1", "radius"])

    alone = rows.where("NOT _many").select("_v", "_cell").mapInArrow(lambda b: lead(b, True), "leaf long, cell long, s0 long, s1 long, radius float")
    places = rows.where("_many").select("_v", "_cell").mapInArrow(lambda b: lead(b, False), "leaf long, cell long").distinct()
    about = cells.where("_many").select("_cell", "_v", "_radius").mapInArrow(sketch, "cell long, s0 long, s1 long, radius float")
    return stored(alone.unionByName(places.join(about, "cell")), "entries")


def close_in_leaf(cell: np.ndarray, sketch: np.ndarray, radius: np.ndarray, side: np.ndarray | None, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cells of a leaf whose sketches do not rule out that members are within the angle; with side, pairs of two sides only."""
    a, b = (np.arange(len(cell)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    left, right = [], []
    sketch = sketch.view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        apart = sum(np.bitwise_count(sketch[rows, i][:, None] ^ sketch[b, i][None]).astype(np.int16) for i in (0, 1))
        reach = np.minimum(pi, angle + radius[rows][:, None] + radius[b][None]) / pi if radius.any() else np.full((1, 1), angle / pi)
        most = SKETCH_BITS * reach + SLACK * np.sqrt(SKETCH_BITS * reach * (1 - reach))
        i, j = np.nonzero(apart <= most)
        left.append(rows[i])
        right.append(b[j])
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    i, j = cell[i], cell[j]
    if side is None:
        return i[i < j], j[i < j]
    return np.minimum(i, j), np.maximum(i, j)


def _candidates(entries: DataFrame, angle: float) -> DataFrame:
    """Distinct pairs a < b of cells that may have close members; a leaf of many cells is compared in blocks."""
    large = entries.groupBy("leaf").count().where(F.col("count") > 2 * TILE).select("leaf", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("cell"), parts).cast("int")
    placed = entries.join(large, "leaf", "left").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiled = placed.select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cell", "s0", "s1", "radius")

    def compare(tile: pa.Table) -> pa.Table:
        get = lambda c: tile.column(c).to_numpy()
        across = tile.column("i")[0].as_py() != tile.column("j")[0].as_py()
        a, b = close_in_leaf(get("cell"), np.stack([get("s0"), get("s1")], 1), get("radius").astype(np.float64), get("side") if across else None, angle)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return tiled.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _judged(candidates: DataFrame, cells: DataFrame, forest: Forest) -> DataFrame:
    """Stored: a, b, na, nb, sure; pairs of cells whose members are all linked (sure) or may be; other pairs are gone."""
    s, dims = forest.settings, forest.dims
    about = cells.select("_cell", "_v", "_radius", "_n")
    named = lambda side: about.select(F.col("_cell").alias(side), *[F.col(f"_{c}").alias(f"{c}{side}") for c in ("v", "radius", "n")])
    pairs = stored(candidates, "candidates")
    sides = [named(c).where(maybe_among(pairs, c)(F.col(c))) for c in ("a", "b")]

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, far = units(batch.column("va"), dims), units(batch.column("vb"), dims), batch.column("radiusa").to_numpy() + batch.column("radiusb").to_numpy()
            apart = angles(x, y)
            points = far == 0
            sure = np.where(points, np.einsum("ij,ij->i", x, y) >= s.least, apart + far <= s.angle - FUZZ)
            maybe = ~points & ~sure & (apart - far <= s.angle + FUZZ)
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")], pa.array(sure)], names=["a", "b", "na", "nb", "sure"])
            yield out.filter(pa.array(sure | maybe))

    return stored(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(judge, "a long, b long, na long, nb long, sure boolean"), "judged")


def _by_member(unsure: DataFrame, rows: DataFrame, forest: Forest) -> DataFrame:
    """Stored: a, b, _row, n: for members of unsure pairs of cells how many of the other cell's they are linked with; those without are gone."""
    s, dims = forest.settings, forest.dims
    blocks = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    tiles = unsure.withColumns({"pa": blocks("na"), "pb": blocks("nb")}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)))
    members = rows.select(F.col("_cell").alias("_of"), "_row", "_v")
    place = lambda parts: F.pmod(F.xxhash64(F.lit("tile"), "_row"), F.col(parts)).cast("int")
    tile = ["a", "b", "i", "j"]
    left = tiles.join(members, F.col("a") == F.col("_of")).where(place("pa") == F.col("i")).select(*tile, F.lit(0).alias("side"), "_row", "_v")
    right = tiles.join(members, F.col("b") == F.col("_of")).where(place("pb") == F.col("j")).select(*tile, F.lit(1).alias("side"), "_row", "_v")

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        x, side, row = units(block.column("_v"), dims), block.column("side").to_numpy(), block.column("_row").to_numpy()
        linked = x[side == 0] @ x[side == 1].T >= s.least
        n = np.concatenate([linked.sum(1), linked.sum(0)])
        both = np.concatenate([row[side == 0], row[side == 1]])[n > 0]
        a, b = (np.full(len(both), block.column(c)[0].as_py(), np.int64) for c in ("a", "b"))
        return pa.table([pa.array(a), pa.array(b), pa.array(both), pa.array(n[n > 0])], names=["a", "b", "_row", "n"])

    return stored(left.unionByName(right).groupBy(*tile).applyInArrow(compare, "a long, b long, _row long, n long"), "members")


def _valid(vector: Column, dims: int) -> Column:
    x = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dims: int = 64, settings: Settings | None = None) -> DataFrame:
    """One row a vector: id, n_links (others linked directly), component_id (smallest id reachable, itself included), kept (whether that is its own).

    Vectors with a cosine of at least settings.least are linked if the forest finds them; none below it are.
    Null or zero vectors, those with null or non-finite components or another number than dims link with
    nothing. Repeated rows are vectors like others, so equal rows are linked and each keeps its row; ids that
    repeat make several rows kept. A null id is no smallest id unless its component has no other. An empty
    table gives no rows. Other columns, whatever their names, are not looked at.
    """
    s = settings or Settings()
    rows = vectors.select(F.col(id).alias("_id"), F.col(vector).alias("_v"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows.withColumn("_v", F.when(_valid(F.col("_v"), dims), F.col("_v"))), "vectors")
    sound = rows.where("_v IS NOT NULL")
    n = sound.count()
    drawn = hash_sample(sound, ["_row"], s.sample).select("_v").toArrow()  # bounded by s.sample
    sample = units(drawn.column("_v"), dims) if drawn.num_rows else np.zeros((0, dims))
    forest = Forest(sample, n, dims, s)
    condensed = _condensed(sound, forest, sample, n)
    old = condensed.where("_centre IS NOT NULL").select("_cell", F.col("_centre").alias("_v"), "_radius", "_n")
    unions = _united(old, forest)
    members = _settled(condensed.where("_many"), unions, forest)
    placed = condensed.where("NOT _many").select("_row", "_id", "_v", "_cell", "_many").unionByName(members.select("_row", "_id", "_v", "_cell", F.lit(True).alias("_many")))
    centres = old.select("_cell", "_v").unionByName(unions.where("_cell = _super").select((-1 - F.col("_super")).alias("_cell"), F.col("_middle").alias("_v")))
    sizes = members.groupBy("_cell").agg(F.max("_far").alias("_radius"), F.count("*").alias("_n"), F.min("_id").alias("_low"))
    one = condensed.where("NOT _many").select("_cell", F.col("_v").cast("array<double>").alias("_v"), F.lit(0.0).alias("_radius"), F.lit(1).cast("long").alias("_n"), F.col("_id").alias("_low"), F.lit(False).alias("_many"))
    cells = one.unionByName(stored(sizes.join(centres, "_cell").withColumn("_many", F.lit(True)), "centres"))
    judged = _judged(_candidates(_entries(placed, cells, forest), s.angle), cells, forest)
    found = _by_member(judged.where("NOT sure"), placed, forest)
    sure = judged.where("sure")
    edges = sure.select("a", "b").unionByName(found.select("a", "b").distinct())
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    by_cell = sure.select(F.col("a").alias("cell"), F.col("nb").alias("more")).unionByName(sure.select(F.col("b").alias("cell"), F.col("na").alias("more"))).groupBy("cell").agg(F.sum("more").alias("more"))
    linked = roots.select(F.col("node").alias("_cell"), "root")
    # Cells of one vector without a link need no row here.
    known = cells.join(linked, "_cell", "left").where("_many OR root IS NOT NULL").withColumn("root", F.coalesce("root", "_cell"))
    lows = known.groupBy("root").agg(F.min("_low").alias("low"))
    about = stored(known.select("_cell", "_n", "root").join(lows, "root").join(by_cell.withColumnRenamed("cell", "_cell"), "_cell", "left").select("_cell", F.col("_n").alias("size"), "low", F.coalesce("more", F.lit(0)).alias("more")), "about")
    own = found.groupBy("_row").agg(F.sum("n").alias("own"))
    everyone = rows.select("_row", "_id").where("_v IS NULL").withColumn("_cell", F.lit(None).cast("long")).unionByName(placed.select("_row", "_id", "_cell"))
    out = everyone.join(about, "_cell", "left").join(own, "_row", "left")
    links = F.coalesce(F.col("size") - 1 + F.col("more"), F.lit(0)) + F.coalesce("own", F.lit(0))
    component = F.when(F.col("size").isNull(), F.col("_id")).otherwise(F.col("low"))
    return out.select(F.col("_id").alias(id), links.cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
