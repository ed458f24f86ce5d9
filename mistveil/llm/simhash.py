"""SimHash near-dedup with pigeonring filtering.

A fingerprint is a ring of segments. If two differ in at most t bits over m
segments, then from some segment on every chain of k segments has at most
k * t / m differences. Chains are checked inside joins, before the distance of
the whole fingerprints.

simhash_groups() links fingerprints of 64 bits at 3 or fewer differing bits,
exactly: with m = t + 1 a chain has 0 differences in its first segment, 1 in
the first two, and so on; the join key is the first segment and the second
with up to one bit changed.

near_dedup() links texts by the Jaccard similarity of their shingle sets. At a
similarity of 0.8 fingerprints differ in 15 % of their bits, too far for 64
bits to tell apart from others, so they have 1,024 bits here. Keys are equal
chains at several places of the ring, as many as the wanted recall takes; the
rest of the ring follows in chains with budgets, and exact sets confirm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, discard, maybe_among, stored
from .graph import components

SEGMENTS, SEGMENT_BITS, MAX_BITS = 4, 16, 3

#: An index bucket of more fingerprints than this gets keys of three segments; a key's fourth segment bounds its bucket by 2 ** 16.
HOT_BUCKET = 32_768


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """SimHash of the shingles of a text's words, A-Z lower-cased, as a signed 64-bit number; no words: 0."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and spaces only
    if not tokens:
        return 0
    if len(tokens) < width:
        grams, n = [b" ".join(tokens)], 1
    else:
        n = len(tokens) - width + 1
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n).astype(">u8").view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, *, id: str, text: str, width: int) -> DataFrame:
    """id and fp for each row of docs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "fp": np.array([fingerprint_of(x, width) for x in frame["text"]], np.int64)})

    # A node of its own: a Python function over a column takes no texts that come straight from lambda expressions.
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {docs.schema[id].dataType.simpleString()}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rotated(fp: Column, segment: int) -> Column:
    """fp with the given segment in front."""
    s = segment * SEGMENT_BITS
    return fp if not s else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)]


def _ring(prints: DataFrame) -> DataFrame:
    """A row for each fingerprint and segment i: i, r (fp with segment i in front)."""
    turns = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), _rotated(F.col("fp"), i).alias("r")) for i in range(SEGMENTS)])
    return prints.select("fp", F.inline(turns))


def _key(i: Column, r: Column, segments: int) -> Column:
    bits = segments * SEGMENT_BITS
    return F.shiftleft(i, bits).bitwiseOR(F.shiftrightunsigned(r, 64 - bits))


def _links(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs a < b with an equal key whose chain stays in its budgets and that differ in at most MAX_BITS bits.

    Merged, as the planner takes exploded rows to be as few as those they come from and would broadcast them.
    """
    a, b = probes.select("key", F.col("fp").alias("u"), F.col("r").alias("ru")), index.select("key", F.col("fp").alias("v"), F.col("r").alias("rv"))
    differ = F.col("ru").bitwiseXOR(F.col("rv"))
    chain = F.bit_count(F.shiftrightunsigned(differ, 64 - 3 * SEGMENT_BITS)) <= 2
    return a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & chain & (F.bit_count(differ) <= MAX_BITS)).select("u", "v")


def similar_prints(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """prints: distinct fingerprints fp. Pairs u < v at 1 to MAX_BITS differing bits (a pair may come twice)."""
    ring = _ring(prints)
    index = ring.withColumn("key", _key(F.col("i"), F.col("r"), 2))
    one_bit = F.array(*[F.lit(m).cast("long") for m in _masks(SEGMENT_BITS, 1)])
    probes = ring.withColumn("mask", F.explode(one_bit)).withColumn("key", _key(F.col("i"), F.col("r"), 2).bitwiseXOR(F.col("mask")))
    hot = stored(index.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"), "hot")
    if hot.isEmpty():
        return _links(probes, index)
    cold = _links(probes.join(hot, "key", "left_anti"), index.join(hot, "key", "left_anti"))
    by_used = [F.array(*[F.lit(m).cast("long") for m in _masks(SEGMENT_BITS, 2 - used)]) for used in (0, 1)]
    third = F.when(F.col("mask") == 0, by_used[0]).otherwise(by_used[1])
    changed = F.shiftleft(F.col("mask"), SEGMENT_BITS).bitwiseOR(F.col("mask3"))
    finer = probes.join(hot, "key", "left_semi").withColumn("mask3", F.explode(third)).withColumn("key", _key(F.col("i"), F.col("r"), 3).bitwiseXOR(changed))
    return cold.unionByName(_links(finer, index.join(hot, "key", "left_semi").withColumn("key", _key(F.col("i"), F.col("r"), 3))))


def simhash_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row a row of docs: its id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links (the own id
    included). Documents without words have fingerprint zero, linked like any
    other. Null ids never are the smallest but where a group has no others;
    rows with equal ids stay rows of their own. An empty table gives no rows;
    no other column of docs is read, whatever its name.
    """
    prints = stored(fingerprints(docs, id=id, text=text, width=width), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    roots = components(similar_prints(nodes.select("fp")))
    # Only fingerprints with a link to another one are in roots.
    rooted = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    linked = stored(rooted.join(lowest.hint("merge"), "root").select("fp", "component"), "linked")
    grouped = stored(nodes.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")), "groups")
    return prints.join(grouped.hint("merge"), "fp").select(F.col("id").alias(id), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


#: Longs of a wide fingerprint.
LONGS = 16
WIDE = 64 * LONGS
_ODD = np.random.default_rng(3).integers(1 << 62, 1 << 63, LONGS, dtype=np.uint64) * 2 + 1


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text's words, A-Z lower-cased, in rising order; a shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    if len(tokens) < width:
        grams, n = [b" ".join(tokens)], 1
    else:
        n = len(tokens) - width + 1
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n).view(np.int64))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WIDE bits of a set of hashes, each turned into LONGS of its own."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 8192):
        turned = hashes[at : at + 8192].view(np.uint64)[:, None] * _ODD
        turned ^= turned >> np.uint64(29)
        turned *= np.uint64(0x9E3779B97F4A7C15)
        turned ^= turned >> np.uint64(32)
        counts += np.unpackbits(turned.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes)).view(np.int64)


@dataclass(frozen=True)
class Ring:
    """How wide fingerprints are compared.

    bits: of a key, so many that about `crowd` unrelated texts share one at any
    size of the corpus. places: where on the ring keys start, as many as give
    two texts at the similarity the wanted chance of an equal key. The budget
    of a chain is proportional to its length, and a margin of two standard
    deviations of what two such texts differ by.
    """

    bits: int
    places: int
    rate: float

    @classmethod
    def of(cls, n: int, similarity: float, recall: float, crowd: int = 1024) -> Ring:
        rate = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
        bits = max(8, ceil(log2(max(n, 1) / crowd)))
        hit = (1 - rate) ** bits
        return cls(bits, 1 if hit >= 1 else ceil(log(1 - recall) / log(1 - hit)), rate)

    def budget(self, bits: int) -> int:
        return int(bits * self.rate + 2 * sqrt(bits * self.rate * (1 - self.rate)))

    def keyed(self, nodes: DataFrame, *columns: str, longs: int = LONGS) -> DataFrame:
        """A row for each node and place: key, the first longs of the fingerprint turned so that the place stands in front (r0, r1, ...; with all of them also earlier, the keys of the places before), the given columns.

        Places are counted in rows, not written out one by one, so the plan is of one size however many there are.
        """
        start = lambda i: f"CAST({i} * {WIDE} DIV {self.places} AS INT)"

        def turned(i: str, k: int) -> str:
            at, by = f"{start(i)} DIV 64 + {k}", f"CAST({start(i)} % 64 AS INT)"
            long = lambda j: f"_f[CAST(({at} + {j}) % {LONGS} AS INT)]"
            # The last long goes in two steps: a shift by 64 would be one by 0.
            return f"(shiftleft({long(0)}, {by}) | shiftrightunsigned(shiftrightunsigned({long(1)}, 1), 63 - {by}))"

        key = f"shiftleft(CAST(i AS BIGINT), {self.bits}) | shiftrightunsigned({turned('i', 0)}, {64 - self.bits})"
        whole = nodes.select(*columns, F.array(*[f"f{k}" for k in range(LONGS)]).alias("_f"))
        keys = whole.withColumn("_keys", F.expr(f"transform(sequence(0, {self.places - 1}), i -> {key})"))
        each = keys.select(*columns, "_f", "_keys", F.posexplode("_keys").alias("_place", "key"))
        earlier = [F.slice("_keys", F.lit(1), F.col("_place")).alias("earlier")] if longs == LONGS else []
        return each.select(*columns, "key", *[F.expr(turned("_place", k)).alias(f"r{k}") for k in range(longs)], *earlier)

    def close(self, longs: int = LONGS) -> Column:
        """Whether every chain of 1, 2, 4, ... longs of a and b stays within its budget."""
        out, so_far = F.lit(True), F.lit(0)
        for k in range(longs):
            so_far = so_far + F.bit_count(F.col(f"a.r{k}").bitwiseXOR(F.col(f"b.r{k}")))
            if (k + 1) & k == 0:
                out = out & (so_far <= self.budget(64 * (k + 1)))
        return out


def _like_sizes(similarity: float) -> Column:
    return F.least("a.n", "b.n") >= F.ceil(F.lit(similarity) * F.greatest("a.n", "b.n") - F.lit(1e-9))


def _wide_prints(docs: DataFrame, *, id: str, text: str, width: int) -> DataFrame:
    """A row for each row of docs: a number (fixed once stored), id, the 128-bit digests of its text (t1, t2) and of its set (s1, s2), n, f0, f1, ..."""

    def run(frames):
        for frame in frames:
            out, prints = [], np.zeros((len(frame), LONGS), np.int64)
            for k, text_ in enumerate(frame["text"]):
                found = shingle_set(text_, width)
                raw = found.tobytes()
                out.append((*(h - (1 << 63) for h in (xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2))), len(found)))
                prints[k] = wide_print(found)
            own = pd.DataFrame(out, columns=["s1", "s2", "n"], index=frame.index).assign(**{f"f{k}": prints[:, k] for k in range(LONGS)})
            yield frame[["row", "id", "t1", "t2"]].join(own)

    t1, t2 = digest(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(text).cast("string").alias("text"))
    longs = ", ".join(f"f{k} long" for k in range(LONGS))
    return rows.mapInPandas(run, f"row long, id {docs.schema[id].dataType.simpleString()}, t1 long, t2 long, s1 long, s2 long, n int, {longs}")


def _sets_of(ends: DataFrame, nodes: DataFrame, docs: DataFrame, *, id: str, text: str, width: int) -> DataFrame:
    """node and shingles (binary) for each node in ends. Only texts of such nodes are shuffled."""

    def sets(frames):
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "shingles": [shingle_set(t, width).tobytes() for t in frame["text"]]})

    rows = nodes.select("node", "low").join(ends.select("node").distinct().hint("merge"), "node")
    rows = stored(rows.select("node", F.col("low.id").alias("_id"), F.col("low.t1").alias("_t1"), F.col("low.t2").alias("_t2")), "candidates")
    t1, t2 = digest(F.coalesce(F.col(text).cast("string"), F.lit("")))
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), t1.alias("t1"), t2.alias("t2")).where(maybe_among(rows, "_t1")(t1))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    held = texts.join(rows.hint("merge"), same).dropDuplicates(["node"]).select("node", "text")
    return stored(held.mapInPandas(sets, "node long, shingles binary"), "candidate-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v of nodes whose shingle sets have the given similarity."""

    def confirm(frames):
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield frame.loc[keep, ["u", "v"]]

    x, y = (sets.select(F.col("node").alias(e), F.col("shingles").alias(s)).hint("merge") for e, s in (("u", "x"), ("v", "y")))
    return stored(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInPandas(confirm, "u long, v long"), "links")


#: So many sets, about, are compared with so many others at a time.
BLOCK = 64


def _confirmed_parts(near: DataFrame, whole: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows node, part of near where the node has a link to some node of the part: all of them are tried, block by block."""

    def confirm(frames):
        for frame in frames:
            out = []
            for part, mine, theirs in zip(frame["part"], frame["mine"], frame["theirs"], strict=True):
                theirs = [np.frombuffer(m["shingles"], "<i8") for m in theirs]
                sizes = np.array([len(x) for x in theirs])
                every, owner = np.concatenate(theirs), np.repeat(np.arange(len(theirs)), sizes)
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                for m in mine:
                    x = np.frombuffer(m["shingles"], "<i8")
                    low, high = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
                    n = high - low
                    spots = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both = np.bincount(owner[spots], minlength=len(theirs))
                    if (both >= similarity * (sizes + len(x) - both) - 1e-9).any():
                        out.append((m["node"], part))
            yield pd.DataFrame(out, columns=["node", "part"])

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        placed = rows.join(counts.hint("merge"), "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        return placed.join(sets.hint("merge"), "node").groupBy("part", "block").agg(F.collect_list(F.struct("node", "shingles")).alias(name)).drop("block")

    members = whole.select("node", "part").join(near.select("part").distinct().hint("merge"), "part")
    both = blocks(near, "mine").join(blocks(members, "theirs").hint("merge"), "part")
    return stored(both.mapInPandas(confirm, "node long, part long").distinct(), "part-links")


def similar_nodes(nodes: DataFrame, docs: DataFrame, *, id: str, text: str, width: int, similarity: float, recall: float) -> DataFrame:
    """Components (node, root) of distinct sets: nodes has node, low (id, t1, t2 of a row), n, f0, f1, ...

    A large group of near copies has links by the square of its size. So each
    node is first tried with two nodes of each key, chosen by hash; what these
    links join is a part. Of each key the largest part leads. Any other node
    that comes close to a node of it is compared with the part's sets, in
    blocks that give one row a node; pairs of nodes of other parts are tried
    one by one. So no pair of close fingerprints is left out, and rows grow
    with nodes, not with pairs in a group.
    """
    options = {"id": id, "text": text, "width": width}
    nodes_ = nodes.where("n > 0")
    ring = Ring.of(nodes_.count(), similarity, recall)
    short = ring.keyed(nodes_, "node", "n", longs=1)
    by_hash = F.struct(F.xxhash64("node", "key").alias("h"), "node", "n", "r0")
    leaders = short.groupBy("key").agg(F.min(by_hash).alias("first"), F.max(by_hash).alias("last"), F.count("*").alias("size")).where("size > 1")
    each = F.explode(F.array_distinct(F.array("first", "last")))
    tried = short.alias("a").join(leaders.select("key", each.alias("b")).hint("merge"), "key")
    tried = tried.where((F.col("a.node") != F.col("b.node")) & ring.close(1) & _like_sizes(similarity))
    tried = stored(tried.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct(), "tried")
    ends = lambda pairs: pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    parts = components(_confirmed(tried, _sets_of(ends(tried), nodes, docs, **options), similarity))

    whole = nodes_.join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    whole = stored(whole.select("node", "n", "part", *[f"f{k}" for k in range(LONGS)]), "parts")
    sizes = whole.groupBy("part").agg(F.count("*").alias("size"))
    lead = ring.keyed(whole.join(sizes.hint("merge"), "part"), "part", "size", longs=1).groupBy("key").agg(F.max(F.struct("size", "part")).alias("m"), F.count("*").alias("rows"))
    lead = stored(lead.where("rows > 1").select("key", F.col("m.part").alias("lead")), "lead-parts")
    rows = stored(ring.keyed(whole, "node", "n", "part").join(lead.hint("merge"), "key"), "keyed")  # read four times
    a, b = rows.where("part <> lead").alias("a"), rows.where("part = lead").alias("b")
    close = (F.col("a.key") == F.col("b.key")) & ring.close() & _like_sizes(similarity)
    near = stored(a.join(b.hint("merge"), close, "left_semi").select("node", F.col("lead").alias("part")).distinct(), "near")
    others = a.join(rows.where("part <> lead").alias("b").hint("merge"), close & (F.col("a.part") != F.col("b.part")) & (F.col("a.node") < F.col("b.node")) & ~F.arrays_overlap("a.earlier", "b.earlier"))
    met = stored(others.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), "met")  # each pair once: at the first key that both have
    discard(rows)
    members = whole.select("node", "part").join(near.select("part").distinct().hint("merge"), "part", "left_semi").select("node")
    sets = _sets_of(ends(met).union(near.select("node")).union(members), nodes, docs, **options)
    # A part stands for its nodes: only links between parts are joined up again.
    part_of = whole.select("node", "part")
    of = lambda end: part_of.select(F.col("node").alias(end), F.col("part").alias(f"{end}p")).hint("merge")
    singles = _confirmed(met, sets, similarity).join(of("u"), "u").join(of("v"), "v").select("up", "vp")
    to_parts = _confirmed_parts(near, whole, sets, similarity).select(F.col("node").alias("u"), F.col("part").alias("vp")).join(of("u"), "u").select("up", "vp")
    roots = components(singles.union(to_parts).select(F.col("up").alias("u"), F.col("vp").alias("v")))
    joined = part_of.join(roots.select(F.col("node").alias("part"), "root").hint("merge"), "part", "left")
    return joined.select("node", F.coalesce("root", "part").alias("root"))


def near_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """docs less near-duplicates: of each group one row stays, the one with the smallest id, then the smallest digest of its text.

    Rows are told apart by id and text, so repeated and null ids take no row
    of another text along; a null id comes after all others. Of rows equal in
    both one stays, the first by its columns as JSON.

    Links are between rows whose sets of `width`-word shingles have the given
    Jaccard similarity or more, all confirmed on the whole sets; `recall` is
    the chance that fingerprints of two texts right at the similarity meet
    (more alike texts meet more surely). Null and empty texts have equal
    sets; an empty table gives no rows; columns of any names stay as they are.
    """
    sets = stored(_wide_prints(docs, id=id, text=text, width=width), "wide-prints")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2")
    wide = [F.first(f"f{k}").alias(f"f{k}") for k in range(LONGS)]
    nodes = stored(sets.groupBy("s1", "s2").agg(F.min(row).alias("low"), F.min("row").alias("node"), F.first("n").alias("n"), *wide), "sets")
    roots = similar_nodes(nodes, docs, id=id, text=text, width=width, similarity=similarity, recall=recall)
    lows = nodes.select("node", "low").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = lows.groupBy("root").agg(F.min("low").alias("low"))
    rows = sets.groupBy("id", "t1", "t2").agg(F.count("*").alias("n"))
    stays = lowest.select("low.*").drop("no_id").withColumnRenamed("id", "_mv_id")
    same_row = F.col("id").eqNullSafe(F.col("_mv_id")) & (rows["t1"] == stays["t1"]) & (rows["t2"] == stays["t2"])
    chosen = stored(rows.join(stays.hint("merge"), same_row).select("_mv_id", F.struct(rows["t1"], rows["t2"]).alias("_mv_text"), "n"), "chosen")
    hashes = F.struct(*[h.alias(f"t{i}") for i, h in enumerate(digest(F.coalesce(F.col(text).cast("string"), F.lit(""))), 1)])
    same = docs[id].eqNullSafe(F.col("_mv_id")) & (hashes == F.col("_mv_text"))
    single = docs.join(chosen.where("n = 1").hint("merge"), same, "left_semi")
    whole = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(chosen.where("n > 1").hint("merge"), same).groupBy("_mv_id", "_mv_text").agg(F.min_by(whole, F.to_json(whole)).alias("_mv_row"))
    return single.unionByName(again.select("_mv_row.*"))
