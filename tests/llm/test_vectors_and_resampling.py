"""Importance resampling, centroid clustering and near-duplicate vectors against brute force, with awkward rows and hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mistveil.llm import centroids, resampling, vectors

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ("_id", "_v", "_row", "cluster", "cell", "n", "rank", "score", "weight", "bucket", "leaf", "kept", "_text", "words")


def clashing(frame):
    return frame.withColumns({c: F.lit(7) for c in CLASH})


# --- 11 ---


def runs(text, n):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_scores(docs, target, n=2, buckets=10_000, seed=7, least=20, percent=25):
    read = [(i, *runs(t, n)) for i, t in docs]
    spot = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(spot(f) for _, _, fs in read for f in fs), Counter(spot(f) for x in target for f in runs(x, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, words, fs in read:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(spot(f)) for f in fs) // len(fs) if fs else 0
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = place + 1
    return sorted((r[:5] for r in rows), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß😀") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, prose(rng.randrange(5, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,;\n"), (303, "ÀB A-b\x00c"), (None, prose(30)), (304, prose(60_000)), (305, "x " * 40), (306, "x " * 40), (306, "x " * 40)]
    return docs, [prose(12) for _ in range(20)] + [None, ""]


def scored(frame):
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in frame.collect()), key=repr)


@pytest.mark.parametrize("n,buckets", [(1, 50), (2, 10_000), (3, 70_000)])
def test_importance_scores(spark, texts, n, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 1500)  # many blocks a batch
    docs, target = texts
    frame = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], TEXTS)).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = scored(resampling.importance_scores(frame, wanted, n=n, buckets=buckets))
    assert got == brute_scores(docs, target, n=n, buckets=buckets)


def test_importance_scores_of_nothing(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts[0][:40]], TEXTS)
    none = docs.limit(0)
    assert resampling.importance_scores(none, docs).count() == 0
    assert scored(resampling.importance_scores(docs, none)) == brute_scores(texts[0][:40], [])
    assert scored(resampling.importance_scores(spark.createDataFrame([(1, None, "en", "s", 0)], TEXTS), none))[0][1:3] == [0, 0]


def test_resample_keeps_rows(spark, texts):
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts[0]], TEXTS))
    wanted = spark.createDataFrame([(t,) for t in texts[1]], "text string")
    drawn = resampling.resample(docs, wanted)
    assert drawn.columns == docs.columns
    want = {r[0] for r in brute_scores(*texts) if r[4] is not None}
    assert {r.doc_id for r in drawn.collect()} == want


# --- 12 ---


def brute_clusters(rows, k, rounds, dims, scale=64, seed=1):
    kept = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = np.array([v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1].tolist()))[:k]])
    x = np.array([v for _, v in kept])
    for step in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        best = d.argmin(1)
        if step < rounds:
            c = np.array([x[best == j].sum(0) // (best == j).sum() if (best == j).any() else c[j] for j in range(len(c))])
    least = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(repr((i, int(b), int(e), int(least[best == b].sum()), int(least.sum()), sha[b])) for (i, _), b, e in zip(kept, best, least, strict=True))


def clustered(frame, **options):
    rows = centroids.cluster(frame, **options).collect()
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in rows)


@pytest.mark.parametrize("block", [100, 4096])
def test_clusters(spark, block, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, centres[0].astype(np.float32).tolist()) for i in range(900, 1200)]  # a hot group of equal vectors
    rows += [(1200, None), (1201, []), (1202, [1.0] * 7), (1203, [1.0] * 7 + [None]), (1204, [float("nan")] * 8), (1205, [float("inf")] * 8), (1206, [0.0] * 8), (1206, [0.0] * 8), (None, [0.5] * 8), (1207, [-0.01] * 8)]
    frame = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).repartition(3)
    for k in (1, 6, 16):
        assert clustered(frame, dims=8, k=k) == brute_clusters(rows, k, 3, 8)


def test_clusters_of_few_or_huge_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(empty).count() == 0
    two = spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [0.0, 1.0], 0)], VECTORS)
    got = {r.vec_id: (r.distance, r.centroid) for r in centroids.cluster(two, dims=2).collect()}
    assert got == {1: (0, [centroids.LARGEST, -centroids.LARGEST]), 2: (0, [0, 64])}


def test_filtering_prunes_without_changing_ties():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(0, 3, (400, 3)), 100 + rng.integers(0, 3, (400, 3))])
    tree = centroids.KdTree(points)
    c = np.array([[0, 0, 0], [2, 2, 2], [101, 101, 101], [2, 2, 2]])
    which, far = centroids.nearest_of(tree, c)
    d = ((tree.points[:, None] - c[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (far == d.min(1)).all()
    steps = list(centroids.walk(tree, c))
    assert any(distance is None and tree.spans[node][1] - tree.spans[node][0] > centroids.LEAF for node, _, distance in steps)  # whole nodes are taken
    again = centroids.KdTree.unpacked(tree.packed(), 3)
    assert all((getattr(again, n) == getattr(tree, n)).all() for n in centroids.PACKED)


# --- 13 ---


def brute_links(rows, least, dims):
    sound = [v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else np.zeros(dims) for (_, v), ok in zip(rows, sound, strict=True)])
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    group, fresh = list(range(len(rows))), True
    while fresh:
        fresh = False
        for i in range(len(rows)):
            low = min([group[i], *(group[j] for j in np.flatnonzero(linked[i]))])
            if low != group[i]:
                group[i], fresh = low, True
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[group[i]] = min(low.get(group[i], name), name)
    return sorted(repr((name, int(linked[i].sum()), low.get(group[i]), low.get(group[i]) == name)) for i, (name, _) in enumerate(rows)), linked


def links(frame, **options):
    return sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in vectors.link_vectors(frame, **options).collect())


def noisy(rng, centre, at):
    """A vector whose cosine with the centre is about `at`."""
    off = rng.normal(size=len(centre))
    off -= off @ centre * centre
    return at * centre + math.sqrt(1 - at * at) * off / np.linalg.norm(off)


def unit(rng, dims=64):
    v = rng.normal(size=dims)
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def crowd():
    """Rows with a third in groups: exact copies, tight and loose near copies, chains, and awkward ones."""
    rng = np.random.default_rng(11)
    rows = [(i, unit(rng)) for i in range(900)]
    hot, loose = unit(rng), unit(rng)
    rows += [(1000 + i, noisy(rng, hot, 0.99)) for i in range(300)]
    rows += [(1400 + i, noisy(rng, loose, 0.952)) for i in range(120)]  # right around the wanted cosine
    rows += [(1600 + i, 3.0 * hot) for i in range(60)]
    rows += [(1700 + i, noisy(rng, rows[i][1], 0.93)) for i in range(60)]
    out = [(i, v.astype(np.float32).tolist()) for i, v in rows]
    out += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [None] * 64), (2005, [float("inf")] * 64), (2006, [1.0] * 63), (None, out[3][1]), (None, [1e30] * 64), (2007, [3e38] * 64), (2008, [1e-30] * 64), (5, out[5][1])]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"leaf": 32, "dense": 8}, {"leaf": 32, "dense": 10_000}])
def test_vectors(spark, crowd, options, monkeypatch):
    """With one leaf all links are found; with many leaves nine tenths at least, none wrong."""
    monkeypatch.setattr(vectors, "BLOCK", 128)  # hot groups lie in many blocks, so their cells have to be united
    monkeypatch.setattr(vectors, "TILE", 64)
    frame = clashing(spark.createDataFrame([(i, v, 0) for i, v in crowd], VECTORS)).repartition(5)
    got = links(frame, settings=vectors.Settings(**({"leaf": 100_000} | options)))
    want, linked = brute_links(crowd, 0.9, 64)
    assert len(got) == len(want)
    if not options:
        assert got == want
    else:
        found, total = (sum(eval(r, {"nan": None})[1] for r in side) for side in (got, want))
        assert 0.95 * total <= found <= total == linked.sum()


def test_vectors_of_few_rows(spark):
    assert vectors.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(3, None), (2, [0.0] * 64), (1, [1.0] * 64)]
    assert links(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)) == brute_links(rows, 0.9, 64)[0]


def test_a_hot_group_makes_few_cells_and_pairs(spark):
    """A group of near copies in every partition ends as few cells, so its pairs are not compared one by one."""
    rng = np.random.default_rng(4)
    hot = unit(rng)
    rows = [(i, noisy(rng, hot, 0.98).tolist(), 0) for i in range(3000)]
    seen = []
    plain = vectors._candidates
    vectors._candidates = lambda entries, angle: seen.append(entries.select("cell").distinct().count()) or plain(entries, angle)
    try:
        out = vectors.link_vectors(spark.createDataFrame(rows, VECTORS).repartition(20), settings=vectors.Settings(leaf=256))
        assert {(r.n_links, r.component_id) for r in out.collect()} == {(2999, 0)} and seen[0] <= 10
    finally:
        vectors._candidates = plain


def test_forest_reaches_its_recall():
    """Trees are added until pairs right at the cosine meet often enough; fresh pairs do so too."""
    rng = np.random.default_rng(9)
    x = np.array([unit(rng) for _ in range(4000)])
    forest = vectors.Forest(x, 200_000, 64, vectors.Settings(leaf=512))
    assert forest.recall >= 0.98 and forest.depth == 9
    fresh = np.array([unit(rng) for _ in range(500)])
    others = np.array([noisy(rng, v, 0.9) for v in fresh])
    (r1, l1), (r2, l2) = forest.leaves(fresh), forest.leaves(others)
    met = {a for a, _ in set(zip(r1.tolist(), l1.tolist(), strict=True)) & set(zip(r2.tolist(), l2.tolist(), strict=True))}
    assert len(met) >= 0.95 * 500


def test_cells_are_cliques():
    rng = np.random.default_rng(6)
    x = np.array([noisy(rng, unit(np.random.default_rng(1)), 0.96) for _ in range(300)])
    found = list(vectors.cells_of(x, 0.9, math.acos(0.9) / 2 - vectors.FUZZ, 16))
    for members, centre, radius in found:
        assert (x[members] @ x[members].T >= 0.9).all() and radius >= vectors.angles(x[members], centre[None]).max() - 1e-12
    assert vectors.units(pa.array([[3e200] * 4]), 4).tolist() == [[0.5] * 4]
