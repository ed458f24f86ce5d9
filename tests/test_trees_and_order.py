"""Trees as rows, positions in an order, residual walks and canaries, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mistveil.operators import budget, metrics, order, residuals, trees
from mistveil.operators import html as W
from mistveil.operators.windows import numbered_chunks

NODES = "page_id long, node int, parent int, last int, marker string, image string, image_omitted string, interactive boolean, in_viewport boolean, secret boolean"


def random_tree(rng, n):
    """Parents and last numbers of a tree numbered in document order."""
    parents, open_ = [None], [0]
    for i in range(1, n):
        while len(open_) > 1 and rng.random() < 0.4:
            open_.pop()
        parents.append(open_[-1])
        open_.append(i)
    last = list(range(n))
    for i in range(n - 1, 0, -1):
        last[parents[i]] = max(last[parents[i]], last[i])
    return parents, last


def pruned(rows, chosen):
    """What prune() keeps of one page's nodes, node by node up the tree."""
    by, lost = {r[1]: r for r in rows}, {n for n, kept in chosen if not kept}
    if not lost:
        return {n: False for n in by}
    dropped_image = {n for n, r in by.items() if r[5] is not None and r[6] is not None and not r[8]}
    keep = set()
    for n, r in by.items():
        if (n, True) in chosen or r[9] or r[4] is not None or (r[5] is not None and n not in dropped_image) or (r[7] and r[8]):
            while n is not None:
                keep.add(n)
                n = by[n][2]
    flagged = set()
    for n in lost | dropped_image | {n for n, r in by.items() if r[7] and n not in keep}:
        while n is not None and n not in keep:
            n = by[n][2]
        flagged.add(n)
    return {n: n in flagged for n in keep}


def test_prune_is_that_of_plain_python(spark):
    rng, rows, chosen, want = random.Random(5), [], [], {}
    for page in range(40):
        parents, last = random_tree(rng, rng.randrange(1, 40))
        mine = []
        for n, (up, end) in enumerate(zip(parents, last, strict=True)):
            image = rng.random() < 0.15
            mine.append((page, n, up, end, "svg_skipped" if rng.random() < 0.04 else None, "img" if image else None, "too_small" if image and rng.random() < 0.5 else None, rng.random() < 0.2, rng.random() < 0.3, rng.random() < 0.03))
        picked = {(n, page % 5 == 0 or rng.random() < 0.3) for n in range(len(parents)) if rng.random() < 0.5}
        rows += mine
        chosen += [(page, n, "text", kept) for n, kept in sorted(picked)]
        want |= {(page, n): flag for n, flag in pruned(mine, picked).items()}
    nodes, selected = spark.createDataFrame(rows, NODES), spark.createDataFrame(chosen, "page_id long, node int, field string, kept boolean")
    assert {(r.page_id, r.node): r.trimmed for r in budget.prune(nodes, selected).collect()} == want


def test_prune_of_deep_pages_makes_rows_by_node(spark):
    """3,000 nested elements: no row carries a path."""
    html = "<div>" * 3000 + "deep text" + "</div>" * 3000
    nodes = W.nodes_of(spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string"))
    assert "path" not in nodes.columns
    nodes = nodes.withColumns({"in_viewport": F.lit(False), "image_omitted": F.lit(None).cast("string")}).cache()
    assert nodes.count() == 3001
    selected = spark.createDataFrame([(1, 3000, "text", False)], "page_id long, node int, field string, kept boolean")
    assert budget.prune(nodes, selected).count() == 0
    plan = budget.prune(nodes, selected)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_intervals_of_parsed_pages(spark):
    html = "<main><ul><li>a<b>x</b></li><li>c</li></ul><p>tail</p></main>"
    rows = {r.node: r for r in W.nodes_of(spark.createDataFrame([(1, "", html)], "page_id long, url string, html string")).collect()}
    for n, r in rows.items():
        below = {m for m in rows if m != n and r.node in chain(rows, m)}
        assert max(below | {n}) == r.last and below == set(range(n + 1, r.last + 1))


def chain(rows, n):
    out = set()
    while n is not None:
        out.add(n)
        n = rows[n].parent
    return out


def test_forest(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, 3), (1, 4, 99), (1, 5, 6), (1, 6, 7), (1, 7, 5), (1, 8, 7), (2, 0, 1), (2, 1, None), (2, 1, None), (None, 5, 4), (None, 4, None)]
    rows += [(3, i, i - 1 if i else None) for i in range(700)]  # a chain
    got = {(r.page_id, r.node): (r.parent, r.root, r.depth, r.place) for r in trees.forest(spark.createDataFrame(rows, "page_id long, node long, parent long")).collect()}
    assert got[1, 2] == (1, 0, 2, 0) and got[1, 3] == (None, 3, 0, 1) and got[1, 4] == (None, 4, 0, 2)
    assert all(got[1, n][1:3] == (None, None) for n in (5, 6, 7, 8))  # a cycle, and what hangs on it
    assert got[2, 0] == (1, 1, 1, 0) and got[None, 5] == (4, 4, 1, 0) and got[3, 699] == (698, 0, 699, 0)
    assert len(got) == 14 - 1 + 700
    assert trees.forest(spark.createDataFrame([], "page_id long, node long, parent long")).count() == 0


# --- Places ---


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3) or None, rng.randrange(1000), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g long, v long, i long").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
    assert [(r.g, r.v, r.i) for r in sorted(order.numbered(frame, ["g", "v", "i"]).collect(), key=lambda r: r.place)] == want
    within, seen = {}, {}
    for r in want:
        within[r], seen[r[0]] = seen.get(r[0], 0), seen.get(r[0], 0) + 1
    assert {(r.g, r.v, r.i): r.place for r in order.numbered_within(frame, ["g"], ["v", "i"]).collect()} == within
    assert order.numbered(frame.limit(0), ["v"]).count() == 0


def test_no_task_sees_a_whole_group(spark):
    """One group of 40,000 rows over at least four parts: each part holds some of it."""
    frame = spark.range(40_000).select(F.lit("hot").alias("role"), F.col("id"))
    placed = order.numbered_within(frame, ["role"], ["id"])
    parts = placed.withColumn("part", F.floor(F.col("place") / 10_000)).groupBy("part").agg(F.min("id").alias("low"), F.count("*").alias("n")).collect()
    assert {(r.part, r.low, r.n) for r in parts} == {(i, i * 10_000, 10_000) for i in range(4)}
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "role" not in "".join(line for line in plan.split("\n") if "Window" in line)  # no window over the group
    chunks = numbered_chunks(frame, ["role"], ["id"])
    assert chunks.groupBy("chunk").count().where("count <> 200").count() == 0 and chunks.agg(F.max("chunk")).first()[0] == 199


@pytest.mark.parametrize("values", [[10.0 * i for i in range(1, 11)], [1.0], [5.0] * 9 + [7.0], [float(i % 1000) for i in range(5000)]])
def test_percentiles(spark, values):
    frame = spark.createDataFrame([("a", v) for v in values] + [(None, 3.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in metrics.percentiles(frame, by=["g"], value="v", ranks={"p50": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    at = lambda p: sorted(values)[min(len(values) - 1, int(p * len(values)))]
    assert (got["a"].n, got["a"].p50, got["a"].p95, got["a"].top) == (len(values), at(0.5), at(0.95), max(values))
    assert (got[None].n, got[None].p50) == (1, 3.0) and "b" not in got


# --- Residuals ---


def strings(value, path="$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from strings(v, f"{path}[{i}]")
    elif isinstance(value, dict):
        for k, v in value.items():
            if k != "images":
                yield from strings(v, f"{path}.{k}")


def test_strings_of(spark):
    values = [{"a": "x", "b": [1, None, True, "y", {"images": ["no"], "c": {"d": ["z", ["é😀"]]}}], "images": {"data": "no"}}, "top", ["", []], {}, 5, {"n": {"a": {"b": {"c": {"d": {"e": "deep"}}}}}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, None), (91, "{broken"), (92, "")]
    got = sorted((r.id, r.path, r.text) for r in residuals.strings_of(spark.createDataFrame(rows, "id long, json string"), by=["id"]).collect())
    assert got == sorted((i, p, t) for i, v in enumerate(values) for p, t in strings(v))


def test_residual_scan(spark):
    body = {"page": {"title": "support@a.example, x@b.example"}, "dom": [{"content": {"text": "ABCPE1234F and [PII_PAN_1]"}}], "images": [{"data": "ABCPE1234F"}]}
    rows = spark.createDataFrame([(1, "https://a.example", json.dumps(body)), (2, "https://a.example", '{"a": 1}')], "id long, origin string, json string")
    got = {(r.id, r.kind): r.n for r in residuals.residual_scan(rows, by=["id", "origin"], origin=F.col("origin")).collect()}
    assert got == {(1, "EMAIL_LIKELY_PUBLIC"): 1, (1, "EMAIL"): 1, (1, "PAN"): 1, (1, None): 2}


# --- Canaries ---


def test_many_canaries(spark):
    rng = random.Random(8)
    canaries = [(i, f"c{i}-{rng.randrange(10**6)}") for i in range(10_000)] + [(20_000, "c1-"), (20_001, "éß😀"), (20_002, None), (20_003, canary_twin := "twin"), (20_004, canary_twin)]
    texts = [(f"text {canaries[i][1]} and {canaries[i // 2][1]}x twin twin",) for i in range(0, 3000, 7)] + [(None,), ("",), ("a éß😀 b",)]
    frame, held = spark.createDataFrame(texts, "text string").repartition(4), spark.createDataFrame(canaries, "id long, value string")
    want = {}
    for (t,) in texts:
        for i, v in canaries:
            if t is not None and v is not None and v in t:
                want[i] = want.get(i, 0) + 1
    for most in (metrics.AUTOMATON_CHARS, 30_000):
        found = metrics.canary_leaks(frame, held, most=most)
        assert {r.id: r.n for r in found.collect()} == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert metrics.canary_leaks(frame, held.limit(0)).count() == 0
    assert {r.id: r.n for r in metrics.canary_leaks(frame, spark.createDataFrame([(1, "")], "id long, value string")).collect()} == {1: len(texts) - 1}
