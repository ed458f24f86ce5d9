"""The training-data operators against brute force, on small fixtures with nulls, empty texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mistveil.llm import decontaminate, graph, lines, lm, mixing, quality_rules, simhash, site_quality, substrings, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \t\n\x0b\x0c\r ", "en", "b", 5), (4, "one", "en", "a", 3), (5, "one two", "en", "a", 7), (6, "ONE two", "en", "a", 7), (6, "ONE two", "en", "a", 7),
    (7, "É é ÉÉ ß 😀 x\n\n\nend", "fr", "a", 9), (8, "w " * 3000, "en", "z", 6000), (None, "null id text of some words", "en", "b", 20), (None, "null id text of some words", "en", "b", 20), (9, "x y z", "en", "b", 5),
]


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


WORDS = vocabulary(400, 0)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Awkward rows with columns whose names the operators use."""
    frame = spark.createDataFrame(AWKWARD, SCHEMA)
    return frame.withColumns({c: F.lit(7) for c in ("size", "copy", "id", "text2", "n_words", "kept", "component_id", "_id", "score", "label", "row", "words", "n_lines", "rate")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# --- 1 ---


def test_mixing_targets_fill_up(spark):
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 10), ("a", 10), ("b", 300), ("c", 500), (None, 180)])]
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(spark.createDataFrame(rows, SCHEMA)).collect()}
    # weights a 5, b 2, c 1, null 5; a stops at 60; the other 940 are shared 2:1:5, null stops at 540; 400 are shared 2:1
    assert got["a"] == (20, 60.0) and got[None] == (180, 540.0)
    assert got["b"][1] == pytest.approx(800 / 3) and got["c"][1] == pytest.approx(400 / 3)
    assert sum(t for _, t in got.values()) == pytest.approx(1000)


def test_mixing_takes_near_target(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), "en", "abc"[min(i % 5, 2)], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    first, again = (sorted(map(tuple, mixing.plan_mix(d).select("doc_id", "copies", "size", "target", "source_size", "source").collect())) for d in (docs, docs.repartition(3)))
    assert first == again
    taken, target = defaultdict(int), {}
    for _, copies, size, goal, whole, source in first:
        assert 0 <= copies <= 3 and abs(copies - goal / whole) < 1
        taken[source] += copies * size
        target[source] = goal
    for s, goal in target.items():
        assert abs(taken[s] - goal) < 0.08 * goal
    assert mixing.mix(docs).count() == sum(r[1] for r in first)


def test_mixing_awkward(awkward, nothing):
    out = mixing.plan_mix(awkward)
    assert out.count() == len(AWKWARD) and set(awkward.columns) <= set(out.columns)
    assert mixing.mix(awkward).columns == [c for c in awkward.columns if c != "copy"] + ["copy"]
    assert mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert {r.target for r in out.where("source_size = 0").collect()} <= {0.0}


# --- 2 ---


def brute_fingerprint(text, width):
    w = words(text)
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, awkward):
    rng = random.Random(2)
    texts = [r[1] for r in AWKWARD] + [prose(rng, rng.randrange(1, 80)) for _ in range(40)]
    for width in (3, 5):
        for t in texts:
            assert simhash.fingerprint_of(t, width) % 2**64 == brute_fingerprint(t, width)
    assert spark.sql("SELECT xxhash64('one two three') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def brute_links(prints):
    return {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


@pytest.mark.parametrize("hot", [10**9, 3])
def test_pigeonring_finds_all_links(spark, hot):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4, 5)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in simhash.similar_prints(frame, hot).collect()}
    assert got == brute_links(prints)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_simhash_groups_awkward(spark, awkward, nothing):
    rows = simhash.simhash_groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[5].component_id == by[6].component_id == 5
    assert simhash.simhash_groups(nothing).count() == 0
    kept = simhash.near_dedup(awkward)
    assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 7, 8, None, 9])
    assert simhash.near_dedup(nothing).count() == 0


# --- 3 ---


def test_chains():
    seeds = [(0, 10), (5, 15), (12, 22), (30, 41), (7, 90), (300, 310), (305, 315), (2, 3)]
    best = substrings.chains(seeds)
    assert best[0] == [(0, 10), (5, 15), (12, 22), (30, 41)] and [(300, 310), (305, 315)] in best
    assert sorted(p for c in best for p in c) == sorted(seeds)
    assert substrings.chains([]) == []


def test_edits():
    rng = random.Random(5)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1, *row[1:]] if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        return out

    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        assert substrings.edits(np.array(a), np.array(b), 40) == slow(a, b)
        pattern = defaultdict(int)
        for i, x in enumerate(a):
            pattern[x] |= 1 << i
        if a:
            parts = [slow(a, b[s:e]) for s in range(len(b) + 1) for e in range(s, len(b) + 1)]
            assert decontaminate.edit_matches(pattern, len(a), b)[0] == min(parts)


def test_passages_are_found(spark, nothing):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(0, 60, 2):
        passage = prose(rng, rng.randrange(60, 90)).split()
        other = list(passage)
        for _ in range(i // 20 * 2):
            other[rng.randrange(5, len(other) - 5)] = "changed"
        for k, p in ((i, passage), (i + 1, other)):
            rows.append((k, " ".join([prose(rng, rng.randrange(0, 80)), *p, prose(rng, rng.randrange(0, 80))]), "en", "s", 0))
        want.add((i, i + 1))
    rows += [(k, prose(rng, 120), "en", "s", 0) for k in range(100, 120)]
    rows += [(200 + k, rows[0][1].upper(), "en", "s", 0) for k in range(3)] + [(300, None, None, None, None), (301, "", None, None, None), (302, "w " * 500, None, None, None), (None, rows[4][1], None, None, None)]
    found = substrings.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    passages = {tuple(sorted((r.doc_id, r.other), key=lambda x: (x is not None, x))) for r in found if r.kind == "passage"}
    copies = {(r.doc_id, r.other) for r in found if r.kind == "copy"}
    assert copies == {(200, 0), (201, 0), (202, 0), (None, 4)} or copies == {(200, 0), (201, 0), (202, 0), (4, None)}
    assert {p for p in passages if None not in p} >= want - {(4, 5)} and not {x for p in passages for x in p} & set(range(100, 120))
    for r in found:
        assert r.end - r.start >= 50 and r.edits <= 0.2 * max(r.end - r.start, r.other_end - r.other_start)
    assert substrings.repeated_passages(nothing).count() == 0


def test_passage_that_many_share_gives_linear_rows(spark):
    """A holder has a few partners: two for most seeds, others for seeds at the passage's ends, which only some holders choose."""
    counts = []
    for n in (150, 450):
        rng = random.Random(7)
        passage = prose(rng, 70)
        rows = [(i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "s", 0) for i in range(n)]
        found = substrings.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {x for r in found for x in (r.doc_id, r.other)} == set(range(n))
        counts.append(len(found))
    assert counts[0] <= 4 * 150 and counts[1] <= 3.3 * counts[0]


# --- 4 ---


def brute_lines(rows):
    keyed = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for id_, text in rows:
        for line in (text or "").split("\n"):
            holders[keyed(line)].add(id_)
    out = []
    for id_, text in rows:
        parts = (text or "").split("\n")
        least = lambda x: -1 if x is None else x
        gone = [len(keyed(p)) >= 20 and len(holders[keyed(p)]) >= 3 and id_ != max(holders[keyed(p)], key=least) for p in parts]
        out.append((id_, "\n".join(p for p, g in zip(parts, gone, strict=True) if not g), len(parts), sum(gone)))
    return sorted(out, key=repr)


def test_line_dedup(spark, awkward, nothing):
    rng = random.Random(8)
    common = [prose(rng, 6) for _ in range(6)] + ["short", ""]
    rows = [(i if i else None, "\n".join(rng.choice(common).upper() if rng.random() < 0.2 else f" {rng.choice(common)}\t" if rng.random() < 0.6 else prose(rng, 8) for _ in range(rng.randrange(0, 12))), "en", "s", 0) for i in range(60)]
    rows += [(1, rows[1][1], "en", "s", 0), (61, "\n".join([common[0]] * 5), "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, lines.dedup_lines(frame).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == brute_lines([(r[0], r[1]) for r in rows])
    out = lines.dedup_lines(awkward)
    assert out.count() == len(AWKWARD) and set(out.columns) == set(awkward.columns) | {"n_dropped"}
    assert lines.dedup_lines(nothing).count() == 0


# --- 5 ---


def test_quality_counts(spark, awkward, nothing):
    rng = random.Random(9)
    small = WORDS[:12]
    texts = [r[1] for r in AWKWARD] + ["".join(rng.choice(small) + rng.choice([" ", "  ", "\n", " ## ", "\t\n", " | "]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    space = " \t\n\x0b\x0c\r"
    for r in quality_rules.measure_quality(frame).collect():
        t = r.text or ""
        w = [x.decode() for x in t.encode().split()]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        with_word = [x for x in t.split("\n") if x.strip(space)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(with_word) - len(set(with_word)), len(covered)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.kept or not r.base_failed)
    out = quality_rules.measure_quality(awkward)
    assert out.count() == len(AWKWARD) and not [r for r in out.collect() if r.kept]
    assert quality_rules.keep_good(awkward).columns == awkward.columns and quality_rules.measure_quality(nothing).count() == 0


def test_quality_verdicts_follow_labels(spark, folder):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.measure_quality(docs).join(labels, "doc_id").where("n_words >= 50")
    right = judged.where("kept = (quality = 1)").count() / judged.count()
    assert right > 0.97


# --- 6, 7 ---


def rank_accuracy(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    usable = ~toxicity.held_out(labels["doc_id"])
    rows = toxicity.score_toxicity(docs, labels, usable).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert rank_accuracy([(r.score, known[r.doc_id]) for r in held]) > 0.9 and rank_accuracy([((r.score, r.margin), known[r.doc_id]) for r in held]) > 0.9


def test_toxicity_does_not_see_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score_toxicity(docs, x, ~toxicity.held_out(x["doc_id"])).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_features():
    read = toxicity.Reader({"grault": 3.0, "wald*": 2.0})
    names = dict(zip(toxicity.FEATURES, read("You grault! waldo w4ldo gr@ult and then some"), strict=True))
    assert names["near_second_person"] > 0 and names["disguised_hits"] == 2.0 and names["distinct_hits"] == 4.0
    assert read(None) == read("") == [0.0] * len(toxicity.FEATURES)


def test_classifiers_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for which in (labels, labels.where("false"), labels.where("doc_id = 1")):
        assert toxicity.score_toxicity(awkward, which, F.lit(True)).count() == len(AWKWARD)
        assert site_quality.score_quality(awkward, which, host=F.col("source"), path=F.col("lang")).count() == len(AWKWARD)
    assert toxicity.score_toxicity(nothing, labels, F.lit(True)).count() == 0
    assert site_quality.score_quality(nothing, labels, host=F.col("source"), path=F.col("lang")).count() == 0


def test_site_quality(spark):
    docs, labels, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels", "pages"))
    rows = site_quality.score_quality(docs, labels, host=F.col("source"), path=F.col("lang"), sites=site_quality.sites_of_pages(pages)).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and rank_accuracy([(r.score, known[r.doc_id]) for r in rows if r.doc_id in known]) > 0.97
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    unseen = site_quality.score_quality(docs, labels, host=F.col("source"), path=F.col("lang"), usable=~toxicity.held_out(labels["doc_id"])).collect()
    assert rank_accuracy([(r.score, known[r.doc_id]) for r in unseen if r.doc_id in known and held(r.doc_id)]) > 0.95
    # Posteriors by brute force: sums and sizes of hosts and paths, strengths by moments, each document's own part left out.
    mean = sum(r.evidence for r in rows) / len(rows)

    def strength(groups):
        """groups: (s, n, m)."""
        total = sum(n for _, n, _ in groups)
        spread, noise = sum(n * (s / n - m) ** 2 for s, n, m in groups) / total, sum(m * (1 - m) for *_, m in groups) / total
        return min(max(sum(n * m * (1 - m) for _, n, m in groups) / total / max(spread - noise, 1e-6) - 1, 1.0), 1e4)

    sums = defaultdict(lambda: [0.0, 0])
    for r in rows:
        for key in ((r.host,), (r.host, r.path)):
            sums[key][0] += r.evidence
            sums[key][1] += 1
    k_host = strength([(*v, mean) for k, v in sums.items() if len(k) == 1])
    host_of = {k[0]: (k_host * mean + v[0]) / (k_host + v[1]) for k, v in sums.items() if len(k) == 1}
    k_path = strength([(*v, host_of[k[0]]) for k, v in sums.items() if len(k) == 2])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in rows:
        s_, n_ = sums[r.host, r.path]
        others = (k_path * host_of[r.host] + max(s_ - r.evidence, 0.0)) / (k_path + n_ - 1)
        assert r.host_posterior == pytest.approx(host_of[r.host]) and r.path_posterior == pytest.approx((k_path * host_of[r.host] + s_) / (k_path + n_))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(logit(r.evidence) + logit(others) - logit(mean)))))
    hosts = defaultdict(list)
    for r in rows:
        hosts[r.host].append(r)
    for host in hosts.values():  # a host's posterior lies between its own mean and the global one
        own = sum(r.evidence for r in host) / len(host)
        assert min(own, mean) - 1e-9 <= host[0].host_posterior <= max(own, mean) + 1e-9


# --- 8 ---

EVIL = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 zz"
PAGES = [
    (1, "http://a", "hello"), (2, "http://b", EVIL), (3, None, None), (4, "u", "hello"), (5, "u", ""), (6, "é", "éWARC/1."), (7, "q\r\nContent-Length: 5", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (8, "v", EVIL), (9, "big", "<p>WARC/1.1</p>\r\n\r\n" * 40),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "211", "101"])
def test_warc_round_trip(spark, tmp_path, split):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    warc.write_warc(frame, str(tmp_path / "w"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = warc.pages_of(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}
    largest = {}
    for id_, _, html in PAGES:
        largest[html or ""] = id_
    want = {i: (len((h or "").encode()), digest(h), *(("response", None) if largest[h or ""] == i else ("revisit", largest[h or ""]))) for i, _, h in PAGES}
    assert len(rows) == len(PAGES) and got == want


def test_warc_awkward(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string, file string, start int")
    warc.write_warc(none, str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    twice = spark.createDataFrame([(1, "u", "x", "f", 1), (1, "u", "x", "f", 1), (None, "u", "x", "f", 1)], "page_id long, url string, html string, file string, start int")
    warc.write_warc(twice, str(tmp_path / "t"))
    got = sorted((repr(r.page_id), r.record_type, r.refers_to) for r in warc.pages_of(warc.read_warc(spark, str(tmp_path / "t"))).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "revisit", 1)]


def test_warc_revisit_without_its_response_stays(spark, tmp_path):
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\n%sContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.warc").write_bytes(head % (b"revisit", 1, b"WARC-Refers-To: <urn:page:9>\r\n", 19, b"") + head % (b"response", 2, b"", 20, b"x"))
    rows = warc.pages_of(warc.read_warc(spark, str(tmp_path / "r"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows) == [(1, "revisit", 9, None), (2, "response", None, 1)]


def test_warc_cut_off_file(spark, tmp_path):
    whole = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 6\r\n\r\nab\r\n\r\n\r\n\r\n" % i for i in range(3))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc").write_bytes(whole[:-9])
    assert sorted(r.record_id for r in warc.read_warc(spark, str(tmp_path / "c")).collect()) == ["<urn:page:0>", "<urn:page:1>"]


# --- 9 ---


def mixed_edits(rng, tokens, n):
    """n of the words replaced, left out or followed by another one."""
    chosen, out = set(rng.sample(range(len(tokens)), n)), []
    for i, w in enumerate(tokens):
        kind = rng.randrange(3) if i in chosen else 3
        out += [] if kind == 1 else [rng.choice(WORDS)] if kind == 0 else [w]
        out += [rng.choice(WORDS)] if kind == 2 else []
    return out


def test_decontamination(spark, awkward, nothing):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.randrange(10, 60)).capitalize() + ".") for i in range(60)]
    rows, want = [], set()
    for i, text in items:
        w = text.lower().strip(".").split()
        for k, rate in enumerate((0, 0.05, 0.1, 0.15, 0.2)):
            rows.append((i * 10 + k, f"{prose(rng, 30)}\n{' '.join(mixed_edits(rng, w, int(rate * len(w)))).upper()}, {prose(rng, 30)}", "en", "s", 0))
            want.add((i * 10 + k, i))
    rows += [(5000 + k, prose(rng, 100), "en", "s", 0) for k in range(100)] + [(6000, None, None, None, None), (6001, "", None, None, None), (None, items[3][1], None, None, None)]
    rows += [(6002, f"{prose(rng, 40_000)} {items[5][1]} {prose(rng, 40_000)}", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame([*items, (777, None), (778, ""), (779, "?!")], "item_id long, text string")
    found = decontaminate.find_contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert not {d for d, _ in got if d is not None and 5000 <= d < 6002} and {(None, 3), (6002, 5)} <= got
    assert len(want & got) >= 0.98 * len(want) and {(i * 10, i) for i, _ in items} <= got
    # Every row found is one by brute force: some part of the document lies within the budget.
    held = {r[0]: decontaminate.split_words(r[1]) for r in rows}
    for r in found:
        assert r.distance <= 0.2 * r.item_words + 1e-9
        assert brute_edits(decontaminate.split_words(dict(items)[r.item_id]), held[r.doc_id][r.start : r.end]) == r.distance
    small = decontaminate.Settings(block_items=7)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, benchmark, settings=small).collect()} == got
    left = {r[0] for r in rows} - {d for d, _ in got}
    for settings in (small, decontaminate.Settings()):
        clean = decontaminate.drop_contaminated(docs, benchmark, settings=settings)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == left
    assert decontaminate.find_contaminated(nothing, benchmark).count() == 0 and decontaminate.drop_contaminated(nothing, benchmark).count() == 0
    assert decontaminate.find_contaminated(docs, benchmark.where("false")).count() == 0
    odd = awkward.withColumns({c: F.lit(1) for c in ("item_id", "start", "end", "distance", "item", "item_words")})
    assert decontaminate.find_contaminated(odd, benchmark).columns == ["doc_id", "item_id", "distance", "item_words", "start", "end"]
    assert decontaminate.find_contaminated(odd, spark.createDataFrame([(1, "one two")], "item_id long, text string")).count() == 3
    assert decontaminate.drop_contaminated(odd, benchmark).columns == odd.columns and decontaminate.drop_contaminated(odd, benchmark).count() == len(AWKWARD)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        row = out
    return row[-1]


def test_windows_have_the_size_of_their_items():
    index = decontaminate.Index([("a", "one two three four five six seven"), ("b", "x")], decontaminate.Settings())
    assert index.lengths.tolist() == [1, 7] and all(w.sizes.tolist() == [1, 7] for w in index.walks)
    assert [[m["item"] for m in found] for found in index.search(["zero one two three four five six seven eight", "y X z", None, "one two tree four five six seven"])] == [["a"], ["b"], [], ["a"]]


# --- 10 ---

TINY = lm.Settings(lexicon=60, own=1.0, shared=0.5, states=3, rounds=4, gain=0.0, stretch=1.0)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = lm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    for n in range(1, 6):
        total = 0.0
        for code in range(3**n):
            seq = np.array([code // 3**i % 3 for i in range(n)])
            paths = sum(
                model.start[p & 1] * model.emit[p & 1, seq[0]] * math.prod(model.move[p >> t - 1 & 1, p >> t & 1] * model.emit[p >> t & 1, seq[t]] for t in range(1, n)) for p in range(2**n)
            )
            assert lm.forward_log10(model, [seq, seq])[0] == pytest.approx(math.log10(paths))
            total += paths
        assert total == pytest.approx(1)


def brute_counts(model, seq):
    """Starts, moves, emissions and log10 probability of one sequence, step by step without batches or blocks."""
    k, n = model.emit.shape
    alpha, beta = np.zeros((len(seq), k)), np.ones((len(seq), k))
    log = 0.0
    for t, x in enumerate(seq):
        a = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[:, x]
        alpha[t], log = a / a.sum(), log + math.log10(a.sum())
    for t in range(len(seq) - 2, -1, -1):
        b = model.move @ (model.emit[:, seq[t + 1]] * beta[t + 1])
        beta[t] = b / b.sum()
    move, emit = np.zeros((k, k)), np.zeros((k, n))
    for t, x in enumerate(seq):
        p = alpha[t] * beta[t]
        emit[:, x] += p / p.sum()
        if t:
            m = np.outer(alpha[t - 1], model.emit[:, x] * beta[t]) * model.move
            move += m / m.sum()
    p = alpha[0] * beta[0]
    return p / p.sum(), move, emit, log


@pytest.mark.parametrize("block", [1, 7, 1024, 10**9])
def test_expected_counts_of_whole_sequences(block):
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = lm.Hmm(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 6))))
    seqs = [rng.integers(0, 6, n) for n in (5000, 1, 40, 40, 7, 8, 1025)]
    got, log = lm.expected_counts(model, seqs, block)
    want = [sum(x) for x in zip(*(brute_counts(model, s) for s in seqs), strict=True)]
    assert np.allclose(got.start, want[0]) and np.allclose(got.move, want[1]) and np.allclose(got.emit, want[2]) and log == pytest.approx(want[3])
    assert lm.forward_log10(model, seqs).sum() == pytest.approx(log)


def test_baum_welch_never_gets_worse():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 5, rng.integers(1, 30)) if i % 2 else rng.integers(3, 8, rng.integers(1, 30)) for i in range(60)]
    base = np.full(8, 1 / 8)
    model, last = lm.starting_point(base, TINY), -np.inf
    for _ in range(8):
        counts, now = lm.expected_counts(model, seqs)
        assert now >= last - 1e-6
        last = now
        assert counts.emit.sum() == pytest.approx(sum(map(len, seqs))) and counts.start.sum() == pytest.approx(len(seqs)) and counts.move.sum() == pytest.approx(sum(len(s) - 1 for s in seqs))
        model = lm.updated(counts, base, 0.0)


def test_lm_score_is_that_of_a_brute_force_model(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randrange(0, 40)), "en", "s", 0) for i in range(60)]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 45, settings=TINY).collect()}
    texts = {r[0]: [*words(r[1]), b" "] for r in rows}
    counts = Counter(w for i, t in texts.items() if i < 45 for w in t)
    c = TINY.classes(len(counts))
    ranked = sorted((w for w in counts if w != b" "), key=lambda w: (-counts[w], w))
    # Words go to the lexicon by whole levels of their counts.
    level = lambda w: math.floor(math.log2(counts[w]) * 16)
    lexicon = [w for w in ranked if sum(level(x) >= level(w) for x in ranked) <= TINY.lexicon]
    own = {w: i for i, w in enumerate(lexicon[: c.own])} | {b" ": c.n - 1}
    class_of = lambda w: own.get(w, c.own + zlib.crc32(w) % c.shared)
    size, types = Counter(), Counter()
    for w, n in counts.items():
        size[class_of(w)] += n
        types[class_of(w)] += 1
    base = np.array([size[k] + 1 for k in range(c.n)], float)
    base /= base.sum()
    model = lm.starting_point(base, TINY)
    for _ in range(TINY.rounds):
        parts = [brute_counts(model, [class_of(w) for w in t]) for i, t in texts.items() if i < 45]
        start, move, emit, _ = (sum(x) for x in zip(*parts, strict=True))
        model = lm.updated(lm.Hmm(start, move, emit), base, TINY.prior)
    for i, t in texts.items():
        inside = sum(math.log10((counts[w] + 1) / (size[class_of(w)] + types[class_of(w)] + 1)) for w in t if w not in own)
        assert got[i] == pytest.approx(brute_counts(model, [class_of(w) for w in t])[3] + inside), i


def test_lm_scores(spark, awkward, nothing):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(0, 60)), "en", "s", 0) for i in range(120)] + [r for r in AWKWARD if r[0] != 6][:6]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lm.score_texts(docs, lm.training_rows(F.col("doc_id")), settings=TINY).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*words(r[1]), b" "])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = [*words(r[1]), b" "]
        want[(r[0], held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(awkward, F.lit(True), settings=TINY).count() == len(AWKWARD)
    assert lm.score_texts(awkward, F.lit(False), settings=TINY).count() == len(AWKWARD)
    assert lm.score_texts(nothing, F.lit(True), settings=TINY).count() == 0


def test_lm_is_a_distribution(spark):
    """All one-word texts over the vocabulary, an unknown word of each class, and no word: probabilities of what may come first sum to one."""
    rng = random.Random(12)
    train = [(i, prose(rng, 20), "en", "s", 0) for i in range(40)]
    seen = {w for r in train for w in words(r[1])}
    unknown = {}
    for k in range(10_000):
        unknown.setdefault(zlib.crc32(f"zz{k}".encode()) % TINY.classes(len(seen) + 1).shared, f"zz{k}")
    probes = sorted(w.decode() for w in seen) + list(unknown.values())
    rows = train + [(1000 + i, w, "en", "s", 0) for i, w in enumerate(probes)] + [(5000, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    scores = {r.doc_id: r.score for r in lm.score_texts(docs, F.col("doc_id") < 1000, settings=TINY).collect() if r.doc_id >= 1000}
    # P(w, end) summed over w is P(the second token is the end); with P(end) first it stays below one.
    assert sum(10 ** s for s in scores.values()) < 1 + 1e-6


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score_texts(docs, lm.training_rows(F.col("doc_id"))).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
