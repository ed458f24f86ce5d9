"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random

from mistveil.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def text_of(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_near_copies_at_jaccard_of_at_least_08_go(spark):
    rng, texts = random.Random(20), []
    for _ in range(40):
        base = text_of(rng, rng.randrange(60, 200))
        texts.append(base)
        for changed in (1, 2, 3, 5):
            other = list(base)
            for at in rng.sample(range(len(base)), changed):
                other[at] = "other"
            texts.append(other)
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any((simhash.fingerprint_of(texts[a], 5) ^ simhash.fingerprint_of(texts[b], 5)).bit_count() > 8 for a, b in links)
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in simhash.near_dedup(frame).collect()} == {i for i, g in enumerate(group) if i == g}


def test_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(21)
    a, b, c, d, e = (" ".join(text_of(rng, 80)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, e), (2, e), (3, e), (None, None), (4, "")]
    frame = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], SCHEMA)
    kept = simhash.near_dedup(frame)
    assert kept.columns == frame.columns
    got = sorted((repr(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted((repr(i), t) for i, t in [(1, a), (None, b), (None, c), (2, d), (2, e), (4, "")])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_a_large_group_of_near_copies_loses_no_group(spark):
    """Copies that differ from one base more and more: what stays are the smallest ids of the components, as by brute force."""
    rng = random.Random(22)
    base = text_of(rng, 150)
    texts = [base]
    for k in range(500):
        other = list(base)
        for at in rng.sample(range(len(base)), 1 + k % 6):
            other[at] = f"x{rng.randrange(10**6)}"
        texts.append(other)
    texts = [" ".join(t) for t in texts] + [" ".join(text_of(rng, 100)) for _ in range(500)]
    rng.shuffle(texts)
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                group[max(a_, b_)] = min(a_, b_)
    want = {find(i) for i in range(len(texts))}
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in simhash.near_dedup(frame).collect()}
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


def test_chance_that_texts_at_the_similarity_meet(spark):
    rng, met, n = random.Random(23), 0, 400
    ring = simhash.Ring.of(2_000_000, 0.8, 0.98)
    signs = lambda x: [b for v in x for b in f"{int(v) & (2**64 - 1):064b}"]
    for _ in range(n):
        base = text_of(rng, 300)
        other = list(base)
        at = rng.randrange(60)
        while jaccard(shingles(" ".join(base)), shingles(" ".join(other))) > 0.81:
            other[at] = f"y{at}"
            at += 37 if at + 37 < 300 else 38 - 300
        a, b = (signs(simhash.wide_print(simhash.shingle_set(" ".join(t), 5))) for t in (base, other))
        starts = [i * simhash.WIDE // ring.places for i in range(ring.places)]
        equal = any(all(a[(s + k) % simhash.WIDE] == b[(s + k) % simhash.WIDE] for k in range(ring.bits)) for s in starts)
        met += equal and sum(x != y for x, y in zip(a, b, strict=True)) <= ring.budget(simhash.WIDE)
    assert met >= 0.9 * n
