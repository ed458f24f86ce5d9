"""Spans, tokens and windows: properties that hold for any text."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mistveil.functions.spans import pattern_spans, piece
from mistveil.operators import detect as D
from mistveil.operators import tokens as T
from mistveil.operators.known import known_values
from mistveil.operators.windows import merge_windows, window_texts
from mistveil.plans.literals import CANARIES


def crafted(n, seed, between=("", " ", "-", ", ")):
    rng = random.Random(seed)
    parts = [r[2] for r in CANARIES.rows] + ["a@b", "x" * 30, "1234 5678 9012 3456", "😀", "é", " ", "\n", "and", "::"]
    return ["".join(rng.choice(parts) + rng.choice(between) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


def test_spans_do_not_overlap_and_are_sorted(spark):
    rows = spark.createDataFrame([(t,) for t in crafted(200, 1)], "text string").select("text", pattern_spans(F.col("text")).alias("s")).collect()
    for r in rows:
        ends = [(s["start"], s["end"]) for s in r["s"]]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and all(0 <= a < b <= len(r.text) for a, b in ends)


def units(spark, texts):
    rows = [(f"s{i % 7}", f"https://o{i % 3}.example", i, t) for i, t in enumerate(texts)]
    return D.with_spans(spark.createDataFrame(rows, "session_id string, origin string, unit int, text string"))


def test_rewrite_hides_all_and_resolve_brings_back(spark):
    # Texts where identifiers touch may show new ones once their neighbours are replaced: the final guard is for those.
    frame = units(spark, crafted(120, 2, (" ; ",)))
    found = T.occurrences(frame)
    tokens = T.token_map(found).cache()
    clean = T.rewrite(frame, found, tokens)
    assert clean.count() == 120
    left = clean.select(F.explode(pattern_spans(F.col("text"))).alias("s")).where("s.type <> 'EMAIL'")
    assert left.count() == 0
    exact = tokens.groupBy("session_id", "token").count()
    assert exact.where("count > 1").count() == 0
    back = T.resolve(clean.select("session_id", F.col("unit").alias("id"), "text"), tokens)
    got = {r.id: r.text.lower() for r in back.collect()}
    assert got == {r.unit: r.text.lower() for r in frame.select("unit", "text").collect()}


def test_numbering_does_not_depend_on_partitions(spark):
    frame = units(spark, crafted(80, 3))
    maps = [sorted(map(tuple, T.token_map(T.occurrences(frame.repartition(n))).select("session_id", "origin", "type", "norm", "token", "value").collect())) for n in (1, 5)]
    assert maps[0] == maps[1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_windows_merge_back(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    windows = window_texts(F.col("text"), 20, 5)
    assert all(r.text == r.m for r in frame.select("text", merge_windows(windows, 5).alias("m")).collect())


VALUES = "session_id string, origin string, type string, value string"
UNITS = "session_id string, origin string, unit int, text string"


def places(spark, text, known):
    """Spans of known values in one text."""
    units_ = spark.createDataFrame([("s", "o", 1, text)], UNITS)
    found = known_values(units_, spark.createDataFrame([("s", "o", k, v) for k, v in known], VALUES)).first().known
    return [(s["type"], s["start"], s["end"]) for s in found]


def test_known_values(spark):
    known = [("NAME", "Priya"), ("NAME", " Priya Sharma "), ("NAME", "Al")]
    text = "priya sharma met Priya, not Priyanka; [PII_NAME_1] Priya"
    assert places(spark, text, known) == [("NAME", 0, 12), ("NAME", 17, 22), ("NAME", 51, 56)]


def test_known_values_of_any_shape(spark):
    assert places(spark, "a (x.y) é.(x.y) (x.y)z É", [("OTHER", "(x.y)"), ("NAME", "ééé")]) == [("OTHER", 2, 7), ("OTHER", 10, 15)]
    assert places(spark, "call +91 98765 now, 98765", [("PHONE", "+91 98765")]) == [("PHONE", 5, 14)]
    assert places(spark, "\\Q a\\Eb \\E", [("OTHER", "a\\Eb")]) == [("OTHER", 3, 7)]
    assert places(spark, "pass *** end", [("OTHER", "***")]) == [("OTHER", 5, 8)]
    assert places(spark, "ÄRGER ärger", [("NAME", "Ärger")]) == [("NAME", 0, 5), ("NAME", 6, 11)]
    assert places(spark, "ann lee ann", [("B", "ann"), ("A", "ann")]) == [("A", 0, 3), ("A", 8, 11)]


def test_known_values_join(spark):
    frame = spark.createDataFrame([("s", "o", 1, "met Priya"), ("s", "p", 2, "met Priya"), ("t", "o", 3, None), (None, None, 4, "Priya"), ("s", "o", 0, "Priya")], UNITS)
    tokens = spark.createDataFrame([("s", "o", "NAME", "Priya"), (None, None, "NAME", "priya")], VALUES)
    assert {r.unit: len(r.known) for r in known_values(frame, tokens).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}
    since = tokens.withColumn("first", F.struct(F.lit(0).alias("unit"), F.lit(0).alias("start")))
    assert {r.unit: len(r.known) for r in known_values(frame, since).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}


def test_no_value_goes_to_all_units_of_its_session(spark):
    """A session of many values and texts: rows that meet are those that share a first word."""
    values = spark.createDataFrame([("s", "o", "NAME", f"name{i} x") for i in range(300)], VALUES)
    frame = spark.createDataFrame([("s", "o", i, f"some words and name{i} x") for i in range(300)], UNITS)
    out = known_values(frame, values)
    assert out.where("size(known) = 1").count() == 300
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in out._jdf.queryExecution().toString()


def test_sanitize_masks_what_the_session_knows(spark):
    """A value tokenized out of a link is masked in later texts; the tagger's names are known afterwards, also where it misses them."""

    def tag(texts):
        return [[("NAME", t.index("Ram Rao"), t.index("Ram Rao") + 7)] if t.startswith("I am Ram Rao") else [] for t in texts]

    rows = [
        ("s", "o", 0, "text", "I am Ram Rao"), ("s", "o", 1, "href", "https://o.example/?token=tok123&n=1"), ("s", "o", 2, "text", "TOK123 and ram rao, Ram"), ("s", "o", 3, "text", "tok1234"), ("t", "o", 4, "text", "ram rao"), ("s", "o", 5, "value", "ram rao"),
        ("s", "o", 6, "href", "https://o.example/%zz?token=tok123"), ("s", "o", 7, "text", None),
    ]
    frame = spark.createDataFrame(rows, "session_id string, origin string, unit int, field string, text string")
    clean, tokens = T.sanitize(frame, D.tagger(tag))
    got = {r.unit: (r.text, r.failed) for r in clean.collect()}
    assert got[0] == ("I am [PII_NAME_1]", False) and got[2] == ("[PII_OTHER_1] and [PII_NAME_1], Ram", False) and got[3] == ("tok1234", False)
    assert got[4] == ("ram rao", False) and got[5] == ("[PII_NAME_1]", False) and got[6] == (None, True) and got[7] == (None, False)
    assert {r.token for r in tokens.collect()} == {"[PII_NAME_1]", "[PII_OTHER_1]"}


def test_failing_tagger_withholds_its_texts_only(spark):
    def tag(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no model")
        return [[] for _ in texts]

    rows = [("s", "o", 0, "text", "fine a@b.example"), ("s", "o", 1, "text", "bad text"), ("s", "o", 2, "text", "")]
    frame = spark.createDataFrame(rows, "session_id string, origin string, unit int, field string, text string")
    got = {r.unit: (r.text, r.failed) for r in T.sanitize(frame, D.tagger(tag))[0].collect()}
    assert got == {0: ("fine [PII_EMAIL_1]", False), 1: (None, True), 2: ("", False)}


def test_align():
    pieces = [("B-NAME", "Pri", 0.9), ("I-NAME", "##ya", 0.8), ("O", "met", 0.9), ("B-NAME", "zzz", 0.1), ("B-NAME", "Ram", 0.7)]
    assert D.align_tokens("Priya met  Ram", pieces) == [("B-NAME", 0.9, 0, 3), ("I-NAME", 0.8, 3, 5), ("O", 0.9, 6, 9), ("B-NAME", 0.7, 11, 14)]


def test_tagger_sees_no_pattern_hits(spark):
    def tag(texts):
        assert not any("okaxis" in t for t in texts)
        return [[("NAME", t.index("Ram"), t.index("Ram") + 3)] if "Ram" in t else [] for t in texts]

    frame = spark.createDataFrame([("https://x.example", "priya.sharma@okaxis pays Ram"), ("https://x.example", "none")], "origin string, text string")
    rows = D.with_spans(frame, D.tagger(tag)).select("text", F.transform("spans", lambda s: piece(F.col("text"), s)).alias("v")).collect()
    assert sorted(r.v for r in rows) == [[], ["priya.sharma@okaxis", "Ram"]]


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "text string").select(F.size(pattern_spans(F.col("text"))).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0]
