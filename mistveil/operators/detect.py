"""From pattern and tagger spans to what counts as personal data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import is_public
from ..functions.patterns import PII_TYPES, PLACEHOLDER
from ..functions.spans import SPAN, by_start, claim, hits, overlap, pattern_spans, piece

#: Labels of a tagger and the types they stand for; None: not personal.
LABELS = {
    "PERSON": "NAME", "LOCATION": "ADDRESS", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "CREDIT_CARD": "CARD", "US_PASSPORT": "PASSPORT", "ORGANIZATION": None,
    **dict.fromkeys(("DATE_TIME", "AGE", "COORDINATE", "FINANCIAL", "HONORIFIC", "IBAN_CODE", "IMEI", "IP_ADDRESS", "MAC_ADDRESS", "NRP", "PASSWORD", "TITLE", "URL", "US_BANK_NUMBER", "US_DRIVER_LICENSE", "US_ITIN", "US_LICENSE_PLATE", "US_SSN"), "OTHER"),
}

#: Scores from which a detection counts as high and as medium.
BUCKETS = {"ner": (0.85, 0.60), "face": (0.75, 0.50), "ocr": (85.0, 60.0)}


def label_type(label: Column) -> Column:
    """The type of a tagger's label; null for labels that are not personal, OTHER for unknown ones."""
    out = F.when(label.isin(*[k for k, v in LABELS.items() if v is None]), F.lit(None).cast("string"))
    for kind in sorted({v for v in LABELS.values() if v and v != "OTHER"}):
        out = out.when(label.isin(*[k for k, v in LABELS.items() if v == kind]), kind)
    return out.otherwise("OTHER")


def bucket(score: Column, detector: str) -> Column:
    """high, medium or low; scores that are no numbers are low."""
    high, medium = BUCKETS[detector]
    sound = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(sound & (score >= high), "high").when(sound & (score >= medium), "medium").otherwise("low")


def no_tags(text: Column) -> Column:
    """The tagger that finds nothing."""
    return F.array().cast(f"array<{SPAN}>")


def tagger(function):
    """A column function from a Python function list[str] -> list[list[(type, start, end)]], called once an Arrow batch.

    If it fails, each text of the batch is tried alone; those on which it
    fails again get null, and what they stand in is withheld.
    """

    def each(texts: list[str]) -> list:
        try:
            return function(texts)
        except Exception:  # noqa: BLE001  a tagger may fail in any way
            return [None] if len(texts) == 1 else [found for t in texts for found in each([t])]

    @F.pandas_udf(f"array<{SPAN}>")
    def tag(texts: pd.Series) -> pd.Series:
        found = each([t or "" for t in texts])
        return pd.Series([None if spans is None else [{"type": k, "start": s, "end": e} for k, s, e in spans] for spans in found], dtype=object)

    return tag


def masked(text: Column, spans: Column) -> Column:
    """(text with spans as [PII_<TYPE>], where each of those stands and stood): what a tagger gets to see."""
    part = "array<struct<start:int,end:int,from:int,to:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(part).alias("places"))

    def step(acc: Column, s: Column) -> Column:
        lead = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        mark = F.concat(F.lit("[PII_"), s["type"], F.lit("]"))
        place = F.struct(F.length(lead).alias("start"), (F.length(lead) + F.length(mark)).alias("end"), s["start"].alias("from"), s["end"].alias("to"))
        return F.struct(s["end"].alias("at"), F.concat(lead, mark).alias("out"), F.array_append(acc["places"], place).alias("places"))

    folded = F.aggregate(spans, start, step)
    return F.transform(F.array(folded), lambda r: F.struct(F.concat(r["out"], F.substring(text, r["at"] + 1, F.length(text))).alias("text"), r["places"].alias("places")))[0]


def unmasked(tags: Column, places: Column) -> Column:
    """Tagger spans over a masked text, moved back to the text; those that touch a mask are dropped."""
    free = F.filter(tags, lambda t: ~F.exists(places, lambda p: overlap(t, p)))

    def moved(t: Column) -> Column:
        earlier = F.filter(places, lambda p: p["end"] <= t["start"])
        shift = F.aggregate(earlier, F.lit(0), lambda a, p: a + (p["to"] - p["from"]) - (p["end"] - p["start"]))
        return F.struct(t["type"].alias("type"), (t["start"] + shift).alias("start"), (t["end"] + shift).alias("end"))

    return F.transform(free, moved)


def decide(text: Column, found: Column, tags: Column, origin: Column, hints: Column | None = None, is_mailto: Column | None = None) -> Column:
    """Pattern spans and those tagger spans that overlap nothing before them, less public e-mail addresses, by start.

    Overlaps are settled before public addresses go, so a public address
    still keeps a tagger span on it out. Unknown labels count as OTHER.
    """
    typed = F.transform(tags, lambda t: F.struct(F.when(t["type"].isin(*PII_TYPES), t["type"]).otherwise("OTHER").alias("type"), t["start"].alias("start"), t["end"].alias("end")))
    kept = claim(typed, found)
    return by_start(F.filter(kept, lambda s: (s["type"] != "EMAIL") | ~is_public(piece(text, s), origin, hints, is_mailto)))


def with_spans(units: DataFrame, tag=no_tags) -> DataFrame:
    """units (text, origin, and hints, is_mailto and known if they are there) with decided spans in column spans.

    known, spans of values that the session has seen, come first: patterns and
    tags that overlap them fall away, and public addresses among them stay
    spans. Equal texts in equal contexts are tagged once only where a tagger
    is given; the tagger sees hits masked. spans is null where the tagger
    failed. patterns, if there, holds what the patterns find in each text.
    """
    hints = F.col("hints") if "hints" in units.columns else None
    mailto = F.col("is_mailto") if "is_mailto" in units.columns else None
    known = F.col("known") if "known" in units.columns else None
    text = F.col("text")

    def decided(tags: Column) -> Column:
        own = decide(text, F.col("_found"), tags, F.col("origin"), hints, mailto)
        return own if known is None else by_start(F.concat(known, own))

    hit = F.col("patterns") if "patterns" in units.columns else pattern_spans(text)
    free = hit if known is None else F.filter(hit, lambda s: ~F.exists(known, lambda k: overlap(s, k)))
    found = units.withColumn("_found", free)
    if tag is no_tags:
        return found.withColumn("spans", decided(no_tags(text))).drop("_found")
    covered = found.withColumn("_mask", masked(text, F.col("_found") if known is None else by_start(F.concat(known, "_found"))))
    shown = covered.select(F.col("_mask.text").alias("_shown")).distinct()
    tagged = shown.withColumn("_tags", tag(F.col("_shown")))
    both = covered.withColumn("_shown", F.col("_mask.text")).join(tagged.hint("merge"), "_shown", "left")
    tags = unmasked(F.when(text.isNull(), no_tags(text)).otherwise(F.col("_tags")), F.col("_mask.places"))
    return both.withColumn("spans", decided(tags)).drop("_found", "_mask", "_shown", "_tags")


def align_tokens(text: str, pieces: list[tuple[str, str, float]]) -> list[tuple[str, float, int, int]]:
    """Places of a tagger's word pieces (entity, word, score): "##" goes on at once, others within 32 characters; lost pieces are dropped."""
    at, lowered, out = 0, text.lower(), []
    for entity, word, score in pieces:
        going_on = word.startswith("##")
        bare = word[2:] if going_on else word
        reach = at + len(bare) + (0 if going_on else 32)
        start = lowered.find(bare.lower(), at, reach) if bare else -1
        if start >= 0:
            at = start + len(bare)
            out.append((entity, score, start, at))
    return out


def aligned_tokens(text: Column, pieces: Column) -> Column:
    """align_tokens() as a column: pieces is an array of (entity, word, score); the result has (entity, score, start, end). Null texts and pieces have none."""

    @F.pandas_udf("array<struct<entity:string,score:double,start:int,end:int>>")
    def align(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, found, strict=True):
            placed = [] if t is None or p is None else align_tokens(t, [(x["entity"], x["word"] or "", x["score"]) for x in p])
            out.append([{"entity": e, "score": s, "start": a, "end": b} for e, s, a, b in placed])
        return pd.Series(out)

    return align(text, pieces)


def group_entities(aligned: DataFrame) -> DataFrame:
    """BIO-tagged pieces (text_id, idx, entity, score, start, end) as entities: text_id, label, start, end, score (the mean).

    A piece starts an entity if it is tagged B or S, if its label differs from
    the piece before, or if that was O, S or E.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("text_id").orderBy("idx")
    label = F.regexp_replace("entity", "^[BIESU]-", "")
    mark = F.when(F.col("entity") == "O", "O").otherwise(F.regexp_extract("entity", "^([BIESU])-", 1))
    rows = aligned.withColumn("label", label).withColumn("mark", mark)
    before, ended = F.lag("label").over(order), F.lag("mark").over(order)
    starts = F.col("mark").isin("B", "S", "U") | before.isNull() | (before != F.col("label")) | ended.isin("O", "S", "E", "U")
    runs = rows.withColumn("run", F.sum(starts.cast("int")).over(order)).where("mark <> 'O'")
    grouped = runs.groupBy("text_id", "run").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"))
    return grouped.drop("run")


def residual_counts(texts: DataFrame, *, text: str = "text", origin: Column | None = None) -> DataFrame:
    """How many identifiers of each kind are left in texts; probable public addresses count as EMAIL_LIKELY_PUBLIC. No values."""
    from .residuals import residual_kind

    rows = texts.select(F.col(text).alias("text"), (F.lit("") if origin is None else origin).alias("origin"), F.explode(pattern_spans(F.col(text))).alias("s"))
    return rows.groupBy(residual_kind(F.col("text"), F.col("s"), F.col("origin")).alias("kind")).agg(F.count("*").alias("n"))


def guard_triggered(texts: Column) -> Column:
    """Whether any text of an array still holds an identifier other than an e-mail address."""
    return F.exists(texts, lambda t: F.exists(pattern_spans(t), lambda s: s["type"] != "EMAIL"))


def secret_spans(text: Column) -> Column:
    """Placeholders in a text as spans: tokens and secrets."""
    return hits(text, PLACEHOLDER)
