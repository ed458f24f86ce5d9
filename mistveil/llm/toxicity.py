"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are rates: of terms from a fixed and a learned lexicon, of such
terms close to a second-person word, of capitals, punctuation and disguised
words. The learned lexicon holds words and word beginnings that mark toxic
texts in one half of a bounded sample of labelled rows; the trees and the
calibration learn from the other half.
"""

from __future__ import annotations

from math import log, log1p

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, id_crc, stored

#: Common insults.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "fool", "imbecile", "jerk", "retard", "bastard", "bitch", "whore", "slut", "crap", "asshole", "vermin", "filth")

#: Second-person words of English, French, German and Spanish.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "vous", "votre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "ti", "usted", "ustedes", "vosotros")

#: Signs that stand for letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, "+": None, "#": None}

FEATURES = ("hits", "weight", "log_hits", "most_in_window", "distinct_hits", "insults", "near_second_person", "capitals", "punctuation", "exclamations", "disguised", "disguised_hits", "log_words")
PREFIXES = (4, 5, 6, 7)
WINDOW, NEAR = 50, 5


def labelled_sample(labels: DataFrame, *, id: str, label: str, usable: Column, max_labels: int) -> DataFrame:
    """About max_labels rows id, label, half (0 or 1) at most, the same ones on each run; ids with several labels take the largest."""
    rows = labels.where(usable & F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_mv_id")).agg(F.max(label).cast("int").alias("_mv_label"))
    half = F.pmod(F.xxhash64(F.lit("half"), "_mv_id"), F.lit(2)).cast("int")
    return stored(hash_sample(rows, ["_mv_id"], max_labels).withColumn("_mv_half", half), "labelled")


def learn_lexicon(docs: DataFrame, sample: DataFrame, *, id: str, text: str, min_docs: int = 4, min_weight: float = 2.0, most: int = 5000) -> dict[str, float]:
    """Words, and word beginnings ending in "*", with their log odds of standing in toxic rather than other texts; at most `most`."""
    rows = docs.join(F.broadcast(sample.where("_mv_half = 0")), docs[id] == F.col("_mv_id")).select("_mv_label", F.lower(F.col(text)).alias("text"))
    found = rows.select("_mv_label", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    starts = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    terms = found.select("_mv_label", F.explode(F.array_compact(F.array("word", *starts))).alias("term"))
    toxic = F.sum(F.when(F.col("_mv_label") == 1, 1).otherwise(0))
    counts = terms.groupBy("term").agg(toxic.alias("p"), (F.count("*") - toxic).alias("n"))
    n_texts = {r["_mv_label"]: r["count"] for r in rows.groupBy("_mv_label").count().collect()}
    p, n = n_texts.get(1, 0), sum(c for k, c in n_texts.items() if k != 1)
    if not p or not n:
        return {}
    weight = F.log((F.col("p") + 0.5) / (F.col("n") + 0.5)) - log((p + 1) / (n + 1))
    best = counts.withColumn("weight", weight).where((F.col("p") >= min_docs) & (F.col("weight") >= min_weight))
    return {r.term: r.weight for r in best.orderBy(F.desc(F.col("weight") * F.log1p("p")), "term").limit(most).collect()}


class Reader:
    """Computes the features of texts for one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.insults, self.you = lexicon, frozenset(INSULTS), frozenset(SECOND_PERSON)
        self.plain = str.maketrans(DISGUISES)
        self.seen: dict[str, tuple | None] = {}
        self.upper, self.marks = bytes(range(65, 91)), bytes(x for x in range(33, 127) if not chr(x).isalnum())

    def weight(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) > n), 0.0)

    def look_up(self, token: str) -> tuple | None:
        """(weight, is an insult, is second person, disguised, hit only when undisguised); None for a plain word of no interest."""
        word = token.strip(".,;:!?\"'()[]{}|…-–&%$#*")
        disguised = bool(word) and not word.isalnum() or any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
        weight, insult, hidden = self.weight(word), word in self.insults, False
        if disguised and not weight:
            bare = word.translate(self.plain)
            weight, insult = self.weight(bare), bare in self.insults
            hidden = weight > 0 or insult
        out = (weight, insult, word in self.you, disguised, hidden)
        return out if any(out) else None

    def __call__(self, text: str | None) -> list[float]:
        tokens = (text or "").lower().split()
        if len(self.seen) > 300_000:
            self.seen.clear()
        seen, n = self.seen, max(len(tokens), 1)
        hits, weights, you, distinct = [], 0.0, [], set()
        insults = disguised = hidden = 0
        for at, token in enumerate(tokens):
            try:
                found = seen[token]
            except KeyError:
                found = seen[token] = self.look_up(token)
            if found is None:
                continue
            weight, insult, second, odd, masked = found
            if weight or insult:
                hits.append(at)
                distinct.add(token)
            weights += weight
            insults += insult
            disguised += odd
            hidden += masked
            if second:
                you.append(at)
        most = first = 0
        for last, at in enumerate(hits):
            while at - hits[first] >= WINDOW:
                first += 1
            most = max(most, last - first + 1)
        near = 0
        if hits and you:
            spots = np.array(you)
            next_ = np.searchsorted(spots, hits)
            after = np.abs(spots[np.minimum(next_, len(spots) - 1)] - hits)
            before = np.abs(spots[np.maximum(next_ - 1, 0)] - hits)
            near = int((np.minimum(after, before) <= NEAR).sum())
        raw = (text or "").encode("utf-8", "replace")
        size = max(len(raw), 1)
        return [
            len(hits) / n, weights / n, log1p(len(hits)), float(most), float(len(distinct)), insults / n, near / n,
            (len(raw) - len(raw.translate(None, self.upper))) / size, (len(raw) - len(raw.translate(None, self.marks))) / size, raw.count(b"!") / size,
            disguised / n, float(hidden), log1p(len(tokens)),
        ]


def features(docs: DataFrame, lexicon: dict[str, float], *, id: str, text: str) -> DataFrame:
    """id and its features as an array, for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(frames):
        reader = Reader(held.value)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "features": [reader(t) for t in frame["text"]]})

    return rows.mapInPandas(run, f"id {docs.schema[id].dataType.simpleString()}, features array<double>")


def centred(steps) -> list[tuple[float, float]]:
    """Points (margin, score) of centred isotonic regression: the middle of each step, and the ends (0, 0) and (1, 1), so that no two margins tie."""
    spans: dict[float, list[float]] = {}
    for at, score in zip(steps.boundaries.toArray().tolist(), steps.predictions.toArray().tolist(), strict=True):
        spans.setdefault(score, []).append(at)
    inner = [((min(at) + max(at)) / 2, score) for score, at in sorted(spans.items())]
    return [(0.0, 0.0), *[(x, y) for x, y in inner if 0 < x < 1], (1.0, 1.0)]


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, *, id: str = "doc_id", text: str = "text", label: str = "toxic", max_labels: int = 20_000, trees: int = 20, depth: int = 4, threshold: float = 0.7, seed: int = 5) -> DataFrame:
    """One row a row of docs: id, score, predicted, margin.

    usable: which rows of labels may be learned from; at most max_labels of
    them are: half for the lexicon, half for the trees. The calibration is
    fitted on margins that trees of either half of those give to the other
    half, so on rows they have not seen; it runs straight between the middles
    of its steps. margin is the trees' own probability. Empty and null texts are scored
    like any other, by features that are all zero; texts of any length are read
    whole; null ids stay null and have no label; rows that repeat are scored
    each. If the trees' rows have only one class, the score is the share of
    toxic rows among them (0.5 without rows); if one half of them has, it is
    the margin. Other columns of docs are not read, whatever their names;
    an empty table gives no rows.
    """
    sample = labelled_sample(labels, id=id, label=label, usable=usable, max_labels=max_labels)
    lexicon = learn_lexicon(docs, sample, id=id, text=text)
    dense = stored(features(docs, lexicon, id=id, text=text), "features")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_mv_id"), F.lit(2)).cast("int")
    known = dense.join(F.broadcast(sample.where("_mv_half = 1")), dense["id"] == F.col("_mv_id")).select("features", F.col("_mv_label").cast("double").alias("label"), fold.alias("fold"))
    known = stored(known, "learned").withColumn("features", array_to_vector("features"))
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    grow = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=64, subsamplingRate=1.0)
    margin = lambda model, df: model.transform(df).withColumn("margin", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    if not 0 < positive < n:
        share = F.lit(0.5 if not n else positive / n)
        scored = dense.withColumns({"score": share, "margin": share})
    else:
        told = margin(grow.fit(known), dense.withColumn("features", array_to_vector("features")))
        halves = [known.where(F.col("fold") == k) for k in (0, 1)]
        if min(h.agg(F.count_distinct("label")).first()[0] for h in halves) < 2:
            scored = told.withColumn("score", F.col("margin"))
        else:
            unseen = [margin(grow.fit(halves[1 - k]), halves[k]).select("margin", "label") for k in (0, 1)]
            isotonic = IsotonicRegression(featuresCol="margin", labelCol="label")
            points = centred(isotonic.fit(unseen[0].unionByName(unseen[1])))
            between = isotonic.fit(docs.sparkSession.createDataFrame(points, "margin double, label double"))
            scored = between.transform(told).withColumn("score", F.col("prediction"))
    return scored.select(F.col("id").alias(id), F.col("score").cast("double"), (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("margin").cast("double"))


def held_out(doc_id: Column) -> Column:
    """The contract's split: crc32 of the id as text, modulo 3, is 1."""
    return id_crc(doc_id) % 3 == 1
