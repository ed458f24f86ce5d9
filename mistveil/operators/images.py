"""Words and detections of images: lines, redaction, and what may be sent.

Detectors are columns of other tables here. A detector that failed or took too
long has a null result, and everything that depends on it fails closed; no row
is dropped for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import union_box
from ..functions.patterns import JS_SPACE
from ..functions.spans import overlap
from .detect import bucket, no_tags, with_spans
from .known import known_values

#: Fixed values.
SUSPECT_DIGITS, READ_TIMEOUT_MS = 4, 30_000


def in_time(result: Column, took_ms: Column, *, most: int = READ_TIMEOUT_MS) -> Column:
    """A detector's result, null if it took longer than most."""
    return F.when(F.coalesce(took_ms <= most, F.lit(False)), result)


def both(a: Column, b: Column) -> Column:
    """Detections of two detectors; null if either failed."""
    return F.concat(a, b)


def flat_words(blocks: Column) -> Column:
    """Words of nested blocks, paragraphs and lines, in order: text, line (counted over the image), confidence, box. Null blocks: null.

    blocks: array of (paragraphs: array of (lines: array of (words: array of
    (text, confidence, x0, y0, x1, y1)))).
    """
    lines = F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(b["paragraphs"], lambda p: p["lines"]))))

    def word(w: Column, line: Column) -> Column:
        place = F.struct(w["x0"].alias("x"), w["y0"].alias("y"), (w["x1"] - w["x0"]).alias("w"), (w["y1"] - w["y0"]).alias("h"))
        return F.struct(w["text"].alias("text"), line.alias("line"), bucket(w["confidence"], "ocr").alias("confidence"), place.alias("box"))

    return F.flatten(F.transform(lines, lambda l, i: F.transform(l["words"], lambda w: word(w, i))))


def is_suspect(text: Column, confidence: Column) -> Column:
    """A word read with low confidence that may hide an identifier: an at sign, or four digits anywhere."""
    return F.coalesce((confidence == "low") & (F.contains(text, F.lit("@")) | (F.regexp_count(text, F.lit("[0-9]")) >= SUSPECT_DIGITS)), F.lit(False))


def ocr_lines(words: DataFrame, *, by: list[str]) -> DataFrame:
    """One row a line with text: by, line, text, words (word, start, end, suspect, box) with places in text.

    words: by, word (order), line, text, confidence, box. Blank words are left
    out; the others are joined by one space. What meets in a task is one line.
    """
    trimmed = F.regexp_replace("text", rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")
    # What goes through the exchange is no more than the columns asked for need: text has an aggregate of its own, without places and boxes.
    suspect = is_suspect(F.col("text"), F.col("confidence"))
    shown = words.select(*by, "line", "word", trimmed.alias("_t"), suspect.alias("suspect"), "box").where("_t <> ''")
    before = Window.partitionBy(*by, "line").orderBy("word", "_t").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_t") + 1).over(before), F.lit(0)).cast("int")
    placed = shown.withColumn("_start", start)
    one = F.struct("word", F.col("_start").alias("start"), (F.col("_start") + F.length("_t")).alias("end"), "suspect", "box", F.col("_t").alias("text"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "_t")))
    joined = F.array_join(F.transform(in_order, lambda w: w["_t"]), " ")
    return placed.groupBy(*by, "line").agg(F.array_sort(F.collect_list(one)).alias("words"), joined.alias("text"))


def covered(words: Column, span: Column) -> Column:
    """Words of a line that a span touches."""
    return F.filter(words, lambda w: overlap(w, span))


def redactions(words: DataFrame, *, by: list[str], tag=no_tags, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(words to paint over, spans): by, line, word, box; and by, line, type, start, end, box around all words of the span.

    words: by (with origin among it), word, line, text, confidence, box. Words
    go that a span touches or that are suspect, each once. With tokens
    (session_id, origin, type, value), the map that sessions had before,
    session_id is among by too, and values of the map are spans wherever they
    stand. Lines on which the tagger failed go whole.
    """
    lines = ocr_lines(words, by=by)
    if tokens is not None:
        numbered = lines.withColumn("unit", F.struct(*by, "line"))
        lines = known_values(numbered, tokens.select("session_id", "origin", "type", "value")).drop("unit")
    spotted = with_spans(lines, tag)
    failed = F.array(F.struct(F.lit("OTHER").alias("type"), F.lit(0).alias("start"), F.length("text").alias("end")))
    spotted = spotted.withColumn("spans", F.coalesce("spans", failed))
    bad = F.filter("words", lambda w: w["suspect"] | F.exists(F.col("spans"), lambda s: overlap(w, s)))
    painted = spotted.select(*by, "line", F.explode(bad).alias("_w")).select(*by, "line", "_w.word", "_w.box")
    each = spotted.select(*by, "line", "words", F.explode("spans").alias("_s")).withColumn("_on", covered(F.col("words"), F.col("_s"))).where(F.size("_on") > 0)
    box = union_box(F.transform("_on", lambda w: w["box"]))
    return painted, each.select(*by, "line", "_s.type", "_s.start", "_s.end", box.alias("box"))


def gate(faces: Column, texts: Column, codes: Column, tagged: Column) -> Column:
    """(outcome, boxes): detector_failed if a detector or the tagger (tagged: whether it answered) failed; ok with all boxes otherwise."""
    sound = faces.isNotNull() & texts.isNotNull() & codes.isNotNull() & F.coalesce(tagged, F.lit(False))
    return F.struct(F.when(sound, "ok").otherwise("detector_failed").alias("outcome"), F.when(sound, F.concat(faces, texts, codes)).alias("boxes"))


def lookup(image: Column) -> Column:
    """What a lookup of an image in the cache gives: need_pixels, or the outcome it ends with.

    image: inline, readback, version (null: detectors unknown), decision (see
    cache_decision), usable (whether the record's image can be used), fetched
    (null: the request failed), not_modified, same (as the record's pixels),
    stages (outcome of the detectors, null: failed on the way).
    """
    yes = lambda name: F.coalesce(image[name], F.lit(False))
    pixels = F.lit("need_pixels")
    return (
        F.when(yes("inline") | ~yes("readback") | image["version"].isNull() | image["decision"].isNull(), pixels)
        .when(image["decision"] == "fresh", F.when(yes("usable"), "ok").otherwise(pixels))
        .when((image["decision"] != "conditional") | ~yes("fetched"), pixels)
        .when(yes("not_modified"), F.when(yes("usable"), "ok").otherwise(pixels))
        .when(yes("same") & yes("usable"), "ok")
        .otherwise(F.coalesce(image["stages"], pixels))
    )


def process(image: Column) -> Column:
    """The outcome of an image that was read: unreadable, ok, or what the detectors say.

    image: inline, readback, version, decoded (whether pixels were read),
    hashed, same, usable, stages (null: detector_failed).
    """
    yes = lambda name: F.coalesce(image[name], F.lit(False))
    known = ~yes("inline") & image["version"].isNotNull() & yes("same") & yes("usable")
    return F.when(~yes("readback") | ~yes("decoded") | ~yes("hashed"), "unreadable").when(known, "ok").otherwise(F.coalesce(image["stages"], F.lit("detector_failed")))


def marks(selected: DataFrame, fits: DataFrame, *, id: str = "page_id") -> DataFrame:
    """Why images of a page are left out: id, node, image_omitted.

    selected: result of select_images. fits: id, node, fit (see fit_choice;
    null: too large at every step).
    """
    why = F.when(F.col("outcome") == "over_limit", "request_limit").when(F.col("outcome") == "missing", "unreadable").when(F.col("fit").isNull(), "request_limit")
    return selected.join(fits.select(id, "node", "fit"), [id, "node"], "left").select(id, "node", why.alias("image_omitted")).where("image_omitted IS NOT NULL")


def sendable(images: DataFrame) -> DataFrame:
    """Images that passed in the last step of their session: session_id, step, node, img_id, outcome. Of repeated nodes the largest img_id stays.

    Steps without images that passed still count, so an older step's images never come back.
    """
    last = images.groupBy("session_id").agg(F.max("step").alias("_last"))
    ok = images.where("outcome = 'ok'").groupBy("session_id", "step", "node").agg(F.max("img_id").alias("img_id"))
    return ok.join(last, (ok["session_id"].eqNullSafe(last["session_id"])) & (ok["step"] == last["_last"]), "left_semi")
