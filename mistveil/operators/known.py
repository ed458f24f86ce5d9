"""Values that a session has already tokenized, found again in its later texts.

Values are indexed by the hash of session, origin and their first word. Texts
send the hashes of their distinct words to that index, so a value meets only
texts that hold its first word, never all texts of its session. Places are
then looked up in those texts alone, longest values first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import JS_SPACE, PLACEHOLDER
from ..functions.spans import SPAN, by_start, claim, hits

#: Fixed value: shorter values are not looked for.
MIN_KNOWN_CHARS = 3
WORD = r"[\p{L}\p{N}_]"
#: A word, or a run of signs between words and spaces: values without any word are looked for by such runs.
PIECE = rf"{WORD}+|[^\p{{L}}\p{{N}}_{JS_SPACE}]+"


def _anchor(value: Column) -> Column:
    """What a value is indexed by: its first word, or its first run of signs if it has none."""
    word = F.regexp_extract(value, rf"{WORD}+", 0)
    return F.when(word != "", word).otherwise(F.regexp_extract(value, PIECE, 0))


def _pattern(value: Column) -> Column:
    """A pattern that finds a value as whole words in any case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(rf"(?iu)(?<!{WORD})"), quoted, F.lit(rf"(?!{WORD})"))


def spans_of_values(text: Column, values: Column) -> Column:
    """Spans of values (array of type, value) in a text: whole words, any case, longest first, outside of placeholders, by start."""

    def places(v: Column) -> Column:
        return F.transform(hits(text, _pattern(v["value"])), lambda h: F.struct(v["type"].alias("type"), h["start"].alias("start"), h["end"].alias("end")))

    # A struct's order: longest, then first; of equal places the smaller type.
    order = lambda s: F.struct((s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["type"].alias("type"), s["end"].alias("end"))
    ranked = F.transform(F.array_sort(F.transform(F.flatten(F.transform(values, places)), order)), lambda s: F.struct(s["type"], s["start"], s["end"]))
    marks = F.transform(hits(text, PLACEHOLDER), lambda h: F.struct(F.lit("").alias("type"), h["start"].alias("start"), h["end"].alias("end")))
    return by_start(F.filter(claim(ranked, marks), lambda s: s["type"] != ""))


def known_index(tokens: DataFrame) -> DataFrame:
    """session_id, origin, type, value and since (the unit a value was first seen in), with the hash that texts are joined by.

    tokens: session_id, origin, type, value and, if there, first (unit, start);
    without it a value is known from the beginning.
    """
    value = F.regexp_replace("value", rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")
    since = F.col("first")["unit"] if "first" in tokens.columns else F.lit(None)
    rows = tokens.select(F.col("session_id").alias("_s"), F.col("origin").alias("_o"), "type", value.alias("value"), since.alias("since")).where(F.length("value") >= MIN_KNOWN_CHARS)
    return rows.withColumn("_hash", F.xxhash64("_s", "_o", F.lower(_anchor(F.col("value")))))


def known_values(units: DataFrame, tokens: DataFrame, *, version: str = "unit") -> DataFrame:
    """units (session_id, origin, unit, text) with column known: spans of values that the session already holds for the origin.

    A value counts for units whose `version` is later than the one it was
    first seen in: the number of the unit, or of a step or chunk as of whose
    start the map counts (tokens.first.unit is of the same kind). Units are
    told apart by session_id, origin and unit; null keys are keys; null texts
    hold nothing.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(PIECE), F.lit(0)), lambda w: F.xxhash64("session_id", "origin", w)))
    keys = [F.col("session_id").alias("_known_session"), F.col("origin").alias("_known_origin"), F.col("unit").alias("_known_unit")]
    spots = units.where("text IS NOT NULL").select(*keys, F.col(version).alias("_known_version"), F.explode(words).alias("_hash"))
    index = known_index(tokens)
    seen = F.lit(True) if "first" not in tokens.columns else F.col("_known_version") > F.col("since")
    held = spots.join(index.hint("merge"), "_hash").where(F.col("_known_session").eqNullSafe(F.col("_s")) & F.col("_known_origin").eqNullSafe(F.col("_o")) & seen)
    listed = held.groupBy("_known_session", "_known_origin", "_known_unit").agg(F.array_sort(F.collect_set(F.struct("type", "value"))).alias("_known_values"))
    same = F.col("session_id").eqNullSafe(F.col("_known_session")) & F.col("origin").eqNullSafe(F.col("_known_origin")) & F.col("unit").eqNullSafe(F.col("_known_unit"))
    known = F.when(F.col("_known_values").isNull() | F.col("text").isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(spans_of_values(F.col("text"), F.col("_known_values")))
    return units.join(listed.hint("merge"), same, "left").withColumn("known", known).drop("_known_session", "_known_origin", "_known_unit", "_known_values")
