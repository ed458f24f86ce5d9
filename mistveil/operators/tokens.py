"""Tokens that stand for personal data, stable within a session and origin.

Units are rows with session_id, origin, step, unit (order within the session),
text. Only units with spans take part in joins; all others pass untouched.
Joins with what comes from exploded rows are merged: the planner takes such
rows to be as few as those they come from and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import JS_SPACE, TOKEN
from ..functions.spans import pattern_spans, piece, replaced
from ..functions.urls import url_of, url_texts
from ..sources.tables import written
from .detect import no_tags, with_spans
from .known import known_values

KEY = ("session_id", "origin", "type", "norm")


def normalized(value: Column) -> Column:
    """Lower case, without white space at the ends."""
    return F.lower(F.regexp_replace(value, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", ""))


def occurrences(units: DataFrame, spans: str = "spans") -> DataFrame:
    """One row a span of a unit: session_id, origin, unit, start, end, type, value, norm."""
    each = units.where(F.size(spans) > 0).select("session_id", "origin", "unit", "text", F.explode(spans).alias("s"))
    value = piece(F.col("text"), F.col("s"))
    return each.select("session_id", "origin", "unit", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.type").alias("type"), value.alias("value"), normalized(value).alias("norm"))


def token_map(found: DataFrame) -> DataFrame:
    """session_id, origin, type, norm, value, token, first (unit, start) of each value.

    Numbers count per type across the origins of a session, in order of first
    occurrence by (unit, start); the first spelling is kept. Occurrences are
    reduced to one row a value before the numbering, so its window holds the
    distinct values of one session and type.
    """
    first = F.struct("unit", "start")
    values = found.groupBy(*KEY).agg(F.min(first).alias("first"), F.min_by("value", first).alias("value"))
    order = Window.partitionBy("session_id", "type").orderBy("first", "origin", "norm")
    return values.withColumn("token", F.format_string("[PII_%s_%d]", F.col("type"), F.row_number().over(order)))


def token_sources(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Where each token occurs: token with its places (unit, start) in order."""
    joined = found.join(tokens.select(*KEY, "token").hint("merge"), list(KEY))
    return joined.groupBy("session_id", "origin", "token").agg(F.array_sort(F.collect_list(F.struct("unit", "start"))).alias("sources"))


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left with right's other columns where keys are equal, null to null."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named.hint("merge"), same, how).drop(*[f"_right_{k}" for k in keys])


def rewrite(units: DataFrame, found: DataFrame, tokens: DataFrame) -> DataFrame:
    """units with their spans replaced by tokens in column text; other columns stay.

    Null keys are keys like others. Rows equal in session, origin, unit and
    text share their spans. A row whose spans are null or not in found stays,
    but its text is null, so that nothing gets out.
    """
    key = ("session_id", "origin", "unit")
    parts = _joined(found, tokens.select(*KEY, "token"), KEY).groupBy(*key)
    parts = parts.agg(F.array_sort(F.collect_set(F.struct("start", "end", "token"))).alias("parts"))
    plain, touched = units.where(F.coalesce(F.size("spans"), F.lit(-1)) <= 0), units.where(F.size("spans") > 0)
    plain = plain.withColumn("text", F.when(F.size("spans") == 0, F.col("text")))
    changed = _joined(touched, parts, key, "left").withColumn("text", F.when(F.col("parts").isNotNull(), replaced(F.col("text"), F.col("parts")))).drop("parts")
    return plain.unionByName(changed.select(*plain.columns))


def spotted(units: DataFrame, tag=no_tags) -> DataFrame:
    """Written units with their spans, those of values known from earlier units of the session and origin among them.

    Spans are found in all texts first; what they hold, as of the unit each
    value comes first in, is then looked for in later units, and units that
    hold such values are looked through again with these masked. A value
    counts as known even if a later look finds it only as part of another.
    """
    looked = written(units.withColumn("patterns", pattern_spans(F.col("text"))), "patterns")
    first = written(with_spans(looked, tag).withColumn("spans", F.when(F.col("_opaque"), opaque_span(F.col("text"))).otherwise(F.col("spans"))), "spans")
    held = written(known_values(first.where("NOT _opaque"), token_map(occurrences(first))).where(F.size("known") > 0).drop("spans"), "known")
    again = with_spans(held, tag).select(*first.columns)
    hit = held.select(*[F.col(c).alias(f"_hit_{c}") for c in ("session_id", "origin", "unit")]).distinct()
    same = F.lit(True)
    for c in ("session_id", "origin", "unit"):
        same = same & F.col(c).eqNullSafe(F.col(f"_hit_{c}"))
    others = first.join(hit.hint("merge"), same, "left_anti")
    return written(others.unionByName(again).drop("patterns"), "spotted")


def sanitize(units: DataFrame, tag=no_tags) -> tuple[DataFrame, DataFrame]:
    """(units with sanitized text and failed, their token map); units with field href or src take the way of URLs.

    Of a URL the path segments and query values are texts of their own and
    sensitive values go whole; tokens are the same as in other fields. Values
    that earlier units of the session and origin have shown are masked in
    later ones wherever they stand. Units are told apart by session_id, origin
    and unit. Null texts stay null. failed marks units whose text is withheld:
    absolute URLs with a malformed percent code in the path, and texts on
    which the tagger failed.
    """
    link = F.col("field").isin("href", "src")
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("opaque")))
    parts = F.when(link & F.col("text").isNotNull(), url_texts(F.col("text"))).otherwise(whole)
    given = F.col("text").isNotNull()
    each = units.withColumns({"_raw": F.when(link, F.col("text")), "_unit": F.col("unit"), "_given": given}).select(*[c for c in units.columns if c not in ("text", "unit")], "_raw", "_unit", "_given", F.posexplode(parts).alias("_part", "_p"))
    each = each.withColumns({"text": F.col("_p.text"), "_opaque": F.col("_p.opaque"), "unit": F.struct("_unit", "_part")}).drop("_p")
    found_in = spotted(each, tag)
    found = occurrences(found_in)
    tokens = token_map(found)
    clean = rewrite(found_in, found, tokens).withColumn("unit", F.col("_unit"))
    failed = (F.col("_given") & F.col("text").isNull()).alias("failed")
    plain = clean.where(F.col("_raw").isNull()).select(*units.columns, failed)
    rest = [c for c in units.columns if c not in ("session_id", "origin", "unit", "text")]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_part", "text"))), lambda p: p["text"])
    links = clean.where(F.col("_raw").isNotNull()).groupBy("session_id", "origin", "unit").agg(F.first("_raw").alias("_raw"), F.first("_given").alias("_given"), texts.alias("_texts"), *[F.first(c).alias(c) for c in rest])
    lost = F.exists("_texts", lambda t: t.isNull())
    return plain.unionByName(links.withColumn("text", F.when(~lost, url_of(F.col("_raw"), F.col("_texts")))).select(*units.columns, failed)), tokens


def resolve(texts: DataFrame, tokens: DataFrame, *, text: str = "text") -> DataFrame:
    """texts (session_id, id, text) with known tokens of the session turned back into values; unknown ones stay.

    Texts without a token take no part in the join.
    """
    marked = texts.withColumn("_tokens", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
    bare = marked.where(F.size("_tokens") == 0).drop("_tokens")
    gaps = F.split(F.col(text), TOKEN, -1)
    parts = marked.where(F.size("_tokens") > 0).withColumn("_gaps", gaps)
    each = parts.select("session_id", "id", F.posexplode("_tokens").alias("_at", "token"))
    known = each.join(tokens.select("session_id", "token", "value").distinct().hint("merge"), ["session_id", "token"], "left")
    values = known.groupBy("session_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("value", "token").alias("v")))), lambda x: x["v"]).alias("_values"))
    woven = F.concat(F.get("_gaps", F.lit(0)), F.array_join(F.zip_with("_values", F.slice("_gaps", F.lit(2), F.size("_gaps")), lambda v, g: F.concat(v, g)), ""))
    back = parts.join(values.hint("merge"), ["session_id", "id"]).withColumn(text, woven)
    return bare.unionByName(back.select(*texts.columns))


def resolve_actions(actions: DataFrame, tokens: DataFrame) -> DataFrame:
    """actions (session_id, step, idx, type, text, value, ...) with known tokens turned back into values where they are typed or selected; all else stays.

    For actions that policy has let pass. Rows are told apart by session_id,
    step and idx.
    """
    key = ["session_id", "step", "idx"]
    said = F.when(F.col("type") == "type", F.col("text")).when(F.col("type") == "select", F.col("value"))
    texts = actions.withColumn("_said", said).where(F.col("_said").rlike(TOKEN)).select("session_id", F.struct("step", "idx").alias("id"), F.col("_said").alias("text"))
    back = resolve(texts, tokens).select("session_id", F.col("id.step").alias("step"), F.col("id.idx").alias("idx"), F.col("text").alias("_told"))
    told = lambda kind, c: F.when((F.col("type") == kind) & F.col("_told").isNotNull(), F.col("_told")).otherwise(F.col(c))
    return actions.join(back.hint("merge"), key, "left").withColumns({"text": told("type", "text"), "value": told("select", "value")}).select(*actions.columns)


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def opaque_span(text: Column, kind: str = "OTHER") -> Column:
    """One span over the whole value."""
    return F.array(F.struct(F.lit(kind).alias("type"), F.lit(0).alias("start"), F.length(text).alias("end")))
