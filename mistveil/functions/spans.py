"""Spans of identifiers in texts, as expressions that stay in the JVM. Positions are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import passes
from .patterns import MAYBE, MAYBE_DIGITS, PATTERNS, WITH_AT

SPAN = "struct<type:string,start:int,end:int>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though lambdas inside body use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Signs that stand around hits while a text is cut up, and in place of such a sign in a text.
_MARK, _NO_MARK = "\x01", "\x02"


def _hits(text: Column, form: Column) -> Column:
    """hits() of a text without _MARK: one pass sets marks around hits, and a split at a plain sign, which compiles nothing, cuts there."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(parts: Column) -> Column:
        # Every second part is a hit.
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(parts, i * 2))
            end = start + F.length(F.get(parts, i * 2 + 1))
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

        last = (F.size(parts) / 2).cast("int") - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]

    cut = F.split(F.regexp_replace(text, form, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.when(F.rlike(text, form), let(cut, placed)).otherwise(none)


def hits(text: Column, pattern: str | Column) -> Column:
    """Non-overlapping hits of a pattern: array of (start, end)."""
    form = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.contains(text, F.lit(_MARK)), _slow_hits(text, form)).otherwise(_hits(text, form))


def _slow_hits(text: Column, form: Column) -> Column:
    """hits() of any text, by hits and what lies between them."""
    found, between = F.regexp_extract_all(text, form, F.lit(0)), F.split(text, form, F.lit(-1))

    def placed(m: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, i: Column, g: Column) -> Column:
            start = acc["at"] + F.length(F.get(g, i))
            end = start + F.length(F.get(m, i))
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))

        return let(between, lambda g: F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), nothing, lambda acc, i: step(acc, i, g))["out"])

    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(placed(m)))


def piece(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def overlap(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def claim(candidates: Column, taken: Column | None = None) -> Column:
    """Spans in order of priority, each kept if it overlaps none kept before it."""
    start = F.array().cast(f"array<{SPAN}>") if taken is None else taken
    return F.aggregate(candidates, start, lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k, x)), kept).otherwise(F.array_append(kept, x)))


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["type"]))), lambda s: F.struct(s["type"], s["start"], s["end"]))


def candidates(text: Column, kind: str, pattern: str, check: str | None) -> Column:
    """Hits of one pattern as spans, those with a wrong checksum left out. The text has no _MARK."""
    found = F.transform(_hits(text, F.lit(pattern)), lambda h: F.struct(F.lit(kind).alias("type"), h["start"].alias("start"), h["end"].alias("end")))
    return F.filter(found, lambda s: passes(check, piece(text, s))) if check else found


def pattern_spans(text: Column) -> Column:
    """All identifiers in a text, sorted by start: earlier patterns claim text first; hits with a wrong checksum claim nothing. Null: none."""
    none = F.array().cast(f"array<{SPAN}>")

    def some(t: Column, kinds: list[tuple]) -> Column:
        return F.concat(*[candidates(t, *p) for p in kinds])

    def of(t: Column) -> Column:
        mail = F.when(F.contains(t, F.lit("@")), some(t, [p for p in PATTERNS if p[0] in WITH_AT])).otherwise(none)
        others = F.when(t.rlike(MAYBE_DIGITS), some(t, [p for p in PATTERNS if p[0] not in WITH_AT])).otherwise(none)
        return by_start(claim(F.concat(mail, others)))  # those with an at sign are the first patterns

    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.rlike(MAYBE), let(F.replace(whole, F.lit(_MARK), F.lit(_NO_MARK)), of)).otherwise(none)  # no pattern tells one sign from the other


def replaced(text: Column, parts: Column) -> Column:
    """text with each part (start, end, token; sorted, not overlapping) replaced by its token."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, p: F.struct(p["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), p["token"]).alias("out"))
    return let(F.aggregate(parts, start, step), lambda r: F.concat(r["out"], F.substring(text, r["at"] + 1, F.length(text))))


def placeholder_counts(text: Column) -> Column:
    """Distinct tokens by type and all secrets, as a map from type to count."""
    from .patterns import TOKEN

    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    kinds = F.transform(tokens, lambda t: F.regexp_extract(t, r"\[PII_([A-Z_]+)_[0-9]+\]", 1))
    secrets = F.regexp_count(text, F.lit(r"\[SECRET\]"))
    counted = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n")))
    return F.map_from_entries(F.when(secrets > 0, F.concat(counted, F.array(F.struct(F.lit("SECRET").alias("kind"), secrets.alias("n"))))).otherwise(counted))
