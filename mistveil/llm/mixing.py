"""Mixing sources to target weights.

Sizes are summed per source, targets are shared out by weight with a cap, and
each document is emitted floor(rate) times plus one more time with the
probability of the rate's fraction, drawn from a hash of its id and a seed.
Only one row a source is shuffled; documents stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, ratio, stored


def source_targets(docs: DataFrame, *, text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row a source: source, source_size, weight, target, rate.

    Sources ordered by code point, null last, take the weights in turn and
    share the total size. A target stops at cap times its source's size and
    the excess goes to the others by weight. With sources in the order of
    cap * size / weight the shares have a closed form: the level (target for
    a weight of 1) is the largest of (total - capped before) / (weights from
    here on). Empty table: no rows. Sources without words: target and rate 0.
    """
    sizes = docs.select(F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    ring = F.array(*[F.lit(float(w)) for w in weights])
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(float(cap))
    weighed = sizes.withColumn("weight", F.element_at(ring, ((F.row_number().over(in_turn) - 1) % len(weights) + 1).cast("int")))
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(limit).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    target = F.least(limit, F.col("weight") * F.max("level").over(everything))
    return levels.select("source", "source_size", "weight", target.alias("target")).withColumn("rate", ratio(F.col("target"), F.col("source_size")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash; a null key counts as empty."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def plan_mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document).

    Null and empty texts have size 0; texts of any length count whole; a null
    source is a source of its own; a null id draws like an empty one; repeated
    rows draw alike; an empty table gives no rows; columns of docs with those
    names are replaced.
    """
    own = ("size", "source_size", "target", "rate", "copies")
    targets = stored(source_targets(docs, text=text, source=source, weights=weights, cap=cap), "targets")
    targets = targets.select(F.col("source").alias("_mv_source"), *[F.col(c).alias(f"_mv_{c}") for c in ("source_size", "target", "rate")])
    sized = docs.withColumn("_mv_size", count_words(F.col(text)))
    joined = sized.join(targets, F.col(source).cast("string").eqNullSafe(F.col("_mv_source")), "left")
    rate = F.col("_mv_rate")
    extra = (uniform(F.col(id), seed) < rate - F.floor(rate)).cast("long")
    drawn = joined.withColumn("_mv_copies", F.floor(rate).cast("long") + extra)
    kept = [c for c in docs.columns if c not in own]
    return drawn.select(*kept, *[F.col(f"_mv_{c}").alias(c) for c in own])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as many times as planned, with copy = 1, 2, ... (a column of docs of that name is replaced).

    Nulls, empty and long texts, repeated rows and an empty table as in plan_mix(); other columns stay as they are.
    """
    names = {k: options.get(k, v) for k, v in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    rows = docs.select(F.struct(*docs.columns).alias("_mv_row"), *[F.col(v).alias(k) for k, v in names.items()])
    planned = plan_mix(rows, **options | {k: k for k in names}).where(F.col("copies") > 0)
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return planned.select(*[F.col(f"_mv_row.`{c}`") for c in docs.columns if c != "copy"], F.explode(copies).alias("copy"))
