"""Selection under size budgets, and what a page keeps after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import MAX_RECORDS, PRUNE_MS, image_rank
from .trees import holds

#: Fixed values.
MAX_CHARS, CHARS_A_TOKEN, SHARE = 12_000, 4, 0.4


def char_budget(context_tokens: Column) -> Column:
    """Characters of content for a model's context: 40 % of its tokens at four characters, 12,000 at most."""
    return F.least(F.floor(context_tokens * SHARE) * CHARS_A_TOKEN, F.lit(MAX_CHARS)).cast("int")


def distance(b: Column, viewport: Column) -> Column:
    """Pixels between a box and the viewport; 0 inside."""
    bottom = b["y"] + b["h"]
    return F.when(bottom <= 0, -bottom).when(b["y"] >= viewport, b["y"] - viewport).otherwise(0)


def select_units(units: DataFrame, *, by: list[str], max_chars: int | Column, max_units: int | Column) -> DataFrame:
    """units with kept: whole fields, nearest first, up to the first one that does not fit.

    units: the columns of by, node, field, unit, text, visible, inside_interactive,
    distance (null: node unknown). Sums in rank order only grow, so the first
    misfit is where a running sum passes its limit.
    """
    seen = F.coalesce(F.col("visible"), F.lit(False)) & F.col("distance").isNotNull()
    tier = F.when(~seen, 3).when(F.col("distance") > 0, 2).when(F.col("inside_interactive"), 0).otherwise(1)
    far = F.when(tier >= 2, F.coalesce(F.col("distance").cast("double"), F.lit(float("inf")))).otherwise(0.0)
    # A node's columns are the same in all its units, so the units of a field are peers in this order.
    ranked = units.repartition(*by).withColumns({"_tier": tier, "_far": far, "_first": F.min("unit").over(Window.partitionBy(*by, "node", "field"))})
    order = Window.partitionBy(*by).orderBy("_tier", "_far", F.desc("inside_interactive"), "_first", "node", "field")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (F.sum(F.length("text")).over(so_far) <= max_chars) & (F.count("*").over(so_far) <= max_units)
    return ranked.withColumn("kept", fits).drop("_tier", "_far", "_first")


def prune(nodes: DataFrame, selected: DataFrame, *, id: str = "page_id") -> DataFrame:
    """Nodes worth keeping once content was cut, with trimmed where something below or on them went.

    nodes: id, node, parent, last (see trees), secret, marker, image,
    image_omitted, interactive, in_viewport. selected: id, node, field, kept.
    A node stays if it has kept content, is secret, a marker, an image that may
    be sent, or an interactive node in the viewport, or if one below it stays.
    Pages without cut content stay as they are.

    One exchange by page, then rows in proportion to nodes: whether something
    below stays, and whether something below is gone, is asked of intervals.
    What is gone below a node that stays lies in children that do not.
    """
    bare = nodes.select(id, "node", F.struct(*nodes.columns).alias("_row"), F.lit(False).alias("_has"), F.lit(False).alias("_lost"))
    content = selected.select(id, "node", F.lit(None).cast(bare.schema["_row"].dataType).alias("_row"), F.col("kept").alias("_has"), (~F.col("kept")).alias("_lost"))
    own_row = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = bare.unionByName(content).repartition(id).groupBy(id, "node").agg(own_row("_row"), F.max("_has").alias("_has"), F.max("_lost").alias("_lost"))
    rows = rows.withColumns({"_touched": F.max("_lost").over(Window.partitionBy(id)), "_last": F.coalesce("_row.last", "node")}).where("_row IS NOT NULL")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    lost_image = F.col("_row.image").isNotNull() & F.col("_row.image_omitted").isNotNull() & ~yes("_row.in_viewport")
    own = F.col("_has") | yes("_row.secret") | F.col("_row.marker").isNotNull() | (F.col("_row.image").isNotNull() & ~lost_image) | (yes("_row.interactive") & yes("_row.in_viewport"))
    kept = rows.withColumn("_keep", holds(own, id=id, last="_last") | ~F.col("_touched"))
    gone = F.col("_touched") & (F.col("_lost") | lost_image | (yes("_row.interactive") & ~F.col("_keep")))
    judged = kept.withColumns({"_gone": gone, "_below": holds(gone, id=id, last="_last")})
    # To a node that stays: what is gone on itself; to the parent of one that goes: what is gone in and below it.
    told = F.array(F.struct(F.col("node").alias("at"), F.when(F.col("_keep"), F.col("_row")).alias("row"), (F.col("_keep") & F.col("_gone")).alias("flag")), F.struct(F.col("_row.parent").alias("at"), F.lit(None).cast(bare.schema["_row"].dataType).alias("row"), (~F.col("_keep") & F.col("_below")).alias("flag")))
    flagged = judged.select(id, F.inline(F.filter(told, lambda t: t["at"].isNotNull()))).groupBy(id, "at").agg(own_row("row"), F.max("flag").alias("trimmed"))
    return flagged.where("row IS NOT NULL").select("row.*", "trimmed")


def select_images(nodes: DataFrame, *, id: str = "page_id", limit: int | Column = 4, viewport: float = float("inf")) -> DataFrame:
    """Image nodes with outcome selected, over_limit or missing; by priority, then area, then order.

    nodes: id, node, image, image_omitted, visible, in_viewport, box, available.
    """
    images = nodes.where("image IS NOT NULL AND image_omitted IS NULL")
    rank = image_rank(F.col("image"), F.col("visible"), F.col("in_viewport"), F.col("box"), F.lit(viewport))
    ranked = images.withColumn("_rank", rank)
    area = F.coalesce(F.col("_rank.area"), F.col("box.w") * F.col("box.h"))
    order = Window.partitionBy(id, "available").orderBy(F.coalesce("_rank.priority", F.lit(3)), F.desc(area), "node")
    place = F.row_number().over(order)
    outcome = F.when(F.col("available"), F.when(place <= F.greatest(F.lit(0), F.lit(limit) if isinstance(limit, int) else limit), "selected").otherwise("over_limit")).when(F.col("visible"), "missing")
    return ranked.withColumn("outcome", outcome).withColumn("place", F.when(F.col("available"), place)).where("outcome IS NOT NULL").select(id, "node", "outcome", "place")


def run_with_budget(items: DataFrame, *, by: list[str], order: list[str], budget: int) -> DataFrame:
    """items (with ok: whether each would succeed) with started: in order, until budget successes are reached."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("started", F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)) < budget)


def prunable(records: DataFrame, now: Column, *, most: int = MAX_RECORDS) -> DataFrame:
    """Keys of cache records that go: not validated for a day, or beyond the newest `most`."""
    expired = now - F.col("validated_at") > PRUNE_MS
    stale = records.where(expired).select("key")
    newest = records.where(~expired).orderBy(F.desc("validated_at"), "key").limit(most)
    fresh = records.where(~expired).select("key").join(newest.select("key"), "key", "left_anti")
    return stale.unionByName(fresh)


def latest(rows: DataFrame, *, key: list[str], order: str) -> DataFrame:
    """The last row of each key: upsert by key. Only ordering values and rows of equal keys meet in a task."""
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return newest.select("_row.*")


def newest(rows: DataFrame, *, order: str, most: int) -> DataFrame:
    """The newest rows: ring buffers and least-recently-used lists."""
    return rows.orderBy(F.desc(order)).limit(most)
