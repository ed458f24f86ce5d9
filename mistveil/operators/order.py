"""Positions of rows in an order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def _columns(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def numbered(rows: DataFrame, order: list, *, name: str = "place") -> DataFrame:
    """rows with a long column `name`: 0, 1, ... in the order of names or sort expressions.

    Rows are dealt by ranges of the order and sorted within their part; a
    part's size and the sizes before it give each row its place. Only one row
    a part meets in a task. Rows equal in the order are in either order; they
    may lie in one part, so the order should end with a column that differs.
    """
    by = _columns(order)
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": at}), "ordered")
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", before.alias("_before"))
    # One row a part: as many as there are tasks, whatever the data.
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def numbered_within(rows: DataFrame, by: list[str], order: list, *, name: str = "place") -> DataFrame:
    """rows with a long column `name`: 0, 1, ... in order within each group of by; a large group is spread over tasks. Null keys are a group."""
    counted = numbered(rows, [*by, *order], name="_global")
    firsts = counted.groupBy(*by).agg(F.min("_global").alias("_first")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return counted.join(firsts, same).withColumn(name, F.col("_global") - F.col("_first")).select(*rows.columns, name)


def at_ranks(values: DataFrame, *, by: list[str], value: str, count: str, ranks: dict[str, float]) -> DataFrame:
    """Per group n, the sum of its counts, and for each rank p the value at place floor(p * n) in order, the last at most.

    values: one row a group and distinct value with its count. Ranges of the
    order are the cells of a histogram; running sums over a group's cells name
    the cell that holds each place, and only the rows of that cell are looked
    at. A task sees one cell of a group, never all its values.
    """
    dealt = values.repartitionByRange(*by, value).withColumn("_cell", F.spark_partition_id())
    kept = written(dealt, "cells")
    of_group, up_to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_cell")
    cells = kept.groupBy(*by, "_cell").agg(F.sum(count).alias("_size"))
    cells = cells.withColumns({"_n": F.sum("_size").over(of_group), "_before": F.sum("_size").over(up_to) - F.col("_size")})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("rank"), F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))).alias("at")) for name, p in ranks.items()]))
    held = cells.withColumn("_want", wanted).where((F.col("_before") <= F.col("_want.at")) & (F.col("_want.at") < F.col("_before") + F.col("_size")))
    named = held.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_cell").alias("_in"), "_n", "_before", F.col("_want.rank").alias("_rank"), F.col("_want.at").alias("_at"))
    same = F.col("_cell") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    running = F.sum(count).over(Window.partitionBy(*by, "_cell", "_rank").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = kept.join(named, same).withColumn("_to", F.col("_before") + running).where(F.col("_to") > F.col("_at"))
    found = placed.groupBy(*by).agg(F.first("_n").alias("n"), *[F.min(F.when(F.col("_rank") == name, F.col(value))).alias(name) for name in ranks])
    return found
