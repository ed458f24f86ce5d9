"""Trees kept as rows: depths and roots from parent links, and questions about ancestors by nested intervals.

Nodes numbered in document order have their descendants in the interval from
their own number to `last`, the largest number below them. Whether something
lies below a node is then whether the next such number still lies in its
interval, so no row has to carry its path.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def next_number(flag: Column, *, id: str, node: str = "node") -> Column:
    """The smallest number of a node, this one or a later one of its page, for which flag holds; null if there is none."""
    later = Window.partitionBy(id).orderBy(node).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.min(F.when(flag, F.col(node))).over(later)


def holds(flag: Column, *, id: str, node: str = "node", last: str = "last") -> Column:
    """Whether flag holds for a node or one below it."""
    return F.coalesce(next_number(flag, id=id, node=node) <= F.col(last), F.lit(False))


def forest(nodes: DataFrame, *, id: str = "page_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """id, node, parent (null for roots), root, depth and place (0, 1, ... among the children of the parent, or among the roots).

    A node whose parent is null, itself or not in the table is a root. Nodes on
    a cycle of parents, and those below one, belong to no tree: root and depth
    are null. Links are followed by pointer doubling: each round replaces a
    node's link by its link's link, so a chain of n nodes takes log2(n) rounds,
    and what is left after as many rounds as the largest page could need is on
    or below a cycle. Rows that repeat a node count once.
    """
    rows = nodes.select(F.col(id).alias("_page"), F.col(node).alias("_node"), F.col(parent).alias("_up"))
    rows = rows.groupBy("_page", "_node").agg(F.min("_up").alias("_up"))
    there = rows.select(F.col("_page").alias("_its_page"), F.col("_node").alias("_its_node"))
    own = F.col("_page").eqNullSafe(F.col("_its_page")) & (F.col("_up") == F.col("_its_node")) & (F.col("_up") != F.col("_node"))
    linked = written(rows.join(there, own, "left").select("_page", "_node", F.col("_its_node").alias("_up")), "links")
    largest = linked.groupBy("_page").count().agg(F.max("count")).first()[0] or 1
    state = linked.select("_page", "_node", F.coalesce("_up", "_node").alias("_at"), F.when(F.col("_up").isNull(), 0).otherwise(1).alias("_far"), F.col("_up").isNull().alias("_done"))
    for _ in range(ceil(log2(largest + 1)) + 1):
        state = written(state, "pointers")
        if not state.where("NOT _done").limit(1).count():
            break
        onward = state.select(F.col("_page").alias("_p"), F.col("_node").alias("_n"), F.col("_at").alias("_next"), F.col("_far").alias("_more"), F.col("_done").alias("_end"))
        open_ = state.where("NOT _done").join(onward, F.col("_page").eqNullSafe(F.col("_p")) & (F.col("_at") == F.col("_n")))
        moved = open_.select("_page", "_node", F.col("_next").alias("_at"), (F.col("_far") + F.col("_more")).alias("_far"), F.col("_end").alias("_done"))
        state = state.where("_done").unionByName(moved)
    found = state.select(F.col("_page").alias("_p"), F.col("_node").alias("_n"), F.when(F.col("_done"), F.col("_at")).alias("root"), F.when(F.col("_done"), F.col("_far")).alias("depth"))
    joined = linked.join(found, F.col("_page").eqNullSafe(F.col("_p")) & (F.col("_node") == F.col("_n")))
    place = F.row_number().over(Window.partitionBy("_page", "_up").orderBy("_node")) - 1
    return joined.select(F.col("_page").alias(id), F.col("_node").alias(node), F.col("_up").alias(parent), "root", "depth", place.alias("place"))


def roots(nodes: DataFrame, *, id: str = "page_id") -> DataFrame:
    """Nodes without a parent in the table, or that are their own."""
    known = nodes.select(F.col(id).alias("_page"), F.col("node").alias("_node"))
    return nodes.join(known, (F.col(id) == F.col("_page")) & (F.col("parent") == F.col("_node")) & (F.col("parent") != F.col("node")), "left_anti")
