"""Long texts as overlapping windows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered_within

WINDOW_CHARS, OVERLAP = 2000, 50


def window_texts(text: Column, size: int = WINDOW_CHARS, overlap: int = OVERLAP) -> Column:
    """A text as an array of windows of size code points, each starting overlap before the end of the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(step))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def merge_windows(windows: Column, overlap: int = OVERLAP) -> Column:
    """The first window whole, of each other one what follows its first overlap code points."""
    first = F.coalesce(F.get(windows, F.lit(0)), F.lit(""))
    rest = F.slice(windows, F.lit(2), F.greatest(F.size(windows), F.lit(1)))
    return F.concat(first, F.array_join(F.transform(rest, lambda w: F.substring(w, F.lit(overlap + 1), F.length(w))), ""))


def numbered_chunks(units: DataFrame, by: list[str], order: list[str], size: int = 200) -> DataFrame:
    """units with chunk: 0, 1, ... for each size rows in order, per group; a large group is spread over tasks."""
    return numbered_within(units, by, order, name="_at").withColumn("chunk", F.floor(F.col("_at") / size).cast("int")).drop("_at")
