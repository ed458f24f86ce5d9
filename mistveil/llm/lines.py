"""Line dedup: lines that many documents hold stay in one of them only.

Lines are exploded and hashed; distinct documents are counted per hash with
partial sums, so a very common line is counted in all tasks; positions of
dropped lines go back to their document, which is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, digest, let, stored


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def split_lines(text: Column) -> Column:
    """Lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with text less its dropped lines, and n_lines, n_dropped.

    A line's key is the line without spaces at its ends, A-Z lower-cased. Keys
    of at least min_chars code points in at least min_docs documents (distinct
    ids; null is one id, the smallest) are dropped but in the largest id that
    holds them. A null text becomes empty; a text that loses all lines becomes
    empty; texts of any length are split whole; rows with equal id and text
    are treated alike; an empty table gives no rows; columns of docs named
    n_lines or n_dropped are replaced.
    """
    key = [F.col(id).alias("_mv_id"), *[h.alias(f"_mv_t{i}") for i, h in enumerate(digest(F.coalesce(F.col(text), F.lit(""))))]]
    lines = docs.select(*key, F.posexplode(split_lines(F.col(text))).alias("_mv_pos", "_mv_line"))
    long_lines = lines.where(F.length("_mv_line") >= min_chars).withColumn("_mv_key", line_key(F.col("_mv_line"))).where(F.length("_mv_key") >= min_chars)
    hashed = long_lines.select("_mv_id", "_mv_t0", "_mv_t1", "_mv_pos", *[h.alias(f"_mv_k{i}") for i, h in enumerate(digest(F.col("_mv_key")))])

    # A struct is never null, so that a null id counts as a document.
    holder = F.struct("_mv_id")
    common = hashed.groupBy("_mv_k0", "_mv_k1").agg(F.count_distinct(holder).alias("_mv_n"), F.max("_mv_id").alias("_mv_keeper")).where(F.col("_mv_n") >= min_docs)
    common = stored(common.drop("_mv_n"), "lines")

    drops = hashed.join(common, ["_mv_k0", "_mv_k1"]).where(~F.col("_mv_id").eqNullSafe(F.col("_mv_keeper")))
    drops = drops.groupBy("_mv_id", "_mv_t0", "_mv_t1").agg(F.collect_set("_mv_pos").alias("_mv_drop"))
    drops = drops.select(*[F.col(c).alias(f"{c}_d") for c in ("_mv_id", "_mv_t0", "_mv_t1")], "_mv_drop")

    named = docs.select(*docs.columns, *key)
    same = F.col("_mv_id").eqNullSafe(F.col("_mv_id_d")) & (F.col("_mv_t0") == F.col("_mv_t0_d")) & (F.col("_mv_t1") == F.col("_mv_t1_d"))
    joined = named.join(drops, same, "left")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_mv_drop"))
        return F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")

    original = F.coalesce(F.col(text), F.lit(""))
    new_text = F.when(F.col("_mv_drop").isNull(), original).otherwise(let(split_lines(F.col(text)), kept))
    n_lines = (F.length(original) - F.length(F.replace(original, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce(F.size("_mv_drop"), F.lit(0)).cast("long")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[new_text.alias(c) if c == text else F.col(c) for c in columns], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
