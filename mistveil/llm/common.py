"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, though lambdas inside body use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest(col: Column) -> list[Column]:
    """Two 64-bit hashes of a string, to stand for it as a key of 128 bits."""
    return [F.xxhash64(col), F.xxhash64(F.lit("second"), col)]


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def hash_sample(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """All rows if there are at most `most`, else about 95 % of `most` of them, chosen by a hash of key: the same ones on each run.

    A threshold, unlike a sort with a limit, sends nothing to the driver.
    """
    n = rows.count()
    steps = 2**40
    place = F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(steps))
    return rows if n <= most else rows.where(place < int(steps * 0.95 * most / n))


def bitmap(keys: DataFrame, spot: Column, bits: int):
    """A broadcast array of longs whose bits stand for the spots (below bits, a power of two) of keys."""
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(at % 64 AS INT))")
    found = keys.select(spot.alias("at")).groupBy(F.expr("CAST(at DIV 64 AS INT)").alias("i")).agg(F.bit_or(bit).alias("x")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["i"].to_numpy()] = found["x"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def bits_for(n: int, most: int = 1 << 27) -> int:
    """Bits of a bitmap of n keys: about eight a key, 16 MB at most."""
    return min(most, 1 << max(10, (8 * n).bit_length()))


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def maybe_among(keys: DataFrame, column: str):
    """A function of a column of longs: false only for values that keys does not hold in `column`.

    A bitmap of bounded size decides; the more keys beyond that, the more
    other values pass. It only saves work before an exact join.
    """
    bits = bits_for(keys.count())
    spot = lambda c: F.pmod(F.xxhash64(F.lit("spot"), c), F.lit(bits))
    held = bitmap(keys, spot(F.col(column)), bits)

    @F.pandas_udf("boolean")
    def check(at: pd.Series) -> pd.Series:
        return pd.Series(is_set(held.value, at.to_numpy()))

    return lambda c: check(spot(c))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc.master.split("[")[0] == "local" and not sc._jsc.sc().getCheckpointDir().isDefined():
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mistveil-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/mistveil-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and lets the planner see
    the true size, so that it broadcasts the table only below its threshold.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mistveil_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() has written for df; nothing that still has to read it may be left."""
    remove(df.sparkSession, df._mistveil_path)


#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Queries run inside leave no shuffle files behind; else these stay until the driver collects its garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
