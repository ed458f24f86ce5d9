"""Tables keyed by columns, kept as versions of folders: upserts that may be replayed, lookups, and pruning."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.budget import latest, prunable


class KeyedTable:
    """The latest row of each key, by a column that orders them.

    Rows lie in `buckets` folders by a hash of the key. An upsert writes the
    buckets it touches anew, next to the old ones, and then one small file
    that names the folders of all buckets: readers see all of it or nothing,
    and a writer that dies leaves what was there before. The file also names
    the last batch, so a batch that a stream replays changes nothing. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *, key: list[str], order: str, buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # --- The file that names the folders ---

    def _hadoop(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def state(self) -> dict:
        """version, batch (of the last upsert, -1: none) and folders by bucket."""
        fs, at = self._hadoop("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = sorted(n for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not found:
            return {"version": 0, "batch": -1, "folders": {}}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{found[-1]}").first()[0])

    def _point(self, state: dict) -> None:
        fs, draft = self._hadoop("versions", f"draft-{state['version']}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, self._hadoop("versions", f"{state['version']:012d}.json")[1]):
            raise OSError(f"version {state['version']} of {self.path} was written by another writer")

    # --- Rows ---

    def _folders(self, state: dict, buckets=None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in state["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._folders(self.state())

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys."""
        return self.read().join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def upsert(self, rows: DataFrame, batch: int | None = None, keep=None) -> bool:
        """Put rows in, the latest of each key stays; false if the batch was there already.

        keep, a function from the table after the upsert to what of it stays,
        prunes in the same step. Null keys are keys.
        """
        before = self.state()
        if batch is not None and batch <= before["batch"]:
            return False
        version = before["version"] + 1
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")
        columns = self.schema.fieldNames()
        staged = f"{self.path}/staged/{version}"
        rows.select(*columns, bucket).write.mode("overwrite").partitionBy("_bucket").parquet(staged)  # evaluated once
        new = self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(staged)
        touched = {r[0] for r in new.select("_bucket").distinct().collect()} if keep is None else set(range(self.buckets))  # at most `buckets` numbers
        merged = latest(self._folders(before, touched).unionByName(new.select(*columns)), key=self.key, order=self.order)
        kept = merged if keep is None else keep(merged)
        folder = f"v{version}"
        kept.select(*columns, bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        fs, at = self._hadoop("data", folder)
        written = {s.getPath().getName().split("=")[1] for s in fs.listStatus(at) if "=" in s.getPath().getName()}
        folders = {b: f for b, f in before["folders"].items() if int(b) not in touched} | dict.fromkeys(sorted(written), folder)
        self._point({"version": version, "batch": before["batch"] if batch is None else batch, "folders": folders})
        fs.delete(self._hadoop("staged", str(version))[1], True)
        return True

    def batch_writer(self):
        """For writeStream.foreachBatch: each batch once, however often it comes."""

        def write(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, batch)

        return write

    def vacuum(self) -> None:
        """Delete folders and pointers that the last version does not name."""
        state = self.state()
        fs, data = self._hadoop("data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in set(state["folders"].values()):
                fs.delete(s.getPath(), True)
        _, versions = self._hadoop("versions")
        for s in fs.listStatus(versions) if fs.exists(versions) else []:
            if s.getPath().getName() != f"{state['version']:012d}.json":
                fs.delete(s.getPath(), True)


def put_records(cache: KeyedTable, rows: DataFrame, now: float, batch: int | None = None) -> bool:
    """Put records (key, validated_at) into an image cache and prune it in the same step: old ones go, and all beyond the newest."""

    def kept(records: DataFrame) -> DataFrame:
        return records.join(prunable(records, F.lit(now)), "key", "left_anti")

    return cache.upsert(rows, batch, keep=kept)
