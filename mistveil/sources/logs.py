"""Log sinks and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import latest
from ..operators.metrics import CSV_COLUMNS, csv_line
from ..operators.order import numbered

SESSION = "session_id string, started_at double, backend_id string, backend_model string, models array<struct<capability:string,model_id:string,tier:int,compute:string>>"


def append(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").parquet(path)


def sessions(rows: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """The latest row of each session; loads (session_id, at, model) are appended to its models in order."""
    current = latest(rows, key=["session_id"], order="started_at")
    if loads is None:
        return current
    added = loads.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda m: m["model"]).alias("_added"))
    joined = current.join(added, "session_id", "left")
    return joined.withColumn("models", F.when(F.col("_added").isNull(), F.col("models")).otherwise(F.concat("models", "_added"))).drop("_added")


def write_json(records: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    records.write.json(path)


def write_export(records: DataFrame, sessions_: DataFrame, path: str) -> None:
    """Records and sessions as one JSON object {"records": [...], "sessions": [...]}, in text files that make it when put together in the order of their names.

    Rows are numbered by ranges, so no task holds all of them; only the first
    of each list lacks a comma before it.
    """

    def listed(rows: DataFrame, part: int) -> DataFrame:
        json = rows.select(F.to_json(F.struct(*rows.columns)).alias("_json"), F.monotonically_increasing_id().alias("_i"))
        comma = F.when(F.col("_place") == 0, "").otherwise(",")
        return numbered(json, ["_i"], name="_place").select(F.lit(part).alias("part"), F.col("_place").alias("place"), F.concat(comma, "_json").alias("value"))

    frame = records.sparkSession.createDataFrame([(0, 0, '{"records":['), (2, 0, '],"sessions":['), (4, 0, "]}")], "part int, place long, value string")
    whole = frame.unionByName(listed(records, 1)).unionByName(listed(sessions_, 3))
    whole.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("value").write.text(path)


def csv_lines(records: DataFrame) -> DataFrame:
    """Lines of the CSV export, without its header."""
    return records.select(csv_line(list(CSV_COLUMNS)).alias("line"))


def write_csv(records: DataFrame, path: str) -> None:
    """The CSV export as text files, each a CSV of its own with the header as its first line (a reader of the whole folder sees it once a file)."""
    header = ",".join(CSV_COLUMNS)

    def headed(frames):
        yield pd.DataFrame({"value": [header]})
        yield from frames

    csv_lines(records).withColumnRenamed("line", "value").mapInPandas(headed, "value string").write.text(path)


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
