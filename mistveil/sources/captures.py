"""Captured traffic: HAR files, chat requests and wire observations become observation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.agent import first_json_object

OBSERVATION = "struct<schema_version:string,session_id:string,step:int,task:string,page:struct<url:string,title:string>,dom:array<struct<node_id:string,tag:string,parent_id:string,content:map<string,string>>>>"
HAR = "struct<log:struct<entries:array<struct<request:struct<url:string,postData:struct<text:string>>>>>>"
CHAT = "struct<messages:array<struct<role:string,content:string>>>"


def observations_in(text: Column) -> Column:
    """Observations in a captured text, of any of three shapes: a HAR file, a chat body, a wire observation. Null if it is none of them."""
    wire = lambda t: F.from_json(t, OBSERVATION)
    sound = lambda o: o["schema_version"].isNotNull() & o["dom"].isNotNull()
    chat = lambda t: F.transform(F.filter(F.from_json(t, CHAT)["messages"], lambda m: m["role"] == "user"), lambda m: wire(m["content"]))
    posted = F.transform(F.filter(F.from_json(text, HAR)["log"]["entries"], lambda e: e["request"]["postData"]["text"].isNotNull()), lambda e: e["request"]["postData"]["text"])
    in_posts = F.flatten(F.transform(posted, lambda t: F.concat(F.array(wire(t)), F.coalesce(chat(t), F.array().cast(f"array<{OBSERVATION}>")))))
    one = wire(text)
    found = F.when(F.from_json(text, HAR)["log"]["entries"].isNotNull(), in_posts).when(sound(one), F.array(one)).otherwise(chat(text))
    kept = F.filter(found, lambda o: o.isNotNull() & F.coalesce(sound(o), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """file, at, observation for each observation of the files under path; files without any give one row with error."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    found = files.withColumn("found", observations_in(F.col("value")))
    rows = found.select("file", F.posexplode_outer("found").alias("at", "observation"))
    return rows.withColumn("error", F.when(F.col("observation").isNull(), "unreadable"))


#: What stands before the value of each entry's request. In a JSON string its quotes would have backslashes, so it never matches inside one.
ENTRY_MARK = '"request":'
REQUEST = "struct<method:string,url:string,postData:struct<text:string>>"


def har_requests(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, url, text, error: one row a request of the HAR files under path, in file order by (block, line).

    A file is split by bytes like any text file whose lines end with the mark
    of a request, so a long capture is read by several tasks and a task holds
    one entry at a time. text is what was posted (null: nothing). A request
    whose JSON does not end or has no URL gives a row with error; the other
    entries of its file are read all the same. Empty files give no rows.
    """
    lines = spark.read.option("lineSep", ENTRY_MARK).text(path)
    meta = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    # What comes before the first request of a file starts with its header, whose object is still open.
    body = meta.where(~F.col("value").rlike(r'^﻿?\s*\{\s*"log"\s*:') & (F.trim("value") != ""))
    read = body.withColumn("_r", F.from_json(first_json_object(F.col("value")), REQUEST))
    bad = F.col("_r").isNull() | F.col("_r.url").isNull()
    return read.select("file", "block", "line", F.col("_r.url").alias("url"), F.col("_r.postData.text").alias("text"), F.when(bad, "unreadable").alias("error"))


def har_observations(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, at, observation, error: observations posted in the HAR files under path, and unreadable requests."""
    found = har_requests(spark, path).withColumn("found", observations_in(F.col("text")))
    rows = found.where(F.col("error").isNotNull() | F.col("found").isNotNull())
    return rows.select("file", "block", "line", F.posexplode_outer("found").alias("at", "observation"), "error")
