"""Reports of observations and benchmarks: counts per observation, tables side by side, Markdown of small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .residuals import residual_scan

#: What a captured answer of the observing side may hold.
CAPTURED = "struct<status:string,observation:struct<dom:array<struct<marker:string,image:string,image_omitted:string,trimmed:boolean,content:map<string,string>>>,images:array<string>,truncated:boolean>>"
#: Fixed value: tokens with their type.
NAMED_TOKEN = r"\[PII_([A-Z]+(?:_[A-Z]+)*)_[0-9]+\]"


def counted(values: Column) -> Column:
    """How often each value comes in an array, as a map; nulls do not count."""
    known = F.array_compact(values)
    keys = F.array_sort(F.array_distinct(known))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(known, lambda v: v == k)).cast("long")))


def _kb(chars: Column) -> Column:
    return F.floor(F.greatest(chars, F.lit(0)) / 1024 + 0.5).cast("long")


def observation_summary(answers: DataFrame, *, by: list[str], json: str = "json", origin: Column | None = None) -> DataFrame:
    """One row an answer: by, outcome (ok, blocked or error) and, if ok, nodes, content_fields, tokens, markers, image_nodes, images_sent, images_omitted, text_kb, images_kb, truncated, trimmed_nodes, residual.

    json: {"status": ..., "observation": {...}}. tokens counts distinct tokens
    by type; residual counts what the patterns still find in all strings but
    images, where origin (over columns of by) is the page's. No values come
    out. Null and unreadable answers are errors.
    """
    read = answers.select(*by, F.col(json).alias("_json"), F.from_json(json, CAPTURED).alias("_a"))
    outcome = F.when(F.col("_a.status") == "blocked", "blocked").when((F.col("_a.status") == "ok") & F.col("_a.observation").isNotNull(), "ok").otherwise("error")
    dom = F.coalesce("_a.observation.dom", F.array().cast("array<struct<marker:string,image:string,image_omitted:string,trimmed:boolean,content:map<string,string>>>"))
    of = lambda name: F.transform(dom, lambda n: n[name])
    tokens = F.array_distinct(F.regexp_extract_all("_json", F.lit(NAMED_TOKEN), F.lit(0)))
    whole, images = F.length(F.get_json_object("_json", "$.observation")), F.coalesce(F.length(F.get_json_object("_json", "$.observation.images")), F.lit(0))
    shown = {
        "nodes": F.size(dom).cast("long"),
        "content_fields": F.aggregate(dom, F.lit(0).cast("long"), lambda a, n: a + F.coalesce(F.size(n["content"]), F.lit(0))),
        "tokens": counted(F.transform(tokens, lambda t: F.regexp_extract(t, NAMED_TOKEN, 1))),
        "markers": counted(of("marker")),
        "image_nodes": F.size(F.array_compact(of("image"))).cast("long"),
        "images_sent": F.coalesce(F.size("_a.observation.images"), F.lit(0)).cast("long"),
        "images_omitted": counted(of("image_omitted")),
        "text_kb": _kb(whole - images),
        "images_kb": _kb(images - 2),
        "truncated": F.coalesce("_a.observation.truncated", F.lit(False)),
        "trimmed_nodes": F.size(F.filter(dom, lambda n: F.coalesce(n["trimmed"], F.lit(False)))).cast("long"),
    }
    rows = read.withColumn("outcome", F.coalesce(outcome, F.lit("error")))
    fine = F.col("outcome") == "ok"
    wide = rows.select(*by, "outcome", *[F.when(fine, c).alias(name) for name, c in shown.items()])
    left = residual_scan(rows.where(fine).select(*by, F.get_json_object("_json", "$.observation").alias("_observation")), by=by, json="_observation", origin=origin).where("kind IS NOT NULL")
    listed = left.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("residual"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = wide.join(listed, same, "left")
    return joined.select(*wide.columns, F.when(fine, F.coalesce("residual", F.create_map().cast("map<string,bigint>"))).alias("residual"))


def effective(runs: DataFrame) -> DataFrame:
    """Runs (requested, compute, ...) whose numbers may be shown: one that was to use webgpu and fell back to something else is out."""
    return runs.where(~((F.col("requested") == "webgpu") & ~F.coalesce(F.col("compute") == "webgpu", F.lit(False))))


def side_by_side(runs: DataFrame, order: list[str]) -> DataFrame:
    """op, p50, p95 and n (and queue_p50, queue_p95) of wasm and of webgpu runs next to each other, with place: ops in the given order, others after it by name.

    runs: requested, compute, op, p50, p95, n, queue_p50, queue_p95. Runs that
    fell back are left out.
    """
    shown = ("p50", "p95", "n", "queue_p50", "queue_p95")
    wide = effective(runs).groupBy("op").pivot("requested", ["wasm", "webgpu"]).agg(*[F.first(c).alias(c) for c in shown])
    place = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col("op")), F.lit(0)), F.lit(len(order) + 1))
    return wide.withColumn("place", place.cast("int"))


def model_loads(loads: DataFrame) -> DataFrame:
    """model_id with what loading took and where it ran, for wasm and for webgpu runs; failed ones say so.

    loads: requested, compute (of the run), model_id, load_ms, ran_on, outcome.
    """
    cell = F.when(F.col("outcome") == "ok", F.concat(F.round("load_ms").cast("long").cast("string"), F.lit(" ("), "ran_on", F.lit(")"))).otherwise(F.concat(F.lit("failed ("), "outcome", F.lit(")")))
    return effective(loads).groupBy("model_id").pivot("requested", ["wasm", "webgpu"]).agg(F.first(cell))


def as_text(counts: Column) -> Column:
    """A map of counts as "a 1, b 2", largest first, then by name; empty: "-"."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], (-e["n"]).cast("string"))), ", ")
    return F.when(text == "", "-").otherwise(text)


def site_table(summaries: DataFrame, *, by: list[str]) -> DataFrame:
    """Summaries as rows of the table of sites; counts as text, leak candidates (all residuals but probably public addresses) apart."""
    leaks = F.aggregate(F.map_entries(F.map_filter("residual", lambda k, _: k != "EMAIL_LIKELY_PUBLIC")), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    maps = {c: as_text(F.col(c)) for c in ("tokens", "markers", "images_omitted")}
    return summaries.select(*by, "outcome", "nodes", "content_fields", *[F.when(F.col("outcome") == "ok", c).alias(n) for n, c in maps.items()], "image_nodes", "images_sent", "text_kb", "images_kb", "truncated", "trimmed_nodes", leaks.alias("leak_candidates"))


def recall_table(matched: DataFrame) -> DataFrame:
    """Found of true boxes by size, the largest first, as text "7/9"; and false positives in the row with a null size."""
    sizes = matched.where("truth_id IS NOT NULL").groupBy("size").agg(F.count("det_id").alias("found"), F.count("*").alias("of"))
    wrong = matched.where("truth_id IS NULL").agg(F.count("*").alias("found")).select(F.lit(None).cast("long").alias("size"), "found", F.lit(None).cast("long").alias("of"))
    text = F.when(F.col("of").isNull(), F.col("found").cast("string")).otherwise(F.concat_ws("/", F.col("found").cast("string"), F.col("of").cast("string")))
    return sizes.unionByName(wrong).select("size", text.alias("found")).orderBy(F.desc_nulls_last("size"))


def markdown_table(rows: DataFrame, *, most: int = 1000) -> str:
    """A small result as a Markdown table; one of more than `most` rows is an error, since it passes through the driver."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a table of more than {most} rows is no report; aggregate it first")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in held])


def put_section(document: str, heading: str, body: str) -> str:
    """document with the section under a heading ("## ...") replaced, or added at its end."""
    parts = document.split("\n## ")
    for i, part in enumerate(parts):
        if part.split("\n", 1)[0].removeprefix("## ") == heading:
            parts[i] = f"{heading}\n\n{body}\n" if i else f"## {heading}\n\n{body}\n"
            return "\n## ".join(parts)
    return f"{document.rstrip()}\n\n## {heading}\n\n{body}\n".lstrip()
