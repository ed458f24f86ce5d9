"""Assembly of observations, checks on agents' actions, and replay of sessions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import TOKEN
from .detect import guard_triggered
from .tokens import tokens_in
from .windows import merge_windows

#: Fixed values.
MAX_ACTIONS, MAX_THOUGHT, MAX_WAIT_MS, MAX_STEPS = 3, 200, 3000, 10

ACTION = "struct<type:string,node_id:string,text:string,submit:boolean,value:string,direction:string,url:string,ms:double>"
RESPONSE = f"struct<thought:string,actions:array<{ACTION}>,done:boolean,answer:string>"


def contents(results: DataFrame, nodes: DataFrame, *, by: list[str]) -> DataFrame:
    """nodes with content, a map from field to sanitized text: windows merged, secret values hidden.

    results: by, node, field, window, text. A field with a withheld (null)
    text has no content.
    """
    results = results.where("text IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("window", "text"))), lambda r: r["text"])
    fields = results.groupBy(*by, "node", "field").agg(ordered.alias("texts"))
    joined = F.when((F.col("field") == "text") & (F.size("texts") > 1), merge_windows(F.col("texts"))).otherwise(F.get("texts", F.lit(0)))
    entries = fields.groupBy(*by, "node").agg(F.collect_list(F.struct("field", joined.alias("text"))).alias("_entries"))
    found = F.coalesce(F.col("_entries"), F.array().cast("array<struct<field:string,text:string>>"))
    secret = F.coalesce(F.col("secret"), F.lit(False))
    open_fields = F.filter(found, lambda e: ~(secret & (e["field"] == "value")))
    hidden = F.array(F.struct(F.lit("value").alias("field"), F.lit("[SECRET]").alias("text")))
    all_fields = F.array_sort(F.when(secret, F.concat(open_fields, hidden)).otherwise(open_fields))
    return nodes.join(entries, [*by, "node"], "left").withColumn("content", F.map_from_entries(all_fields)).drop("_entries")


def assemble(pages: DataFrame, nodes: DataFrame, *, by: list[str]) -> DataFrame:
    """One observation a page: the columns of pages (by, task, url, title), dom, status (ok or blocked).

    A page is blocked if its task, URL, title or content still holds an
    identifier that is no e-mail address; its dom is then withheld.
    """
    shown = [c for c in nodes.columns if c not in by]
    dom = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", *[F.to_json(c).alias(c) if dict(nodes.dtypes)[c].startswith("map") else F.col(c) for c in shown if c != "node"]))).alias("dom"), F.flatten(F.collect_list(F.map_values("content"))).alias("_texts"))
    joined = pages.join(dom, by, "left")
    own = F.array_compact(F.array("task", "url", "title"))
    bad = guard_triggered(F.concat(own, F.coalesce("_texts", F.array().cast("array<string>"))))
    out = joined.withColumn("status", F.when(bad, "blocked").otherwise("ok")).drop("_texts")
    return out.withColumn("dom", F.when(F.col("status") == "ok", F.col("dom")))


def to_wire(observations: DataFrame, *, by: list[str]) -> DataFrame:
    """Observations that may be sent, as JSON.

    images, an array of (img_id, node), if there, shows as image_index from
    img_id to node; of equal images the last node counts.
    """
    sent = observations.where("status = 'ok'")
    shown = [F.col(c) for c in sent.columns if c != "images"]
    if "images" in sent.columns:
        keys = F.array_distinct(F.transform("images", lambda i: i["img_id"]))
        last = lambda k: F.element_at(F.filter("images", lambda i: i["img_id"] == k), -1)["node"]
        shown.append(F.map_from_arrays(keys, F.transform(keys, last)).alias("image_index"))
    return sent.select(*by, F.to_json(F.struct(F.lit("1").alias("schema_version"), *shown)).alias("json"))


def image_data(images: Column) -> Column:
    """Binary data of images as base64, for the wire."""
    return F.transform(images, lambda i: i.withField("data", F.base64(i["data"])))


def balanced(text: str | None) -> str | None:
    """What stands from the first brace of a text to its partner; braces inside strings do not count. Null without a partner."""
    start, depth, quoted, at = (text or "").find("{"), 0, False, 0
    at = start
    while 0 <= at < len(text or ""):
        c = text[at]
        if quoted:
            at += c == "\\"  # what follows a backslash is part of the string
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


def first_json_object(text: Column) -> Column:
    """The first balanced {...} of a text, if that is JSON; else null. Later or inner objects are never taken in its place."""

    def scan(value: str | None) -> str | None:
        found = balanced(value)
        try:
            return found if found is not None and isinstance(json.loads(found), dict) else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        return values.map(scan, na_action="ignore")

    return find(text)


def is_action(a: Column) -> Column:
    """Whether an action has what its kind needs."""
    has = lambda *names: F.reduce(F.array(*[a[n].isNotNull() for n in names]), F.lit(True), lambda x, y: x & y)
    fine = (
        F.when(a["type"].isin("click", "scroll_to"), has("node_id"))
        .when(a["type"] == "type", has("node_id", "text"))
        .when(a["type"] == "select", has("node_id", "value"))
        .when(a["type"] == "scroll", a["direction"].isin("up", "down"))
        .when(a["type"] == "navigate", has("url"))
        .when(a["type"] == "wait", a["ms"] <= MAX_WAIT_MS)
    )
    return F.coalesce(fine, F.lit(False))


def is_response(r: Column) -> Column:
    """Whether a parsed response is complete and within its limits."""
    sound = (F.length(r["thought"]) <= MAX_THOUGHT) & r["done"].isNotNull() & (F.size(r["actions"]) <= MAX_ACTIONS) & F.forall(r["actions"], is_action)
    return F.coalesce(sound, F.lit(False))


def parse_response(text: Column) -> Column:
    """The response inside a model's answer; null if it is not valid."""
    parsed = F.from_json(first_json_object(text), RESPONSE)
    return F.when(is_response(parsed), parsed)


def is_capabilities(c: Column) -> Column:
    """Three whole numbers, none negative: context and image size above 0, images any."""
    whole = [c[n].isNotNull() & (c[n] >= 0) & (F.floor(c[n]) == c[n]) for n in ("max_context_tokens", "max_images", "max_image_bytes")]
    return F.coalesce(whole[0] & whole[1] & whole[2] & (c["max_context_tokens"] > 0) & (c["max_image_bytes"] > 0), F.lit(False))


def check_policy(actions: DataFrame, nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """actions with reason: null if allowed, else why it is blocked.

    actions: session_id, step, idx, page_origin, type, node_id, text, value,
    url. nodes: session_id, step, node_id, tag, role, secret, form_origin.
    tokens: session_id, token, origin. A token must be known and belong to the
    page's origin; nothing is typed into secret or foreign forms; tokens never
    go into URLs.
    """
    said = F.when(F.col("type") == "type", F.col("text")).when(F.col("type") == "select", F.col("value"))
    used = actions.select("session_id", "step", "idx", "page_origin", F.explode(tokens_in(said)).alias("token"))
    owners = tokens.select("session_id", "token", F.col("origin").alias("_origin")).distinct()
    judged = used.join(owners, ["session_id", "token"], "left").groupBy("session_id", "step", "idx").agg(
        F.max(F.col("_origin").isNull()).alias("_unknown"), F.max(F.coalesce(F.col("_origin") != F.col("page_origin"), F.lit(False))).alias("_foreign")
    )
    places = nodes.select("session_id", "step", "node_id", F.col("tag").alias("_tag"), F.col("role").alias("_role"), F.coalesce("secret", F.lit(False)).alias("_secret"), F.col("form_origin").alias("_form"))
    rows = actions.join(places, ["session_id", "step", "node_id"], "left").join(judged, ["session_id", "step", "idx"], "left")
    editable = F.coalesce(F.col("_tag").isin("input", "textarea") | (F.col("_role") == "textbox"), F.lit(False)) & ~F.coalesce("_secret", F.lit(False))
    foreign_form = F.coalesce(F.col("_form") != F.col("page_origin"), F.lit(False))
    scheme = F.lower(F.regexp_extract("url", r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    url_bad = F.col("url").isNull() | F.col("url").rlike(TOKEN) | ~scheme.isin("", "http", "https")
    writes = F.col("type").isin("type", "select")
    reason = (
        F.when((F.col("type") == "navigate") & url_bad, "policy_url_token")
        .when((F.col("type") == "type") & ~editable, "policy_target")
        .when((F.col("type") == "select") & F.col("_tag").isNull(), "policy_target")
        .when(writes & foreign_form, "policy_form_origin")
        .when(writes & F.coalesce("_unknown", F.lit(False)), "policy_unknown_token")
        .when(writes & F.coalesce("_foreign", F.lit(False)), "policy_cross_origin")
    )
    return rows.select(*actions.columns, reason.alias("reason"))


def until_blocked(checked: DataFrame) -> DataFrame:
    """checked actions with result: run before the first blocked one of a step, blocked, then not_run."""
    first = F.min(F.when(F.col("reason").isNotNull(), F.col("idx"))).over(Window.partitionBy("session_id", "step"))
    at = checked.withColumn("_first", first)
    result = F.when(F.col("_first").isNull() | (F.col("idx") < F.col("_first")), "run").when(F.col("idx") == F.col("_first"), "blocked").otherwise("not_run")
    return at.withColumn("result", result).drop("_first")


def padded_results(checked: DataFrame, done: DataFrame) -> DataFrame:
    """until_blocked() rows with the outcomes of those that ran (session_id, step, idx, outcome); missing ones are not_run."""
    joined = until_blocked(checked).join(done, ["session_id", "step", "idx"], "left")
    return joined.withColumn("result", F.when(F.col("result") == "run", F.coalesce("outcome", F.lit("not_run"))).otherwise(F.col("result"))).drop("outcome")


def first_valid(attempts: DataFrame) -> DataFrame:
    """Of a step's answers (session_id, step, attempt, answer) the first valid one as response, of two attempts at most; else reason."""
    parsed = attempts.where("attempt <= 2").withColumn("response", parse_response(F.col("answer")))
    best = F.min_by("response", F.when(F.col("response").isNotNull(), F.col("attempt")))
    out = parsed.groupBy("session_id", "step").agg(best.alias("response"))
    return out.withColumn("reason", F.when(F.col("response").isNull(), "backend_invalid_response"))


def scripted(steps: DataFrame, script: DataFrame) -> DataFrame:
    """The mock backend: the script's response of a step, or one that does nothing."""
    idle = F.lit('{"thought":"","actions":[],"done":true}')
    return steps.join(script, ["session_id", "step"], "left").withColumn("response", F.coalesce("response", idle))


def history(results: DataFrame) -> DataFrame:
    """Session history: results of each step in order, up to the step limit and the first step that is done.

    results: session_id, step (from 1), idx, type, result, and done where the
    step's response said so (null: not).
    """
    finished = F.min(F.when(F.col("done"), F.col("step"))).over(Window.partitionBy("session_id"))
    kept = results.withColumn("_end", F.coalesce(finished, F.lit(MAX_STEPS))).where(F.col("step") <= F.least("_end", F.lit(MAX_STEPS)))
    return kept.groupBy("session_id", "step").agg(F.array_sort(F.collect_list(F.struct("idx", "type", "result"))).alias("actions"))


def candidate_providers(providers: DataFrame, devices: DataFrame) -> DataFrame:
    """Providers to try on each device, in order: the override if it exists, then those the device can run.

    providers: capability, id, preference, needs_webgpu. devices: device, capability, compute, override_id.
    """
    pairs = devices.join(providers, "capability")
    chosen = F.coalesce(F.col("id") == F.col("override_id"), F.lit(False))
    able = ~F.col("needs_webgpu") | (F.col("compute") == "webgpu")
    order = Window.partitionBy("device", "capability").orderBy(F.desc(chosen), "preference")
    return pairs.where(chosen | able).withColumn("place", F.row_number().over(order)).select("device", "capability", "id", "place")


def loaded_provider(candidates: DataFrame, loads: DataFrame) -> DataFrame:
    """The first candidate that loads (loads: device, id, ok); none: "empty" for taggers, "reject" for detectors."""
    tried = candidates.join(loads, ["device", "id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    best = F.min_by("id", F.when(F.col("ok"), F.col("place")))
    fallback = F.when(F.col("capability") == "ner", "empty").otherwise("reject")
    return tried.groupBy("device", "capability").agg(best.alias("id")).withColumn("provider", F.coalesce("id", fallback)).drop("id")
