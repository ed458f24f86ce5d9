"""Metrics of logs: percentiles, rates, summaries, recall and tables."""

from __future__ import annotations

import time
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import iou
from ..sources.tables import written
from .order import at_ranks

LOG = "session_id string, step int, op string, t_start double, t_end double, duration_ms double, outcome string, reason string, ref string, model_id string, tier int, compute string, queue_ms double, counts map<string,bigint>"

#: Columns of the CSV export.
CSV_COLUMNS = ("session_id", "step", "op", "t_start", "t_end", "duration_ms", "outcome", "reason", "ref", "model_id", "tier", "compute")


def percentiles(rows: DataFrame, *, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Per group count n and, for each rank p, the value at place floor(p * n) in order, the last at most.

    Values are first counted per distinct value; the places are then found in
    ranges of the order (order.at_ranks), so no task sees all values of a
    large group. Null values do not count; groups without others give no row.
    """
    values = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return at_ranks(values, by=by, value=value, count="_c", ranks=ranks)


def op_summary(logs: DataFrame) -> DataFrame:
    """p50, p95 and count of durations per op, and of queue waits where there are any."""
    ranks = {"p50": 0.5, "p95": 0.95}
    times = percentiles(logs, by=["op"], value="duration_ms", ranks=ranks)
    waits = percentiles(logs, by=["op"], value="queue_ms", ranks={"queue_p50": 0.5, "queue_p95": 0.95}).drop("n")
    return times.join(waits, "op", "left")


def rates(logs: DataFrame) -> DataFrame:
    """One row: cache hit rate (null without lookups) and the number of fail-closed outcomes."""
    hit, miss = F.count_if(F.col("op") == "image.cache_hit"), F.count_if(F.col("op") == "image.cache_miss")
    return logs.agg(F.try_divide(hit.cast("double"), (hit + miss).cast("double")).alias("hit_rate"), F.count_if(F.col("outcome") == "fail_closed").alias("fail_closed"))


def csv_line(columns: list[str]) -> Column:
    """One CSV line: a field is quoted only if it holds a quote, comma or line feed; null is empty."""

    def field(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in columns])


def breakdown(counts: DataFrame, *, by: list[str], kind: str = "kind", n: str = "n") -> DataFrame:
    """Counts by kind as text: "a 1, b 2"."""
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", F.col(kind), F.col(n).cast("string"))))
    return counts.groupBy(*by).agg(F.array_join(parts, ", ").alias("breakdown"))


def leak_candidates(residuals: DataFrame) -> Column:
    """Sum of residual counts that are no probable public addresses."""
    return F.coalesce(F.sum(F.when(F.col("kind") != "EMAIL_LIKELY_PUBLIC", F.col("n"))), F.lit(0))


#: Characters of canaries in one automaton; more canaries take several passes.
AUTOMATON_CHARS = 1_000_000


def _blocks(canaries: DataFrame, most: int):
    """Canaries as lists of (id, value) with about `most` characters each, chosen by hash: what goes to the tasks at once."""
    total = canaries.agg(F.sum(F.length("value"))).first()[0] or 0
    parts = -(-total // most) or 1
    for i in range(parts):
        yield [(r["id"], r["value"]) for r in canaries.where(F.pmod(F.xxhash64("id", "value"), F.lit(parts)) == i).collect()]


def canary_leaks(texts: DataFrame, canaries: DataFrame, *, text: str = "text", most: int = AUTOMATON_CHARS) -> DataFrame:
    """id and n, the number of texts in which a canary (id, value) stands verbatim; canaries in no text give no row.

    Texts are read once for each automaton over some `most` characters of
    canaries, whatever the number of canaries in it. Null texts and null
    values hold nothing; an empty value stands in every text.
    """
    kind, spark, out = canaries.schema["id"].dataType.simpleString(), texts.sparkSession, None
    for block in _blocks(canaries.where("value IS NOT NULL").select("id", "value"), most):
        named: dict[str, list] = {}
        for id_, value in block:
            named.setdefault(value, []).append(id_)
        values = spark.sparkContext.broadcast(named)

        def scan(frames, values=values):
            import ahocorasick

            always, automaton = values.value.get("", []), ahocorasick.Automaton()
            for value, ids in values.value.items():
                if value:
                    automaton.add_word(value, (value, ids))
            if len(automaton):
                automaton.make_automaton()
            for frame in frames:
                rows = []
                for t in frame["_text"]:
                    held = {value: ids for _, (value, ids) in automaton.iter(t)} if len(automaton) else {}
                    rows += [i for ids in held.values() for i in ids] + always
                yield pd.DataFrame({"id": pd.Series(rows, dtype=object)})

        found = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").mapInPandas(scan, f"id {kind}")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("id").agg(F.count("*").alias("n"))


def _same(columns: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def _without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that gone has no equal of, null to null."""
    named = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in columns])
    return rows.join(named, _same(columns, "_gone_"), "left_anti")


def match_boxes(truth: DataFrame, found: DataFrame, *, by: str = "img_id", least: float = 0.2, cell: float = 64.0) -> DataFrame:
    """by, truth_id, det_id, size: each true box with the detection that met it, if any; detections left over are false positives (truth null).

    One to one: true boxes in order of their id take the best free detection
    (the smaller id of equal ones) whose centre lies inside and that overlaps
    enough. Pairs come from a join of grid cells of `cell` pixels. Then rounds
    do for all images at once what the order does one by one: every true box
    asks for its best detection, one asked for by several goes to the smallest
    id for now, the others ask for their next best; when nobody is refused,
    the matches are those of the order. Boxes without a size or place match
    nothing.
    """
    sides = ("x", "y", "w", "h")
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell))
    sound = F.lit(True)
    for c in sides:
        sound = sound & F.col(c).isNotNull()
    boxes = truth.where(sound & (F.col("w") >= 0) & (F.col("h") >= 0)).select(F.col(by).alias("_img"), "truth_id", F.struct(*sides).alias("_t"), F.explode(span("x", "w")).alias("_cx"), "y", "h")
    boxes = boxes.select("_img", "truth_id", "_t", "_cx", F.explode(span("y", "h")).alias("_cy"))
    middle = lambda at, size: F.col(at) + F.col(size) / 2
    centres = found.where(sound).select(F.col(by).alias("_its"), "det_id", F.struct(*sides).alias("_d"), middle("x", "w").alias("_mx"), middle("y", "h").alias("_my"))
    centres = centres.withColumns({"_dx": F.floor(F.col("_mx") / cell), "_dy": F.floor(F.col("_my") / cell)})
    inside = F.col("_mx").between(F.col("_t.x"), F.col("_t.x") + F.col("_t.w")) & F.col("_my").between(F.col("_t.y"), F.col("_t.y") + F.col("_t.h"))
    met = boxes.join(centres, F.col("_img").eqNullSafe(F.col("_its")) & (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy"))).where(inside)
    pair = ["_img", "truth_id", "det_id"]
    open_ = written(met.select(*pair, iou(F.col("_t"), F.col("_d")).alias("_iou")).where(F.col("_iou") >= least), "pairs")
    while True:
        asked = open_.groupBy("_img", "truth_id").agg(F.max_by("det_id", F.struct("_iou", -F.col("det_id"))).alias("det_id"))
        held = asked.groupBy("_img", "det_id").agg(F.min("truth_id").alias("truth_id"))
        asked, held = written(asked, "asked"), written(held, "held")
        refused = _without(asked, held, pair)
        if not refused.limit(1).count():
            break
        open_ = written(_without(open_, refused, pair), "pairs")
    matched = held.select(F.col("_img").alias("_its"), F.col("truth_id").alias("_truth"), F.col("det_id").alias("_det"))
    ours = truth.join(matched, F.col(by).eqNullSafe(F.col("_its")) & (F.col("truth_id") == F.col("_truth")), "left").select(by, F.col("truth_id").cast("long").alias("truth_id"), F.col("_det").cast("long").alias("det_id"), F.col("size").cast("long").alias("size"))
    rest = found.join(matched, F.col(by).eqNullSafe(F.col("_its")) & (F.col("det_id") == F.col("_det")), "left_anti")
    none = F.lit(None).cast("long")
    return ours.unionByName(rest.select(by, none.alias("truth_id"), F.col("det_id").cast("long").alias("det_id"), none.alias("size")))


def recall_by_size(matched: DataFrame) -> DataFrame:
    """Recall per size of true boxes."""
    return matched.where("truth_id IS NOT NULL").groupBy("size").agg(F.count("*").alias("n"), F.count("det_id").alias("found"), (F.count("det_id") / F.count("*")).alias("recall"))


class Timer:
    """Collects log rows of timed driver-side steps; errors are logged by a code of a fixed list, never by their text."""

    def __init__(self, session_id: str, known_reasons: frozenset[str] = frozenset()):
        self.session_id, self.known, self.rows = session_id, known_reasons, []

    @contextmanager
    def timed(self, op: str, **extra):
        began, outcome, reason = time.time() * 1000, "ok", None
        try:
            yield
        except Exception as e:
            code = getattr(e, "reason", None)
            outcome, reason = "fail", code if code in self.known else "unknown"
            raise
        finally:
            ended = time.time() * 1000
            row = dict.fromkeys(c.strip().split(" ")[0] for c in LOG.split(", "))
            self.rows.append(row | {"session_id": self.session_id, "op": op, "t_start": began, "t_end": ended, "duration_ms": ended - began, "outcome": outcome, "reason": reason} | extra)
