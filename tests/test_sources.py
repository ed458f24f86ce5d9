"""Sources, sinks, metrics and streams."""

import json
from datetime import datetime, timedelta
from threading import Thread

from pyspark.sql import functions as F

from mistveil.operators import agent, metrics
from mistveil.sources import captures, logs
from mistveil.streaming import sessions


def test_captures(spark, tmp_path):
    wire = {"schema_version": "1", "session_id": "s", "step": 1, "task": "t", "page": {"url": "u", "title": "x"}, "dom": [{"node_id": "n0", "tag": "p", "content": {"text": "hi"}}]}
    files = {
        "wire.json": wire,
        "chat.json": {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": json.dumps(wire)}]},
        "net.har": {"log": {"entries": [{"request": {"url": "u", "postData": {"text": json.dumps(wire)}}}, {"request": {"url": "v"}}, {"request": {"url": "w", "postData": {"text": json.dumps({"messages": [{"role": "user", "content": json.dumps(wire)}]})}}}]}},
        "bad.json": "nothing",
        "empty.har": {"log": {"entries": []}},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
    rows = captures.read_captures(spark, str(tmp_path)).select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "at", "observation.task", "error").collect()
    got = sorted((r.file, r.at, r.task, r.error) for r in rows if r.error is None), sorted(r.file for r in rows if r.error)
    assert got == ([("chat.json", 0, "t", None), ("net.har", 0, "t", None), ("net.har", 1, "t", None), ("wire.json", 0, "t", None)], ["bad.json", "empty.har"])


def test_log_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "x", 1.0, 2.0, 1.0, "ok", None, None, None, None, None, None, {"units": 2})], metrics.LOG)
    logs.append(rows, str(tmp_path / "l"))
    logs.append(rows, str(tmp_path / "l"))
    assert logs.read_logs(spark, str(tmp_path / "l"), metrics.LOG).count() == 2
    assert logs.csv_lines(rows).first().line == "s,1,x,1.0,2.0,1.0,ok,,,,,"
    logs.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().op == "x"


def test_sessions_upsert(spark):
    rows = spark.createDataFrame([("s", 1.0, "b", None, []), ("s", 2.0, "c", None, []), ("t", 1.0, "b", None, [])], logs.SESSION)
    loads = spark.createDataFrame([("s", 2, ("ner", "m2", 1, "wasm")), ("s", 1, ("face", "m1", 1, "wasm"))], "session_id string, at int, model struct<capability:string,model_id:string,tier:int,compute:string>")
    got = {r.session_id: (r.backend_id, [m.model_id for m in r.models]) for r in logs.sessions(rows, loads).collect()}
    assert got == {"s": ("c", ["m1", "m2"]), "t": ("b", [])}


def test_percentile_rule(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(10, 101, 10)], "op string, v double")
    r = metrics.percentiles(rows, by=["op"], value="v", ranks={"p50": 0.5, "p95": 0.95}).first()
    assert (r.n, r.p50, r.p95) == (10, 60.0, 100.0)


def test_timer():
    class Slow(Exception):
        reason = "backend_error"

    timer = metrics.Timer("s", frozenset({"backend_error"}))
    for error in (None, Slow(), ValueError("secret text")):
        try:
            with timer.timed("x", step=1):
                if error:
                    raise error
        except Exception:  # noqa: BLE001
            pass
    assert [(r["outcome"], r["reason"]) for r in timer.rows] == [("ok", None), ("fail", "backend_error"), ("fail", "unknown")]
    assert "secret text" not in str(timer.rows)


def test_providers(spark):
    providers = spark.createDataFrame([("ner", "big", 1, True), ("ner", "small", 2, False), ("face", "f", 1, True)], "capability string, id string, preference int, needs_webgpu boolean")
    devices = spark.createDataFrame([("d", "ner", "wasm", None), ("e", "ner", "wasm", "big"), ("e", "face", "wasm", "nope")], "device string, capability string, compute string, override_id string")
    tries = agent.candidate_providers(providers, devices)
    assert sorted((r.device, r.id, r.place) for r in tries.collect()) == [("d", "small", 1), ("e", "big", 1), ("e", "small", 2)]
    loads = spark.createDataFrame([("d", "small", False), ("e", "small", True)], "device string, id string, ok boolean")
    assert {r.device: r.provider for r in agent.loaded_provider(tries, loads).collect()} == {"d": "empty", "e": "small"}


def test_responses(spark):
    texts = ['x {"thought":"{","actions":[{"type":"scroll","direction":"up"}],"done":true} y', '{"thought":"t","actions":[{"type":"scroll","direction":"left"}],"done":true}', None, '{"thought":"' + "x" * 201 + '","actions":[],"done":true}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", agent.parse_response(F.col("t")).alias("r")).collect()
    assert [r.r is not None for r in sorted(rows, key=lambda r: r.i)] == [True, False, False, False]


def test_session_stream(spark, tmp_path):
    schema = "session_id string, origin string, unit long, ts timestamp, text string, ends boolean"
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = sessions.session_tokens(stream).writeStream.format("memory").queryName("tokens_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    batches = [
        [("s", "o", 1, at(0), "a@b.example and c@d.example", False), ("t", "o", 1, at(0), "x@y.example", False)],
        [("s", "p", 2, at(1), "C@d.example", False), ("s", "o", 3, at(2), "a@b.example", True)],
        [("s", "o", 4, at(3), "new@x.example", False), ("s", "o", 5, None, "lost@x.example", False)],
        [("u", "o", 1, at(60), "late@x.example", False)],  # the watermark ends session t
        [("t", "o", 9, at(61), "z@y.example", False)],
    ]
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            ran = Thread(target=q.processAllAvailable, daemon=True)
            ran.start()
            ran.join(60)
            assert not ran.is_alive()
    finally:
        q.stop()
    got = [(r.session_id, r.unit, r.token) for r in spark.table("tokens_out").orderBy("session_id", "unit", "start").collect()]
    first = [("s", 1, "[PII_EMAIL_1]"), ("s", 1, "[PII_EMAIL_2]"), ("s", 2, "[PII_EMAIL_3]"), ("s", 3, "[PII_EMAIL_1]"), ("s", 4, "[PII_EMAIL_1]")]
    assert got == [*first, ("t", 1, "[PII_EMAIL_1]"), ("t", 9, "[PII_EMAIL_1]"), ("u", 1, "[PII_EMAIL_1]")]


def test_log_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "x", 1.0, 2.0, 1.0, "ok", None, None, None, None, None, None, None)], metrics.LOG)
    rows.write.parquet(str(tmp_path / "in"))
    q = sessions.flush_logs(spark.readStream.schema(metrics.LOG).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.schema(metrics.LOG).parquet(str(tmp_path / "out")).count() == 1


def test_columns_are_pruned(spark, folder):
    from mistveil.plans.queries import QUERIES

    plan = QUERIES["spans_email"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_csv_files_start_with_the_header(spark, tmp_path):
    row = {c: None for c in metrics.CSV_COLUMNS}
    rows = spark.createDataFrame([tuple((row | {"op": op}).values()) for op in ("x", "a,b", "y")], ", ".join(f"{c} string" for c in metrics.CSV_COLUMNS)).repartition(2)
    logs.write_csv(rows, str(tmp_path / "csv"))
    files = [f.read_text().splitlines() for f in (tmp_path / "csv").glob("part-*")]
    assert files and all(f[0] == ",".join(metrics.CSV_COLUMNS) for f in files) and sum(len(f) - 1 for f in files) == 3
    assert sum('"a,b"' in line for f in files for line in f) == 1
