"""Keyed tables, agent sessions as state, and matching of boxes."""

import random
from datetime import datetime, timedelta
from threading import Thread

import pytest
from pyspark.sql import functions as F

from mistveil.operators import agent, metrics
from mistveil.operators import tokens as T
from mistveil.operators.detect import with_spans
from mistveil.sources import keyed
from mistveil.streaming import agents, sessions

# --- Keyed tables ---

RECORD = "key string, at long, value string"


@pytest.fixture
def keep(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "keyed"), RECORD, key=["key"], order="at", buckets=4)


def rows_of(frame):
    return sorted((r.key or "", r.at, r.value) for r in frame.collect())


def test_upserts_keep_the_latest_and_replays_change_nothing(spark, keep):
    assert keep.read().count() == 0 and keep.state()["batch"] == -1
    one = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), (None, 1, "n"), ("a", 3, "z")], RECORD)
    two = spark.createDataFrame([("b", 4, "old"), ("c", 1, "new"), ("a", 9, "last")], RECORD)
    assert keep.upsert(one, 0) and rows_of(keep.read()) == [("", 1, "n"), ("a", 3, "z"), ("b", 5, "y")]
    assert keep.upsert(two, 1)
    want = [("", 1, "n"), ("a", 9, "last"), ("b", 5, "y"), ("c", 1, "new")]
    before = keep.state()
    assert rows_of(keep.read()) == want and not keep.upsert(one, 1) and not keep.upsert(two, 0)
    assert rows_of(keep.read()) == want and keep.state() == before
    assert rows_of(keep.get(spark.createDataFrame([("a",), ("zz",)], "key string"))) == [("a", 9, "last")]
    keep.vacuum()
    assert rows_of(keep.read()) == want
    assert keep.upsert(one.limit(0), 2) and rows_of(keep.read()) == want


def test_a_writer_that_dies_leaves_the_table(spark, keep, monkeypatch):
    keep.upsert(spark.createDataFrame([("a", 1, "x")], RECORD), 0)
    monkeypatch.setattr(keep, "_point", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        keep.upsert(spark.createDataFrame([("a", 2, "y")], RECORD), 1)
    assert rows_of(keep.read()) == [("a", 1, "x")]
    monkeypatch.undo()
    assert keep.upsert(spark.createDataFrame([("a", 2, "y")], RECORD), 1) and rows_of(keep.read()) == [("a", 2, "y")]


def test_a_stream_upserts_by_batch(spark, keep, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], RECORD).coalesce(1).write.json(str(tmp_path / "in"))
    run = lambda: spark.readStream.schema(RECORD).json(str(tmp_path / "in")).writeStream.foreachBatch(keep.batch_writer()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    run()
    spark.createDataFrame([("a", 2, "z")], RECORD).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert rows_of(keep.read()) == [("a", 2, "z"), ("b", 1, "y")] and keep.state()["batch"] == 1


def test_cache_puts_and_prunes_in_one_step(spark, tmp_path):
    cache = keyed.KeyedTable(spark, str(tmp_path / "cache"), "key string, validated_at double", key=["key"], order="validated_at", buckets=3)
    day = 24 * 60 * 60 * 1000.0
    keyed.put_records(cache, spark.createDataFrame([(f"k{i}", day + i) for i in range(320)] + [("stale", 1.0)], "key string, validated_at double"), 2 * day)
    left = {r.key for r in cache.read().collect()}
    assert left == {f"k{i}" for i in range(20, 320)}
    keyed.put_records(cache, spark.createDataFrame([("k20", 2 * day)], "key string, validated_at double"), 2 * day + 25)
    assert {r.key for r in cache.read().collect()} == {f"k{i}" for i in range(25, 320)} | {"k20"}


# --- Sessions ---


def at(minute, second=0):
    return datetime(2024, 1, 1) + timedelta(minutes=minute, seconds=second)


def event(session, seq, kind, minute=0, **more):
    row = {"session_id": session, "ts": at(minute, seq), "seq": seq, "kind": kind} | more
    return tuple(row.get(c.split(" ")[0]) for c in agents.EVENT.split(", "))


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def stream(spark, tmp_path, batches):
    (tmp_path / "in").mkdir()
    q = agents.agent_sessions(spark.readStream.schema(agents.EVENT).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("agents_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, agents.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            ran = Thread(target=q.processAllAvailable, daemon=True)
            ran.start()
            ran.join(120)
            assert not ran.is_alive()
    finally:
        q.stop()
    return {(r.session_id, r.seq): r for r in spark.table("agents_out").collect()}


def test_sessions_as_state(spark, tmp_path, state_store):
    text = lambda s, n, t, minute=0, origin="o": event(s, n, "text", minute, origin=origin, unit=n, text=t)
    batches = [
        [text("s", 1, "mail a@b.example"), text("s", 2, "mail a@b.example"), text("s", 3, "PAN ABCPE1234F"), text("t", 1, "x@y.example")],
        [text("s", 4, "abcpe1234f again", 1), text("s", 5, "a@b.example", 1, "p"), event("s", 6, "step", 1, step=1, thought="go", actions=["click", "type", "wait"], blocked_at=2), event("s", 7, "results", 2, step=1, results=["ok"])],
        [event("s", 8, "results", 3, step=1, results=["ok"]), event("s", 9, "step", 3, step=2, thought="end", actions=["wait"]), event("s", 10, "results", 3, step=2, results=["ok"]), event("s", 11, "stop", 3)],
        [text("s", 12, "new@x.example", 4), text("u", 1, "q@y.example", 90)],
        [text("t", 9, "z@y.example", 91)],
    ]
    got = stream(spark, tmp_path, batches)
    shown = {k: (r.text, r.memo) for k, r in got.items() if r.kind == "text"}
    assert shown["s", 1] == ("mail [PII_EMAIL_1]", False) and shown["s", 2] == ("mail [PII_EMAIL_1]", False)  # known by now: no memo
    assert shown["s", 4] == ("[PII_PAN_1] again", False) and shown["s", 5] == ("[PII_EMAIL_2]", False)
    assert shown["s", 12] == ("[PII_EMAIL_1]", False)  # cleared by the stop
    assert shown["t", 1] == ("[PII_EMAIL_1]", False) and shown["t", 9] == ("[PII_EMAIL_1]", False)  # t timed out
    assert got["s", 7].results == ["ok", "not_run", "blocked"] and ("s", 8) not in got and got["s", 11].results == ["1", "2"]


def test_memo_and_the_same_as_in_batch(spark, tmp_path, state_store):
    """Texts without known values come from the memo; tokens and results are those of the batch operators."""
    said = ["nothing here", "a@b.example and c@d.example", "nothing here", "c@d.example", "PAN ABCPE1234F, a@b.example"]
    rows = [event("s", i, "text", origin="o", unit=i, text=t) for i, t in enumerate(said)]
    actions, ran, blocked = ["a", "b", "c", "d"], ["ok", "failed"], 3
    rows += [event("s", 10, "step", step=1, thought="t", actions=actions, blocked_at=blocked), event("s", 11, "results", step=1, results=ran)]
    got = stream(spark, tmp_path, [rows[:3], rows[3:]])
    assert got["s", 2].memo and not got["s", 0].memo
    units = with_spans(spark.createDataFrame([("s", "o", i, t) for i, t in enumerate(said)], "session_id string, origin string, unit long, text string"))
    found = T.occurrences(units)
    want = {r.unit: r.text for r in T.rewrite(units, found, T.token_map(found)).collect()}
    assert {k[1]: r.text for k, r in got.items() if r.kind == "text"} == want
    checked = spark.createDataFrame([("s", 1, i, "policy_target" if i == blocked else None) for i in range(4)], "session_id string, step int, idx int, reason string")
    done = spark.createDataFrame([("s", 1, i, r) for i, r in enumerate(ran)], "session_id string, step int, idx int, outcome string")
    replay = agent.padded_results(checked, done).orderBy("idx").collect()
    assert got["s", 11].results == [r.result for r in replay]


def test_known_places_are_those_of_the_batch():
    assert agents.known_places("priya sharma met Priya, not Priyanka [PII_NAME_1]", [("NAME", "Priya"), ("NAME", "Priya Sharma")]) == [(0, 12, "NAME"), (17, 22, "NAME")]
    assert agents.TTL_MS == sessions.TTL_MS


# --- Boxes ---


def overlap(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


def in_order(truth, found, least=0.2):
    """True boxes in order, each with its best free detection."""
    out, images = [], {r[0] for r in truth} | {r[0] for r in found}
    for img in images:
        free = sorted((r[1:] for r in found if r[0] == img), key=lambda d: d[0])
        for _, t_id, size, *t in sorted((r for r in truth if r[0] == img), key=lambda r: r[1]):
            inside = [d for d in free if t[0] <= d[1] + d[3] / 2 <= t[0] + t[2] and t[1] <= d[2] + d[4] / 2 <= t[1] + t[3] and overlap(t, d[1:]) >= least]
            best = max(inside, key=lambda d: overlap(t, d[1:]), default=None)
            if best:
                free.remove(best)
            out.append((img, t_id, best[0] if best else None, size))
        out += [(img, None, d[0], None) for d in free]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [5.0, 64.0])
def test_match_boxes(spark, cell):
    rng = random.Random(7)
    truth, found = [], []
    for img in [*range(12), None]:
        for i in range(rng.randrange(0, 12)):
            truth.append((img, i, 20, rng.randrange(0, 40) * 1.0, rng.randrange(0, 40) * 1.0, 20.0, 20.0))
        for i in range(rng.randrange(0, 14)):
            found.append((img, i, rng.randrange(0, 40) * 1.0, rng.randrange(0, 40) * 1.0, 18.0, 22.0))
    left = spark.createDataFrame(truth, "img_id long, truth_id long, size long, x double, y double, w double, h double")
    right = spark.createDataFrame(found, "img_id long, det_id long, x double, y double, w double, h double")
    got = sorted(((r.img_id, r.truth_id, r.det_id, r.size) for r in metrics.match_boxes(left, right, cell=cell).collect()), key=repr)
    assert got == in_order(truth, found)
    assert metrics.match_boxes(left.limit(0), right).where("truth_id IS NOT NULL").count() == 0
    assert metrics.match_boxes(left, right.limit(0)).where("det_id IS NOT NULL").count() == 0
    odd = left.limit(1).withColumn("x", F.lit(None).cast("double"))
    assert metrics.match_boxes(odd, right.limit(0)).count() == 1
