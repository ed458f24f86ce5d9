"""HAR files read by entry: several tasks, bad entries, and texts that hold the mark of an entry."""

import json

import pytest
from pyspark.sql import functions as F

from mistveil.sources import captures


def wire(task):
    return {"schema_version": "1", "session_id": "s", "step": 1, "task": task, "page": {"url": "u", "title": 'a "request": {"url": "no"}'}, "dom": [{"node_id": "n0", "tag": "p", "content": {"text": "hi"}}]}


def entry(i, text):
    return {"startedDateTime": "t", "request": {"method": "POST", "url": f"https://b.example/{i}", "postData": {"text": text} if text is not None else None}, "response": {"status": 200, "content": {"text": '"request": {"url": "x"}'}}}


@pytest.mark.parametrize("indent", [None, 2])
def test_requests_of_large_captures(spark, tmp_path, indent):
    entries = [entry(i, json.dumps(wire(f"task {i}")) if i % 3 == 0 else json.dumps({"messages": [{"role": "user", "content": json.dumps(wire(f"chat {i}"))}]}) if i % 3 == 1 else None) for i in range(600)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.har").write_text(json.dumps({"log": {"version": "1.2", "entries": entries}}, indent=indent))
    (tmp_path / "in" / "empty.har").write_text("")
    (tmp_path / "in" / "none.har").write_text(json.dumps({"log": {"entries": []}}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        requests = captures.har_requests(spark, str(tmp_path / "in"))
        assert requests.where("file LIKE '%a.har'").select(F.spark_partition_id()).distinct().count() > 2
        rows = requests.orderBy("file", "block", "line").collect()
        assert [r.url for r in rows] == [f"https://b.example/{i}" for i in range(600)] and not any(r.error for r in rows)
        seen = captures.har_observations(spark, str(tmp_path / "in")).orderBy("block", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.observation.task for r in seen] == [f"{'task' if i % 3 == 0 else 'chat'} {i}" for i in range(600) if i % 3 < 2]


def test_a_bad_entry_costs_itself_only(spark, tmp_path):
    good = [json.dumps(entry(i, json.dumps(wire(str(i))))) for i in range(3)]
    broken = '{"request":{"method":"POST","url":"https://b.example/9","postData":{"text":"cut'
    (tmp_path / "x.har").write_text('{"log":{"entries":[' + ",".join([good[0], broken, good[1], '{"request":{"method":"GET"}}', good[2]]) + "]}}")
    rows = captures.har_observations(spark, str(tmp_path)).orderBy("block", "line").collect()
    assert [(r.observation.task if r.observation else None, r.error) for r in rows] == [("0", None), (None, "unreadable"), ("1", None), (None, "unreadable"), ("2", None)]
