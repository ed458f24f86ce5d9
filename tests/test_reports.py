"""Reports, exports, resolved actions and aligned tokens."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mistveil.operators import detect as D
from mistveil.operators import reports
from mistveil.operators import tokens as T
from mistveil.sources import logs


def test_observation_summary(spark):
    dom = [{"node": 0, "content": {"text": "[PII_NAME_1] [PII_NAME_1]", "href": "x"}, "trimmed": True}, {"marker": "svg_skipped"}, {"image": "img", "image_omitted": "too_small", "content": {"text": "[PII_AADHAAR_2] ABCPE1234F"}}]
    fine = {"status": "ok", "observation": {"dom": dom, "images": [{"data": "A" * 4000}], "page": {"title": "support@a.example"}, "truncated": True}}
    rows = [(1, json.dumps(fine, separators=(",", ":"))), (2, '{"status":"blocked"}'), (3, '{"status":"ok"}'), (4, None), (5, "nonsense"), (6, '{"status":"ok","observation":{}}')]
    got = {r.id: r for r in reports.observation_summary(spark.createDataFrame(rows, "id long, json string"), by=["id"], origin=F.lit("https://a.example")).collect()}
    one = got[1]
    assert (one.outcome, one.nodes, one.content_fields, one.image_nodes, one.images_sent, one.truncated, one.trimmed_nodes) == ("ok", 3, 3, 1, 1, True, 1)
    assert one.tokens == {"NAME": 1, "AADHAAR": 1} and one.markers == {"svg_skipped": 1} and one.images_omitted == {"too_small": 1}
    assert one.residual == {"EMAIL_LIKELY_PUBLIC": 1, "PAN": 1} and (one.text_kb, one.images_kb) == (0, 4)
    assert [got[i].outcome for i in (2, 3, 4, 5, 6)] == ["blocked", "error", "error", "error", "ok"] and got[2].nodes is None
    assert got[6].nodes == 0 and got[6].residual == {} and got[6].trimmed_nodes == 0
    sites = {r.id: r for r in reports.site_table(reports.observation_summary(spark.createDataFrame(rows, "id long, json string"), by=["id"]), by=["id"]).collect()}
    assert sites[1].tokens == "AADHAAR 1, NAME 1" and sites[6].markers == "-" and sites[1].leak_candidates == 1


def test_runs_that_fell_back_are_left_out(spark):
    schema = "requested string, compute string, op string, p50 double, p95 double, n long, queue_p50 double, queue_p95 double"
    rows = [("wasm", "wasm", "z", 1.0, 2.0, 3, None, None), ("webgpu", "wasm", "z", 9.0, 9.0, 9, None, None), ("wasm", "wasm", "a", 4.0, 5.0, 6, 0.5, 0.6)]
    got = [(r.op, r.wasm_p50, r.webgpu_p50, r.wasm_queue_p50) for r in reports.side_by_side(spark.createDataFrame(rows, schema), ["z"]).orderBy("place", "op").collect()]
    assert got == [("z", 1.0, None, None), ("a", 4.0, None, 0.5)]
    rows = [("webgpu", "webgpu", "z", 9.0, 9.0, 9, None, None)]
    assert reports.side_by_side(spark.createDataFrame(rows, schema), []).first().webgpu_p50 == 9.0
    loads = spark.createDataFrame([("wasm", "wasm", "m", 12.4, "wasm", "ok"), ("webgpu", "webgpu", "m", 3.0, "webgpu", "ok"), ("wasm", "wasm", "k", None, None, "timeout"), ("webgpu", None, "k", 1.0, "wasm", "ok")], "requested string, compute string, model_id string, load_ms double, ran_on string, outcome string")
    assert {r.model_id: (r.wasm, r.webgpu) for r in reports.model_loads(loads).collect()} == {"m": ("12 (wasm)", "3 (webgpu)"), "k": ("failed (timeout)", None)}


def test_tables_and_sections(spark):
    rows = spark.createDataFrame([(1, 1, 1, 20), (1, 2, None, 20), (1, 3, 2, 40), (1, None, 9, None)], "img_id long, truth_id long, det_id long, size long")
    table = reports.recall_table(rows)
    assert [tuple(r) for r in table.collect()] == [(40, "1/1"), (20, "1/2"), (None, "1")]
    assert reports.markdown_table(table) == "| size | found |\n| --- | --- |\n| 40 | 1/1 |\n| 20 | 1/2 |\n|  | 1 |"
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(11), most=10)
    doc = reports.put_section("# T\n\n## A\n\nold\n\n## B\n\nb\n", "A", "new")
    assert "old" not in doc and doc.index("new") < doc.index("## B") and reports.put_section(doc, "C", "c").endswith("## C\n\nc\n")


def test_resolved_actions(spark):
    schema = "session_id string, step int, idx int, type string, text string, value string, url string"
    rows = [("s", 1, 0, "type", "hi [PII_NAME_1], [PII_NAME_9]", None, None), ("s", 1, 1, "select", None, "[PII_NAME_1]", None), ("s", 1, 2, "click", "[PII_NAME_1]", None, "u"), ("t", 1, 0, "type", "[PII_NAME_1]", None, None), ("s", 2, 0, "type", None, None, None)]
    tokens = spark.createDataFrame([("s", "[PII_NAME_1]", "Priya")], "session_id string, token string, value string")
    got = {(r.session_id, r.step, r.idx): (r.text, r.value) for r in T.resolve_actions(spark.createDataFrame(rows, schema), tokens).collect()}
    assert got == {("s", 1, 0): ("hi Priya, [PII_NAME_9]", None), ("s", 1, 1): (None, "Priya"), ("s", 1, 2): ("[PII_NAME_1]", None), ("t", 1, 0): ("[PII_NAME_1]", None), ("s", 2, 0): (None, None)}


def test_aligned_tokens_column(spark):
    pieces = "array<struct<entity:string,word:string,score:double>>"
    rows = [("Priya met  Ram", [("B-NAME", "Pri", 0.9), ("I-NAME", "##ya", 0.8), ("B-NAME", "zzz", 0.1), ("B-NAME", "Ram", 0.7)]), (None, [("O", "x", 1.0)]), ("é Ram", None), ("é Ram", [("B-NAME", "ram", 0.5)])]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, text string, pieces {pieces}")
    got = [[tuple(s) for s in r.a] for r in frame.select("i", D.aligned_tokens(F.col("text"), F.col("pieces")).alias("a")).orderBy("i").collect()]
    assert got == [[("B-NAME", 0.9, 0, 3), ("I-NAME", 0.8, 3, 5), ("B-NAME", 0.7, 11, 14)], [], [], [("B-NAME", 0.5, 2, 5)]]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_export_is_one_object(spark, tmp_path, n):
    records = spark.range(n).select(F.col("id"), F.lit('q"\n').alias("op")).repartition(3)
    held = spark.createDataFrame([("s", 1)], "session_id string, started_at int")
    logs.write_export(records, held, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "x").glob("part-*")))
    read = json.loads(text)
    assert sorted(r["id"] for r in read["records"]) == list(range(n)) and read["sessions"] == [{"session_id": "s", "started_at": 1}]
