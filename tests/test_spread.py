"""Narrow tables with much work a row are dealt out; what an exchange carries is what the result needs."""

import pytest
from pyspark.sql import functions as F

from mistveil.functions.spans import hits, pattern_spans
from mistveil.functions.urls import url_of, url_texts
from mistveil.plans import queries


def parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["span_claims", "mask_map", "decide_spans", "canary_spans", "url_sanitize_crafted"])
def test_small_files_are_dealt_out(spark, folder, name):
    assert queries.QUERIES[name](spark, folder).rdd.getNumPartitions() == parts(spark)


def test_link_tokens_reads_dealt_customers(spark, folder):
    from mistveil.plans import derived, literals

    assert derived._copies(spark, folder, literals.LINKS).rdd.getNumPartitions() == parts(spark)


def test_spans_of_texts_with_control_signs(spark):
    text = "a\x01b p@q.example\x01 98765 43210\x02\x01 "
    row = spark.createDataFrame([(text,)], "text string").select(pattern_spans(F.col("text")).alias("s"), hits(F.col("text"), "[0-9]{5}").alias("h")).first()
    assert [(s.type, text[s.start : s.end]) for s in row.s] == [("EMAIL", "p@q.example"), ("PHONE", "98765 43210")]
    assert [text[h.start : h.end] for h in row.h] == ["98765", "43210"]


def test_urls_are_read_once(spark):
    url = F.col("text")
    frame = spark.range(1).select(F.lit("https://u@H.example:443/a/%62?k=1&k=2#x").alias("text"))
    for made in (url_texts(url), url_of(url, F.transform(url_texts(url), lambda p: p["text"]))):
        plan = frame.select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("RLIKE(text") <= 4  # 2 in each of both functions
    assert frame.select(url_of(url, F.transform(url_texts(url), lambda p: p["text"])).alias("x")).first().x == "https://h.example/a/b?k=2#x"


def test_lines_of_words_carry_no_boxes_for_their_text(spark, folder):
    plan = queries.QUERIES["ocr_lines"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "confidence" not in plan and "box" not in plan


def test_title_of_a_page_is_sanitized_before_it_leaves(spark, tmp_path):
    html = "<html><head><title>By &quot;ann&quot; p@q.example</title></head><body></body></html>"
    spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = {r.field: r.text for r in queries.QUERIES["page_links"](spark, str(tmp_path)).collect()}
    assert rows["title"] == 'By "ann" [PII_EMAIL_1]'


def test_tables_of_exploded_rows_are_not_broadcast(spark, folder, monkeypatch):
    """Spark would take them to be as few as the customers, whatever their number."""
    from mistveil.operators import known, tokens
    from mistveil.plans import derived, literals

    rows = derived._copies(spark, folder, literals.LINKS).where("session_id = 's'").withColumn("session_id", F.col("c_custkey").cast("string"))
    rows = tokens.written(rows, "rows")
    monkeypatch.setattr(tokens, "written", lambda df, name: df)
    units = rows.select("session_id", "origin", "unit", "text", pattern_spans(F.col("text")).alias("spans"))
    found = tokens.occurrences(units)
    held = tokens.token_map(found)
    for made in (tokens.spotted(units.drop("spans").withColumn("_opaque", F.lit(False))), tokens.rewrite(units, found, held), known.known_values(units, held), tokens.token_sources(found, held)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
