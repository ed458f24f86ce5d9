"""Sanitizing documents whose ids or sources are null or repeated."""

from mistveil.plans import queries


def test_documents_with_null_and_repeated_keys_are_all_cleaned(spark, tmp_path):
    texts = [f"{'x ' * k}write to person{k}@mail{k}.example and person{k}@other.example" for k in range(6)]
    rows = [(1, texts[0], "a"), (2, texts[1], None), (None, texts[2], "b"), (None, texts[3], None), (4, texts[4], "a"), (4, texts[5], "a"), (4, texts[5], "a"), (4, texts[5], "c"), (None, "nothing here", None), (5, None, None)]
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.sanitize_documents(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _, _ in rows)
    assert sum(r.text.count("[PII_EMAIL_") for r in got) == 16 and not any("@" in r.text for r in got)
    plain = sorted(r.text.split("write")[0] for r in got if r.n_spans)
    assert plain == sorted(t.split("write")[0] for _, t, _ in rows if t and "write" in t)
    assert queries.residual_after_sanitize(spark, str(tmp_path)).count() == 0
