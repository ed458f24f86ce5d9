"""The registered queries, their SQL, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from mistveil.llm import decontaminate, lines, mixing, quality_rules, simhash
from mistveil.llm.common import stored
from mistveil.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_simhash": "doc_id fingerprint component_id",
    "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_toxicity": "doc_id held_out score predicted",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_resampling": "doc_id n_features weight score rank",
    "op12_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_vectors": "vec_id n_links component_id kept",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall()))
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == want


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    table = {"op8_warc": "pages", "op12_centroids": "embeddings", "op13_vectors": "embeddings"}.get(name, "documents")
    assert frame.count() == spark.read.parquet(f"{folder}/{table}.parquet").count()


def test_pipeline(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r.doc_id for r in quality_rules.measure_quality(docs).where("kept").collect()}
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs.where(docs.doc_id.isin(*good))).collect()}
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in kept.items()}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in links:  # smallest id reachable over links
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    single = {i for i in group if group[i] == i}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    words = lambda t: b" " + b" ".join(decontaminate.split_words(t)) + b" "
    holds = {i for i in single if any(words(t) in words(kept[i]) for _, t in items)}
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= single - holds and all(r.text == kept[r.doc_id] for r in rows)
    left = docs.where(docs.doc_id.isin(*(single - holds)))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, out, folder), name)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in left.collect()}
    planned = {r.doc_id: r.copies for r in mixing.plan_mix(out).collect()}
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted((i, k + 1) for i, n in planned.items() for k in range(n))


def test_stages_take_awkward_rows(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy int, size int, n_lines int, component_id long, id long"
    rows = [(1, None, None, None, None, 1, 1, 1, 1, 1), (None, "", "en", "s", 0, 1, 1, 1, 1, 1), (2, "w " * 400, "en", "s", 0, 1, 1, 1, 1, 1), (2, "w " * 400, "en", "s", 0, 1, 1, 1, 1, 1)]
    # Repeated words and texts without words break rules; of empty texts and of equal rows one stays; nothing holds an item.
    stay = {"quality_rules": [], "line_dedup": [None, 1, 2, 2], "simhash_dedup": [1, 2], "decontamination": [None, 1, 2, 2]}
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert sorted((r.doc_id for r in out.collect()), key=lambda i: (i is not None, i)) == (stay[name] if data else []), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        copies = [r.copies for r in mixing.plan_mix(docs).collect()]
        assert last.count() == sum(copies) and len(copies) == len(data) and len(set(last.columns)) == len(last.columns)
