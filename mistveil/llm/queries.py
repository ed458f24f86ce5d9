"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from .centroids import cluster
from .common import scratch, table
from .decontaminate import find_contaminated
from .lines import dedup_lines
from .lm import score_texts, training_rows
from .mixing import plan_mix
from .quality_rules import RULES, STOP_WORDS, SYMBOLS, measure_quality
from .resampling import importance_scores
from .simhash import simhash_groups
from .site_quality import score_quality, sites_of_pages
from .substrings import repeated_passages
from .toxicity import held_out, score_toxicity
from .vectors import link_vectors
from .warc import pages_of, read_warc, write_warc


def op1_mixing(spark, sf_dir):
    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark, sf_dir):
    judged = measure_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels, ~held_out(labels["doc_id"]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_site_quality(spark, sf_dir):
    sites = sites_of_pages(table(spark, sf_dir, "pages"))
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"), sites=sites)


def op8_warc(spark, sf_dir):
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return pages_of(read_warc(spark, path))


def op9_decontamination(spark, sf_dir):
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), training_rows(F.col("doc_id")))


def op11_resampling(spark, sf_dir):
    scored = importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op12_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_vectors(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_substring_dedup, op4_line_dedup, op5_quality_rules, op6_toxicity, op7_site_quality, op8_warc, op9_decontamination, op10_lm_scoring, op11_resampling, op12_centroids, op13_vectors)}

#: DuckDB's form of the characters that separate words.
_WS = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '')"

OP1_SQL = f"""
WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
drawn AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
  (list_aggregate(list_transform(range(13), lambda i: (instr('0123456789abcdef', substr(md5('0|' || coalesce(d.doc_id::VARCHAR, '')), (i + 1)::INT, 1)) - 1)::BIGINT << (4 * (12 - i))::BIGINT), 'sum')::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + (CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)) * size)::BIGINT AS taken FROM drawn
"""

OP4_SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM rows_),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT {'d': doc_id}) >= 3),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def _op5_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratios = {
        "n_words": "n_words",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "stop_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "capital_ratio": "n_capitals / greatest(word_chars, 1)",
    }
    passes = " AND ".join(f"{ratios[r.measure]} {op} {bound}::DOUBLE" for r in RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, {_WORDS} AS w, string_split(text, chr(10)) AS lines FROM rows_),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counted AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals,
  len(lines)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
  list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS with_words FROM worded),
judged AS (SELECT c.*, (len(with_words) - len(list_distinct(with_words)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM counted c LEFT JOIN repeated USING (r)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passes} AS kept FROM based
""".replace("\\\\", "\\")


# SHA-1 in base32: five bytes are eight digits.
OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM k
"""



def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time; the table of 16 steps follows from the polynomial."""
    steps = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    digits = f"list_transform(range(octet_length(encode({text})) * 2), lambda i: (instr('0123456789ABCDEF', substr(hex(encode({text})), (i // 2 * 2 + 2 - i % 2)::INT, 1)) - 1)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, x: xor(c >> 4, ({steps}::BIGINT[])[((xor(c, x) & 15) + 1)::INT])), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, 0 AS side FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
w AS (SELECT r, doc_id, side, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
f AS (SELECT r, side, f, count(*)::BIGINT AS n FROM (SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w) GROUP BY ALL),
h AS (SELECT f, {_crc32_sql('f')} % 10000 AS b FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM f JOIN h USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
m AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM f JOIN h USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY r),
d AS (SELECT r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE side = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM s WHERE words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= n * 25 // 100 THEN place END::BIGINT AS rank FROM s LEFT JOIN o USING (r)
"""


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    parts = [
        "p AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64)",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v AS m FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM p ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT"
        parts.append(f"a{i} AS (SELECT r, vec_id, v, c, d FROM (SELECT r, vec_id, v, c, {distance} AS d FROM p, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            sums = f"SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY ALL"
            parts.append(f"c{i + 1} AS (SELECT c{i}.c, coalesce(q.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM ({sums}) GROUP BY c) q ON c{i}.c = q.c)")
    last = f"SELECT vec_id, a.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"
    return f"WITH {', '.join(parts)} {last}"


ORACLE_SQL = {"op8_warc": OP8_SQL, "op1_mixing": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_quality_rules": _op5_sql(), "op11_resampling": OP11_SQL, "op12_centroids": _op12_sql()}
