"""Queries over the shared tables and small fixed ones, and SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import hosts as H
from ..functions.checksums import is_luhn, is_verhoeff
from ..functions.email import FREE_MAIL, ROLE_NAMES, is_public, public_score
from ..functions.patterns import PATTERNS
from ..functions.spans import candidates, pattern_spans, piece, placeholder_counts
from ..functions.urls import masked_url, split_url
from ..operators import agent, budget, metrics
from ..operators import detect as D
from ..operators import html as W
from ..operators import images as I
from ..operators import tokens as T
from ..operators.known import known_values
from ..operators.reports import observation_summary, site_table
from ..operators.residuals import residual_scan
from ..operators.trees import forest
from ..operators.windows import merge_windows, window_texts
from ..sources.logs import csv_lines
from ..sources.tables import table, written
from . import literals as L

QUERIES: dict = {}
ORACLE_SQL: dict = {}


#: Cases over small fixed lists, for the tests alone; derived.py has the registered queries of the same operators.
CRAFTED: dict = {}
CRAFTED_SQL: dict = {}


def _adder(queries: dict, answers: dict, sql: str | None, name: str | None):
    def add(function):
        key = name or function.__name__
        queries[key] = function
        if sql is not None:
            answers[key] = sql
        return function

    return add


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL if there is any."""
    return _adder(QUERIES, ORACLE_SQL, sql, name)


def crafted(sql: str | None = None, name: str | None = None):
    """A case for the tests, with its SQL."""
    return _adder(CRAFTED, CRAFTED_SQL, sql, name)


# --- Texts: documents and canaries ---


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text of all documents and canaries."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(L.CANARIES.df(spark).select("id", F.col("value").alias("text")))


_TEXTS = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT id, value FROM {L.CANARIES.sql()})"
_DUCK_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\-]"
_LUHN = "(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: (CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * substr({d}, (length({d}) - i + 1)::INT, 1)::INT > 9 THEN 2 * substr({d}, (length({d}) - i + 1)::INT, 1)::INT - 9 ELSE 2 * substr({d}, (length({d}) - i + 1)::INT, 1)::INT END ELSE substr({d}, (length({d}) - i + 1)::INT, 1)::INT END))) % 10 = 0)"
_TIMES = "[0,1,2,3,4,5,6,7,8,9,1,2,3,4,0,6,7,8,9,5,2,3,4,0,1,7,8,9,5,6,3,4,0,1,2,8,9,5,6,7,4,0,1,2,3,9,5,6,7,8,5,9,8,7,6,0,4,3,2,1,6,5,9,8,7,1,0,4,3,2,7,6,5,9,8,2,1,0,4,3,8,7,6,5,9,3,2,1,0,4,9,8,7,6,5,4,3,2,1,0]"
_TURNS = "[0,1,2,3,4,5,6,7,8,9,1,5,7,6,2,8,3,0,9,4,5,8,0,3,7,9,6,1,4,2,8,9,1,6,0,4,3,5,2,7,9,4,5,3,1,2,6,8,7,0,4,2,8,6,5,7,3,9,0,1,2,7,9,3,8,0,6,4,1,5,7,0,4,6,9,1,3,2,5,8]"
_VERHOEFF = f"(length({{d}}) = 12 AND list_reduce(list_concat([0], list_transform(range(12), lambda i: ({_TURNS})[((i % 8) * 10 + substr({{d}}, (12 - i)::INT, 1)::INT + 1)::INT])), lambda c, x: ({_TIMES})[(c * 10 + x + 1)::INT]) = 0)"


def _pattern_sql(kind: str) -> str:
    """Hits per text by doubling what separates hits, since DuckDB's patterns cannot look around."""
    sep = rf"(?:{_DUCK_SPACE}{_DUCK_SPACE})?"
    alone = ("[^A-Za-z0-9]", "[^A-Za-z0-9]", "[^A-Za-z0-9]")
    digits = ("[^0-9]", "[^0-9]", "[^0-9]")
    forms = {
        "EMAIL": ("[^A-Za-z0-9_.+@-]", "[^A-Za-z0-9_.+-]", "[^A-Za-z0-9_.-]", r"[A-Za-z0-9_.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+", "true"),
        "UPI": ("[^A-Za-z0-9_.+@-]", "[^A-Za-z0-9_.+-]", "[^A-Za-z0-9_.-]", r"[A-Za-z0-9_.+-]+@[a-zA-Z]{2,64}", "true"),
        "CARD": (*digits, rf"(?:[0-9]{sep}){{12,18}}[0-9]", _LUHN.format(d="d")),
        "PAN": (*alone, "[A-Z]{5}[0-9]{4}[A-Z]", "substr(raw, 4, 1) IN ('A','B','C','F','G','H','J','L','P','T')"),
        "IFSC": (*alone, "[A-Z]{4}0[A-Z0-9]{6}", "true"),
        "GSTIN": (*alone, "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]", "true"),
        "VOTER_ID": (*alone, "[A-Z]{3}[0-9]{7}", "true"),
        "PASSPORT": (*alone, "[A-PR-WY][1-9][0-9]{6}", "true"),
        "AADHAAR": (*digits, rf"[0-9]{{4}}{sep}[0-9]{{4}}{sep}[0-9]{{4}}", f"d[1] NOT IN ('0', '1') AND {_VERHOEFF.format(d='d')}"),
        "AADHAAR masked": ("[^A-Za-z0-9]", "[^A-Za-z0-9]", "[^0-9]", rf"[Xx]{{4}}{sep}[Xx]{{4}}{sep}[0-9]{{4}}", "true"),
        # A plus sign is doubled too: one of the two is the boundary.
        "PHONE": (*digits, rf"(?:[+]91{sep}|0)?[6-9][0-9]{{4}}{sep}[0-9]{{5}}", "true"),
        "PHONE abroad": (*digits, r"[+][1-9][0-9]{7,14}", "true"),
        "VEHICLE_REG": (*alone, "[A-Z]{2}[0-9]{2}[A-Z]{1,2}[0-9]{4}", "true"),
    }
    parts = []
    for name in (k for k in forms if k.split(" ")[0] == kind):
        double, before, after, pattern, check = forms[name]
        parts.append(
            rf"""
(WITH t AS (SELECT id, regexp_replace(text, '({double})', '\1\1', 'g') AS x FROM {_TEXTS}),
h AS (SELECT id, unnest(regexp_extract_all(x, '(?:^|{before})({pattern})(?:$|{after})', 1)) AS raw FROM t),
c AS (SELECT id, raw, regexp_replace(raw, '{_DUCK_SPACE}', '', 'g') AS d FROM h)
SELECT id, d FROM c WHERE {check})"""
        )
    return f"SELECT id, count(*)::BIGINT AS n, count(DISTINCT d)::BIGINT AS n_values FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


def _pattern_query(kind: str):
    found = [(p, c) for k, p, c in PATTERNS if k == kind]

    def run(spark, sf_dir):
        text = F.col("text")
        each = F.concat(*[F.transform(candidates(text, kind, p, c), lambda h: piece(text, h)) for p, c in found])
        raw = _texts(spark, sf_dir).select("id", F.explode(each).alias("raw"))
        bare = F.regexp_replace("raw", r"[\s \-]", "")
        return raw.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(bare).alias("n_values"))

    return run


for _kind in ("EMAIL", "UPI", "CARD", "PAN", "IFSC", "GSTIN", "VOTER_ID", "PASSPORT", "VEHICLE_REG", "AADHAAR", "PHONE"):
    query(_pattern_sql(_kind), f"spans_{_kind.lower()}")(_pattern_query(_kind))

@crafted(f"SELECT id, type, start, end_ FROM {L.CLAIMED.sql()}")
def span_claims(spark, sf_dir):
    each = L.OVERLAPS.df(spark).select("id", F.explode(pattern_spans(F.col("text"))).alias("s"))
    return each.select("id", "s.type", "s.start", F.col("s.end").alias("end_"))


@crafted(f"SELECT id, kind AS type, 0 AS start, length(value)::INTEGER AS end_ FROM {L.CANARIES.sql()} WHERE found")
def canary_spans(spark, sf_dir):
    each = L.CANARIES.df(spark).select("id", F.explode(pattern_spans(F.col("value"))).alias("s"))
    return each.select("id", "s.type", "s.start", F.col("s.end").alias("end_"))


@crafted(f"SELECT id, coalesce(regexp_matches(digits, '^[0-9]{{13,19}}$') AND {_LUHN.format(d='CASE WHEN regexp_matches(digits, $$^[0-9]{13,19}$$$$) THEN digits ELSE repeat($$0$$, 5) END')}, false) AS ok FROM {L.DIGITS.sql()}".replace("$$^[0-9]{13,19}$$$$", "'^[0-9]{13,19}$'").replace("$$0$$", "'0'"))
def luhn(spark, sf_dir):
    return L.DIGITS.df(spark).select("id", is_luhn(F.col("digits")).alias("ok"))


@crafted(f"SELECT id, CASE WHEN regexp_matches(digits, '^[0-9]{{12}}$') THEN {_VERHOEFF.format(d='lpad(regexp_replace(digits, $q$[^0-9]$q$, $q$0$q$, $q$g$q$), 12, $q$0$q$)')} ELSE false END AS ok FROM {L.DIGITS.sql()}".replace("$q$", "'"))
def verhoeff(spark, sf_dir):
    return L.DIGITS.df(spark).select("id", is_verhoeff(F.col("digits")).alias("ok"))


def _doc_units(spark, sf_dir):
    """Documents as units: each document is a session; rows that repeat an id are units of it, numbered by a hash of source and text."""
    docs = table(spark, sf_dir, "documents")
    origin = F.concat(F.lit("https://"), F.col("source"), F.lit(".example"))
    units = docs.select(F.col("doc_id").cast("string").alias("session_id"), origin.alias("origin"), F.xxhash64("source", "text").alias("unit"), F.coalesce("text", F.lit("")).alias("text"))
    return written(D.with_spans(units), "spans")


@query()
def sanitize_documents(spark, sf_dir):
    """All documents with personal data replaced by tokens."""
    units = _doc_units(spark, sf_dir)
    found = T.occurrences(units)
    clean = T.rewrite(units, found, T.token_map(found))
    return clean.select(F.col("session_id").cast("long").alias("doc_id"), "text", F.size("spans").alias("n_spans"))


@query()
def token_map_documents(spark, sf_dir):
    """How many tokens of each type documents hold; the map itself stays private."""
    tokens = T.token_map(T.occurrences(_doc_units(spark, sf_dir)))
    return tokens.groupBy(F.col("session_id").cast("long").alias("doc_id"), "type").agg(F.count("*").alias("n"), F.max("token").alias("last_token"))


@query("SELECT kind, n FROM (SELECT 'EMAIL' AS kind, 0::BIGINT AS n) WHERE n > 0")
def residual_after_sanitize(spark, sf_dir):
    """Nothing that the patterns find is left in sanitized documents."""
    return D.residual_counts(sanitize_documents(spark, sf_dir))


@query(f"""
WITH e AS (SELECT id, count(*)::BIGINT AS n FROM (SELECT id, unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_.+@-])', '\\1\\1', 'g'), '(?:^|[^A-Za-z0-9_.+-])([A-Za-z0-9_.+-]+@[a-zA-Z0-9-]+(?:\\.[a-zA-Z0-9-]+)+)(?:$|[^A-Za-z0-9_.-])', 1)) FROM {_TEXTS}) GROUP BY id)
SELECT count(*)::BIGINT AS n_texts, sum(n)::BIGINT AS n_emails FROM e
""")
def email_residuals(spark, sf_dir):
    """Texts that still hold e-mail addresses, and how many."""
    each = _texts(spark, sf_dir).select("id", F.explode(pattern_spans(F.col("text"))).alias("s")).where("s.type = 'EMAIL'")
    return each.groupBy("id").count().agg(F.count("*").alias("n_texts"), F.sum("count").alias("n_emails"))


@crafted(f"SELECT id, found AND kind <> 'EMAIL' AS blocked FROM {L.CANARIES.sql()}")
def final_guard(spark, sf_dir):
    return L.CANARIES.df(spark).select("id", D.guard_triggered(F.array(F.lit("title"), F.col("value"))).alias("blocked"))


@crafted(f"""
WITH t AS (SELECT session_id, id, unnest(list_distinct(regexp_extract_all(text, '\\[PII_([A-Z_]+)_[0-9]+\\]'))) AS tok FROM {L.TEXTS_WITH_TOKENS.sql()}),
k AS (SELECT id, regexp_extract(tok, '\\[PII_([A-Z_]+)_[0-9]+\\]', 1) AS kind, count(*)::INTEGER AS n FROM t GROUP BY ALL)
SELECT * FROM k UNION ALL SELECT id, 'SECRET', len(regexp_extract_all(text, '\\[SECRET\\]'))::INTEGER FROM {L.TEXTS_WITH_TOKENS.sql()} WHERE text LIKE '%[SECRET]%'
""", "placeholder_counts")
def placeholder_counts_query(spark, sf_dir):
    return L.TEXTS_WITH_TOKENS.df(spark).select("id", F.explode(placeholder_counts(F.col("text"))).alias("kind", "n"))


@crafted(f"SELECT session_id, id, text FROM {L.RESOLVED.sql()}")
def resolve_tokens(spark, sf_dir):
    return T.resolve(L.TEXTS_WITH_TOKENS.df(spark), L.POLICY_TOKENS.df(spark).select("session_id", "token", "value"))


@query(f"SELECT c.id, count(*)::BIGINT AS n FROM (SELECT doc_id, text FROM documents UNION ALL SELECT id, value FROM {L.CANARIES.sql()}) d JOIN {L.CANARIES.sql()} c ON contains(d.text, c.value) GROUP BY c.id")
def canary_leaks(spark, sf_dir):
    return metrics.canary_leaks(_texts(spark, sf_dir), L.CANARIES.df(spark).select("id", "value"))


_ROLES = ", ".join(f"'{r}'" for r in ROLE_NAMES)
_FREE = ", ".join(f"'{h}'" for h in FREE_MAIL)
_IN_TEXT = {
    "EMAIL": (r"([^A-Za-z0-9_.+@-])", r"(?:^|[^A-Za-z0-9_.+-])([A-Za-z0-9_.+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+)(?:$|[^A-Za-z0-9_.-])"),
    "IFSC": (r"([^A-Za-z0-9])", r"(?:^|[^A-Za-z0-9])([A-Z]{4}0[A-Z0-9]{6})(?:$|[^A-Za-z0-9])"),
    "PAN": (r"([^A-Za-z0-9])", r"(?:^|[^A-Za-z0-9])([A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z])(?:$|[^A-Za-z0-9])"),
}


@query(
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, 'https://' || lower(source) || '.com' AS origin, source FROM documents WHERE doc_id IS NOT NULL), h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS kind, unnest(regexp_extract_all(regexp_replace(text, '{double}', '\\1\\1', 'g'), '{pattern}', 1)) AS v FROM d" for k, (double, pattern) in _IN_TEXT.items())
    + f"""), k AS (SELECT doc_id, CASE WHEN kind = 'EMAIL' AND (CASE WHEN lower(regexp_extract(v, '^(.*)@[^@]*$', 1)) IN ({_ROLES}) THEN 3 ELSE 0 END
  + CASE WHEN lower(regexp_extract(v, '@([^@]*)$', 1)) = lower(source) || '.com' OR ends_with(lower(regexp_extract(v, '@([^@]*)$', 1)), '.' || lower(source) || '.com') THEN 3 ELSE 0 END
  - CASE WHEN lower(regexp_extract(v, '@([^@]*)$', 1)) IN ({_FREE}) THEN 4 ELSE 0 END) > 0 THEN 'EMAIL_LIKELY_PUBLIC' ELSE kind END AS kind FROM h)
SELECT doc_id, kind, count(*)::BIGINT AS n FROM k GROUP BY ALL UNION ALL SELECT doc_id, 'strings', (4 + len(string_split(text, chr(10))))::BIGINT FROM d
""")
def residual_walk(spark, sf_dir):
    """What is left in the strings of observations made of documents without sanitizing them; images, which repeat the text, are skipped."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.alias("node"), F.create_map(F.lit("text"), t).alias("content")))
    page = F.struct(F.lit("read").alias("url"), F.col("source").alias("title"))
    images = F.array(F.struct(F.col("text").alias("data")))
    json = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.col("lang").alias("task"), page.alias("page"), lines.alias("dom"), images.alias("images")))
    origin = F.concat(F.lit("https://"), F.lower("source"), F.lit(".com"))
    rows = docs.select("doc_id", origin.alias("origin"), json.alias("json"))
    found = residual_scan(rows, by=["doc_id", "origin"], origin=F.col("origin"))
    shown = found.where(F.col("kind").isNull() | F.col("kind").isin("EMAIL", "EMAIL_LIKELY_PUBLIC", "IFSC", "PAN"))
    return shown.select("doc_id", F.coalesce("kind", F.lit("strings")).alias("kind"), "n")


@query("""
WITH l AS (SELECT doc_id, range(len(string_split(text, chr(10)))) AS n, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'blocked' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 11 <> 0 THEN len(n) END AS nodes, CASE WHEN doc_id % 11 <> 0 THEN len(n) END AS content_fields,
  CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN len(n) > 1 THEN 'NAME ' || least(len(n), 3) ELSE 'NAME 1' END END AS tokens, CASE WHEN doc_id % 11 <> 0 THEN 'canvas_skipped ' || len(list_filter(n, lambda i: i % 7 = 0)) END AS markers,
  CASE WHEN doc_id % 11 <> 0 THEN len(list_filter(n, lambda i: i % 4 = 0)) END AS image_nodes, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 3 END AS images_sent, CASE WHEN doc_id % 11 <> 0 THEN 'too_small ' || len(list_filter(n, lambda i: i % 8 = 0)) END AS images_omitted,
  CASE WHEN doc_id % 11 <> 0 THEN len(n) > 4 END AS truncated, CASE WHEN doc_id % 11 <> 0 THEN len(list_filter(n, lambda i: i % 5 = 4)) END AS trimmed_nodes FROM l
""", "observation_summary")
def observation_summary_query(spark, sf_dir):
    """Answers of the observing side made of documents, as counts: nodes, fields, tokens, markers, images, what was trimmed."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    say = lambda yes, text: F.when(yes, F.lit(text))
    node = lambda t, i: F.struct(F.create_map(F.lit("text"), F.concat(F.lit("[PII_NAME_"), (i % 3).cast("string"), F.lit("]"))).alias("content"), say(i % 7 == 0, "canvas_skipped").alias("marker"), say(i % 4 == 0, "img").alias("image"), say(i % 8 == 0, "too_small").alias("image_omitted"), (i % 5 == 4).alias("trimmed"))
    lines = F.split("text", "\n", -1)
    seen = F.struct(F.transform(lines, node).alias("dom"), F.array_repeat(F.struct(F.lit("AAAA").alias("data")), F.expr("CAST(doc_id % 3 AS INT)")).alias("images"), (F.size(lines) > 4).alias("truncated"))
    json = F.to_json(F.struct(F.when(F.col("doc_id") % 11 == 0, "blocked").otherwise("ok").alias("status"), seen.alias("observation")))
    found = site_table(observation_summary(docs.select("doc_id", json.alias("json")), by=["doc_id"]), by=["doc_id"])
    return found.drop("text_kb", "images_kb", "leak_candidates")


def _line_units(spark, sf_dir):
    """Lines of documents as units of a session each."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("session_id"), F.col("source").alias("origin"), F.posexplode(F.split("text", "\n", -1)).alias("unit", "text"))


_OUT = r"[^\p{L}\p{N}_]"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS unit FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, regexp_extract(line, '^([\p{{L}}\p{{N}}_]+ [\p{{L}}\p{{N}}_]+)(?:$|{_OUT})', 1) AS pair, regexp_extract(line, '^([\p{{L}}\p{{N}}_]+) [\p{{L}}\p{{N}}_]+(?:$|{_OUT})', 1) AS one FROM l WHERE unit = 0),
d AS (SELECT doc_id, unit, pair, one, regexp_replace(line, '({_OUT})', '\1\1', 'g') AS x, replace(pair, ' ', '  ') AS p2 FROM l JOIN f USING (doc_id) WHERE unit > 0 AND pair <> '' AND contains(lower(line), lower(one))),
m AS (SELECT doc_id, unit, one, pair, x, p2, len(regexp_extract_all(x, '(?i)(?:^|{_OUT})(' || p2 || ')(?:$|{_OUT})', 1)) AS pairs, regexp_replace(x, '(?i)(^|{_OUT})(' || p2 || ')($|{_OUT})', '\1#\3', 'g') AS rest FROM d),
c AS (SELECT doc_id, CASE WHEN length(pair) >= 3 THEN pairs ELSE 0 END AS pairs, CASE WHEN length(one) >= 3 THEN len(regexp_extract_all(rest, '(?i)(?:^|{_OUT})(' || one || ')(?:$|{_OUT})', 1)) ELSE 0 END AS ones FROM m)
SELECT doc_id, sum(pairs)::BIGINT AS pairs, sum(ones)::BIGINT AS ones FROM c GROUP BY doc_id HAVING sum(pairs + ones) > 0
""", "known_values")
def known_values_query(spark, sf_dir):
    """The first two words of each document, and the first of them, as known values: how often later lines hold them, longest first."""
    units = _line_units(spark, sf_dir)
    word = r"[\p{L}\p{N}_]+"
    named = units.where("unit = 0").select("session_id", "origin", F.regexp_extract("text", rf"^({word} {word})(?!{word})", 1).alias("pair"), F.regexp_extract("text", rf"^({word}) {word}", 1).alias("one"))
    first = F.struct(F.lit(0).alias("unit"), F.lit(0).alias("start")).alias("first")
    tokens = named.where("pair <> ''").select("session_id", "origin", F.inline(F.array(F.struct(F.lit("NAME").alias("type"), F.col("pair").alias("value")), F.struct(F.lit("OTHER").alias("type"), F.col("one").alias("value")))), first)
    hits = known_values(units, tokens).select("session_id", F.explode("known.type").alias("kind"))
    return hits.groupBy(F.col("session_id").cast("long").alias("doc_id")).agg(F.count_if(F.col("kind") == "NAME").alias("pairs"), F.count_if(F.col("kind") == "OTHER").alias("ones"))


# --- Deciding what is personal ---

_HOST = "lower(regexp_extract(origin, '^[a-z]+://([^/:?#]+)', 1))"


@crafted(f"""
WITH e AS (SELECT *, regexp_extract(email, '^(.*)@[^@]*$', 1) AS name, lower(regexp_extract(email, '@([^@]*)$', 1)) AS domain, {_HOST} AS host FROM {L.EMAILS.sql()})
SELECT id, CASE WHEN email NOT LIKE '%@%' THEN 0 ELSE (CASE WHEN lower(name) IN ('support','info','contact','sales','help','noreply','no-reply','admin','care','hr','careers') THEN 3 ELSE 0 END
 + CASE WHEN host <> '' AND (domain = host OR ends_with(domain, '.' || host)) THEN 3 ELSE 0 END - CASE WHEN domain IN ('gmail.com','yahoo.com','outlook.com','hotmail.com','proton.me','protonmail.com','icloud.com','rediffmail.com') THEN 4 ELSE 0 END
 + CASE WHEN coalesce(in_contact_markup, false) OR coalesce(near_contact_heading, false) OR (coalesce(in_landmark, false) AND coalesce(is_mailto, false)) THEN 2 ELSE 0 END
 - CASE WHEN coalesce(in_ugc_block, false) THEN 3 ELSE 0 END)::INTEGER END AS score FROM e
""")
def email_score(spark, sf_dir):
    hints = F.struct("in_landmark", "near_contact_heading", "in_contact_markup", "in_ugc_block")
    return L.EMAILS.df(spark).select("id", public_score(F.col("email"), F.col("origin"), hints, F.col("is_mailto")).alias("score"))


@crafted(f"SELECT id, id IN (1, 4, 3) AS public FROM {L.EMAILS.sql()}")
def public_email(spark, sf_dir):
    hints = F.struct("in_landmark", "near_contact_heading", "in_contact_markup", "in_ugc_block")
    return L.EMAILS.df(spark).select("id", is_public(F.col("email"), F.col("origin"), hints, F.col("is_mailto")).alias("public"))


_TAGGED = L.Table("id bigint, text string, tags string", [(1, "Priya wrote to support@example.com today", "NAME:0:5,EMAIL:15:34,WHAT:35:40"), (2, "a.b@c.example", "NAME:0:3"), (3, "Ram Ram", "NAME:0:3,NAME:2:5")])
_DECIDED = L.Table("id bigint, spans string", [(1, "NAME:0:5,OTHER:35:40"), (2, "EMAIL:0:13"), (3, "NAME:0:3")])


@crafted(f"SELECT id, spans FROM {_DECIDED.sql()}")
def decide_spans(spark, sf_dir):
    part = lambda t, i: F.get(F.split(t, ":"), F.lit(i))
    tags = F.transform(F.split("tags", ","), lambda t: F.struct(part(t, 0).alias("type"), part(t, 1).cast("int").alias("start"), part(t, 2).cast("int").alias("end")))
    decided = D.decide(F.col("text"), pattern_spans(F.col("text")), tags, F.lit("https://example.com"))
    return _TAGGED.df(spark).select("id", F.array_join(F.transform(decided, lambda s: F.concat_ws(":", s["type"], s["start"], s["end"])), ",").alias("spans"))


@crafted("SELECT 1::BIGINT AS id, 'mail [PII_EMAIL] or Ram' AS shown, 'NAME:22:25' AS moved")
def mask_map(spark, sf_dir):
    text = F.lit("mail a.b@c.example or Ram")
    rows = spark.range(1, 2).select("id", text.alias("text")).withColumn("m", D.masked(F.col("text"), pattern_spans(F.col("text"))))
    tag = lambda s, e: F.struct(F.lit("NAME").alias("type"), F.lit(s).alias("start"), F.lit(e).alias("end"))
    moved = D.unmasked(F.array(tag(20, 23), tag(4, 8)), F.col("m.places"))
    return rows.select("id", F.col("m.text").alias("shown"), F.array_join(F.transform(moved, lambda s: F.concat_ws(":", s["type"], s["start"], s["end"])), ",").alias("moved"))


@crafted(f"SELECT text_id, label, start, end_, score FROM {L.BIO_GROUPS.sql()}")
def bio_group(spark, sf_dir):
    return D.group_entities(L.BIO.df(spark).withColumnRenamed("end_", "end")).withColumnRenamed("end", "end_")


@crafted("SELECT label, CASE label WHEN 'PERSON' THEN 'NAME' WHEN 'LOCATION' THEN 'ADDRESS' WHEN 'ORGANIZATION' THEN NULL WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'PHONE_NUMBER' THEN 'PHONE' WHEN 'CREDIT_CARD' THEN 'CARD' WHEN 'US_PASSPORT' THEN 'PASSPORT' ELSE 'OTHER' END AS type FROM (SELECT unnest(['PERSON','LOCATION','ORGANIZATION','EMAIL_ADDRESS','PHONE_NUMBER','CREDIT_CARD','US_PASSPORT','DATE_TIME','NEVER_SEEN']) AS label)")
def label_map(spark, sf_dir):
    labels = ["PERSON", "LOCATION", "ORGANIZATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_PASSPORT", "DATE_TIME", "NEVER_SEEN"]
    return spark.createDataFrame([(x,) for x in labels], "label string").select("label", D.label_type(F.col("label")).alias("type"))


_SCORES = L.Table("id bigint, score double", [(1, 0.86), (2, 0.85), (3, 0.6), (4, 0.599), (5, None), (6, 90.0), (7, 0.75), (8, 0.5)])


@crafted(f"SELECT id, coalesce(CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' END, 'low') AS ner, coalesce(CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' END, 'low') AS face, coalesce(CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' END, 'low') AS ocr FROM {_SCORES.sql()}")
def bucketize(spark, sf_dir):
    return _SCORES.df(spark).select("id", *[D.bucket(F.col("score"), d).alias(d) for d in ("ner", "face", "ocr")])


# --- URLs, hosts, devices ---


@crafted(f"SELECT id, clean FROM {L.URLS.sql()}")
def url_sanitize_crafted(spark, sf_dir):
    return L.URLS.df(spark).select("id", masked_url(F.col("url")).alias("clean"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), ''), '/') || regexp_extract(url, '(\?[^#]*)', 1)
 || CASE WHEN regexp_matches(regexp_extract(url, '(#.*)$', 1), '^#[A-Za-z0-9_-]{1,24}$') THEN regexp_extract(url, '(#.*)$', 1) ELSE '' END AS clean FROM pages
""")
def url_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", masked_url(F.col("url")).alias("clean"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def pages_by_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(split_url(F.col("url"))["host"].alias("host")).agg(F.count("*").alias("n"))


@crafted(f"SELECT id, private FROM {L.HOSTS.sql()}")
def private_host(spark, sf_dir):
    return L.HOSTS.df(spark).select("id", H.is_private_host(F.col("url")).alias("private"))


@crafted(f"SELECT id, endpoint FROM {L.ENDPOINTS.sql()}")
def endpoint_ok(spark, sf_dir):
    return L.ENDPOINTS.df(spark).select("id", H.endpoint(F.col("raw")).alias("endpoint"))


@crafted(f"SELECT id, kind, usable FROM {L.GPUS.sql()}")
def gpu_kind(spark, sf_dir):
    kind = H.gpu_kind(F.col("vendor"), F.col("architecture"), F.col("type"), F.col("fallback"))
    return L.GPUS.df(spark).select("id", kind.alias("kind"), H.gpu_usable(kind, F.col("vendor")).alias("usable"))


@crafted("SELECT s AS status, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s = 426 THEN 'backend_version_unsupported' WHEN s = 429 THEN 'backend_rate_limited' ELSE 'backend_error' END AS reason FROM (SELECT unnest([200, 204, 400, 426, 429, 500])::INTEGER AS s)")
def http_reason(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in (200, 204, 400, 426, 429, 500)], "status int").select("status", H.http_reason(F.col("status")).alias("reason"))


@crafted("SELECT c AS cores, least(greatest(c - 2, 1), 3)::INTEGER AS vision, least(greatest(c // 2, 1), 3)::INTEGER AS ocr FROM (SELECT unnest([1, 2, 4, 8, 16])::INTEGER AS c)")
def pool_sizes(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in (1, 2, 4, 8, 16)], "cores int").select("cores", H.pool_size(F.col("cores"), "vision").alias("vision"), H.pool_size(F.col("cores"), "ocr").alias("ocr"))


@crafted("SELECT u AS usable, f AS force, CASE WHEN f = 'wasm' OR NOT u THEN 'wasm' ELSE 'webgpu' END AS compute, coalesce(f = 'wasm' OR (f = 'webgpu' AND u), false) AS forced FROM (SELECT unnest([true, false]) AS u), (SELECT unnest(['wasm', 'webgpu', NULL]) AS f)")
def compute_target(spark, sf_dir):
    rows = spark.createDataFrame([(u, f) for u in (True, False) for f in ("wasm", "webgpu", None)], "usable boolean, force string")
    return rows.select("usable", "force", H.compute_target(F.col("usable"), F.col("force")).alias("c")).select("usable", "force", "c.*")


# --- Pages ---


def _nodes(spark, sf_dir):
    return W.nodes_of(table(spark, sf_dir, "pages"))


@query("SELECT page_id, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) FROM pages) GROUP BY page_id")
def links(spark, sf_dir):
    return _nodes(spark, sf_dir).where("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT t AS tag, sum(len(regexp_extract_all(html, '<' || t || '[ >]')))::BIGINT AS n FROM pages, (SELECT unnest(['a', 'p', 'b', 'br', 'h1', 'article', 'div']) AS t) GROUP BY t HAVING sum(len(regexp_extract_all(html, '<' || t || '[ >]'))) > 0")
def nodes_by_tag(spark, sf_dir):
    return _nodes(spark, sf_dir).where(F.col("tag").isin("a", "p", "b", "br", "h1", "article", "div")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS n")
def landmark_kept(spark, sf_dir):
    """Nodes inside landmarks are interactive, or text of such nodes."""
    return _nodes(spark, sf_dir).where("in_landmark AND NOT interactive AND NOT inside_interactive").agg(F.count("*").alias("n"))


@query("SELECT page_id, 'href' AS field, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) FROM pages) GROUP BY page_id")
def content_units(spark, sf_dir):
    return W.units_of(_nodes(spark, sf_dir)).where("field = 'href'").groupBy("page_id", "field").agg(F.count("*").alias("n"))


@query()
def page_units(spark, sf_dir):
    """All content units of pages, numbered in document order, with what the patterns find in them."""
    units = W.numbered_units(W.units_of(_nodes(spark, sf_dir)))
    return units.select("page_id", "unit", "node", "field", F.length("text").alias("chars"), F.size(pattern_spans(F.col("text"))).alias("n_spans"))


@crafted(f"SELECT id, flags FROM {L.CLASSES.sql()}")
def class_flags(spark, sf_dir):
    return L.CLASSES.df(spark).select("id", F.array_join(W.class_flags(F.col("class")), ",").alias("flags"))


@query("""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, CASE WHEN n <= 2000 THEN text ELSE substr(text, (s + 1)::BIGINT, 2000) END AS piece, s // 1950 AS w FROM (SELECT doc_id, text, n, unnest(CASE WHEN n <= 2000 THEN [0] ELSE range(0, n - 50, 1950) END) AS s FROM d))
SELECT doc_id, w::INTEGER AS w, length(piece)::INTEGER AS chars, md5(piece) AS hash FROM w
""")
def text_windows(spark, sf_dir):
    each = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(window_texts(F.col("text"))).alias("w", "piece"))
    return each.select("doc_id", "w", F.length("piece").alias("chars"), F.md5(F.col("piece").cast("binary")).alias("hash"))


@query("SELECT doc_id, md5(text) AS hash FROM documents WHERE text IS NOT NULL", "merge_windows")
def merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(merge_windows(window_texts(F.col("text"))).cast("binary")).alias("hash"))


_LINKED = "(SELECT user_id % 3 AS page_id, event_id AS node, CASE WHEN event_id % 50 = 0 THEN event_id WHEN event_id % 7 = 0 THEN NULL ELSE event_id - 3 * (1 + event_id % 2) END AS parent FROM events WHERE user_id IS NOT NULL)"


@query(f"""
WITH RECURSIVE e AS {_LINKED}, l AS (SELECT e.page_id, e.node, p.node AS parent FROM e LEFT JOIN e p ON e.page_id = p.page_id AND e.parent = p.node AND e.parent <> e.node),
t AS (SELECT page_id, node, parent, node AS root, 0 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.page_id, l.node, l.parent, t.root, t.depth + 1 FROM l JOIN t ON l.page_id = t.page_id AND l.parent = t.node)
SELECT page_id, node, parent, root, depth::BIGINT AS depth, (row_number() OVER (PARTITION BY page_id, parent ORDER BY node) - 1)::BIGINT AS place FROM t
""")
def event_forest(spark, sf_dir):
    """Trees of events by links to earlier ones; links into nothing and to themselves make roots."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    up = F.when(F.col("event_id") % 50 == 0, F.col("event_id")).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_id") - 3 * (1 + F.col("event_id") % 2))
    found = forest(e.select((F.col("user_id") % 3).alias("page_id"), F.col("event_id").alias("node"), up.alias("parent")))
    return found.withColumns({"depth": F.col("depth").cast("long"), "place": F.col("place").cast("long")})


# --- Budgets ---


@crafted("SELECT c AS ctx, least(floor(c * 0.4::DOUBLE) * 4, 12000)::INTEGER AS chars FROM (SELECT unnest([0, 100, 4096, 7499, 7500, 128000])::INTEGER AS c)")
def char_budget(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in (0, 100, 4096, 7499, 7500, 128000)], "ctx int").select("ctx", budget.char_budget(F.col("ctx")).alias("chars"))


@crafted(f"""
WITH n AS (SELECT *, CASE WHEN y + h <= 0 THEN -(y + h) WHEN y >= 800 THEN y - 800 ELSE 0 END AS dist FROM {L.NODES.sql()}),
t AS (SELECT *, CASE WHEN NOT visible THEN 3 WHEN dist > 0 THEN 2 WHEN inside_interactive THEN 0 ELSE 1 END AS tier FROM n),
r AS (SELECT page_id, node, sum(length(text)) OVER w AS c, count(*) OVER w AS u FROM t WINDOW w AS (PARTITION BY page_id ORDER BY tier, CASE WHEN tier >= 2 THEN dist ELSE 0 END, inside_interactive DESC, node ROWS UNBOUNDED PRECEDING))
SELECT page_id, node, c <= 50 AND u <= 5 AS kept FROM r
""")
def budget_select(spark, sf_dir):
    nodes = L.NODES.df(spark)
    box = F.struct("y", "h")
    units = nodes.withColumn("unit", F.col("node")).withColumn("distance", budget.distance(box, F.lit(800)))
    return budget.select_units(units, by=["page_id"], max_chars=50, max_units=5).select("page_id", "node", "kept")


@query()
def prune_pages(spark, sf_dir):
    """Pages after a tight budget: nodes kept and flags set."""
    nodes = written(_nodes(spark, sf_dir), "nodes").withColumns({"in_viewport": F.col("node") < 40, "image_omitted": F.lit(None).cast("string")})
    units = W.numbered_units(W.units_of(nodes, keep=("visible", "inside_interactive")))
    units = units.withColumn("distance", F.greatest(F.col("node") - 40, F.lit(0)))
    selected = budget.select_units(units, by=["page_id"], max_chars=2000, max_units=100)
    return budget.prune(nodes, selected).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("trimmed").alias("n_trimmed"))


@crafted(f"SELECT id, CASE WHEN w > 0 AND h > 0 AND x1 > x0 AND y1 > y0 THEN x0 || ',' || y0 || ',' || (x1 - x0) || ',' || (y1 - y0) END AS box FROM (SELECT *, greatest(0, floor(x - w * 0.1::DOUBLE))::INT AS x0, greatest(0, floor(y - h * 0.1::DOUBLE))::INT AS y0, least(iw, ceil(x + w + w * 0.1::DOUBLE))::INT AS x1, least(ih, ceil(y + h + h * 0.1::DOUBLE))::INT AS y1 FROM {L.BOXES.sql()})")
def pad_box(spark, sf_dir):
    p = B.pad_box(F.struct("x", "y", "w", "h"), F.col("iw"), F.col("ih"))
    rows = L.BOXES.df(spark).select("id", p.alias("p"))
    return rows.select("id", F.when(F.col("p").isNotNull(), F.concat_ws(",", "p.x", "p.y", "p.w", "p.h")).alias("box"))


@crafted("SELECT w, h, CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(1, floor(w * (1024.0::DOUBLE / greatest(w, h)) + 0.5)) END::INTEGER AS fw, CASE WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(1, floor(h * (1024.0::DOUBLE / greatest(w, h)) + 0.5)) END::INTEGER AS fh FROM (SELECT unnest([100, 2048, 1025, 5000])::INTEGER AS w), (SELECT unnest([1, 768, 3000])::INTEGER AS h)")
def fit_within(spark, sf_dir):
    rows = spark.createDataFrame([(w, h) for w in (100, 2048, 1025, 5000) for h in (1, 768, 3000)], "w int, h int")
    return rows.select("w", "h", B.fit_within(F.col("w"), F.col("h")).alias("f")).select("w", "h", F.col("f.w").alias("fw"), F.col("f.h").alias("fh"))


@crafted(f"""
WITH a AS (SELECT * FROM {L.DETECTIONS.sql()}), p AS (SELECT a.img, a.score AS s1, b.score AS s2, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS t FROM a JOIN a b ON a.img = b.img AND a.score > b.score)
SELECT img, s1, s2, CASE WHEN t - i > 0 THEN i / (t - i) ELSE 0.0 END AS iou FROM p
""")
def iou(spark, sf_dir):
    a = L.DETECTIONS.df(spark).select("img", F.struct("score", "x", "y", "w", "h").alias("a"))
    pairs = a.join(a.withColumnRenamed("a", "b"), "img").where("a.score > b.score")
    return pairs.select("img", F.col("a.score").alias("s1"), F.col("b.score").alias("s2"), B.iou(F.col("a"), F.col("b")).alias("iou"))


@crafted("SELECT * FROM (VALUES (1::BIGINT, 0.9::DOUBLE), (1, 0.7), (2, 0.6), (2, 0.5)) AS t(img, score)")
def nms(spark, sf_dir):
    grouped = L.DETECTIONS.df(spark).groupBy("img").agg(F.collect_list(F.struct("score", "x", "y", "w", "h")).alias("d"))
    return grouped.select("img", F.explode(B.nms(F.col("d"))).alias("k")).select("img", "k.score")


@query("SELECT doc_id, substr(sha256(source || '|' || n_chars || 'x' || doc_id), 1, 32) AS img_id FROM documents")
def img_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.img_id(F.col("source"), F.col("n_chars"), F.col("doc_id")).alias("img_id"))


@crafted(f"SELECT id, decision FROM {L.CACHE.sql()}")
def cache_decide(spark, sf_dir):
    record = F.when(F.col("validated_at").isNotNull(), F.struct("validated_at", "acquired_via", "etag", "last_modified"))
    return L.CACHE.df(spark).select("id", B.cache_decision(record, F.lit(10_000_000.0)).alias("decision"))


@query("WITH c AS (SELECT event_id AS key, event_id * 10000.0::DOUBLE AS validated_at FROM events), f AS (SELECT *, row_number() OVER (ORDER BY validated_at DESC) AS r FROM c WHERE 100000000.0 - validated_at <= 86400000) SELECT key FROM c WHERE 100000000.0 - validated_at > 86400000 UNION ALL SELECT key FROM f WHERE r > 300")
def cache_prune(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (F.col("event_id") * 10000.0).alias("validated_at"))
    return budget.prunable(records, F.lit(100_000_000.0))


@crafted("SELECT * FROM (VALUES (0::INTEGER, 0.9::DOUBLE, '0.0,0.0,8.0,8.0'), (0, 0.5, '8.0,0.0,8.0,8.0')) AS t(id, score, box)")
def decode_boxes(spark, sf_dir):
    """Boxes of a detector's level in an image of half the size: cut to it, those in the padding gone."""
    offset = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("left", "top", "right", "bottom"), v, strict=True)])
    offsets = F.array(offset(1, 1, 2, 2), offset(0, 0, 9, 9), offset(0, 0, 1, 1), offset(-1, 0, 9, 2), offset(-3, 0, 9, 2))
    scores = F.array(*[F.lit(x) for x in (0.9, 0.2, 0.1, 0.5, 0.8)])
    rows = spark.range(1).select(F.col("id").cast("int").alias("id"), B.decode_level(scores, offsets, 8, F.lit(2.0), F.lit(16.0), F.lit(8.0)).alias("d"))
    each = rows.select("id", F.explode("d").alias("d"))
    return each.select("id", "d.score", F.concat_ws(",", "d.x", "d.y", "d.w", "d.h").alias("box"))


_LINE_WORDS = "(SELECT doc_id, line, k - 1 AS word, t AS text, CASE WHEN (doc_id + k) % 3 = 0 THEN 'low' ELSE 'high' END AS confidence FROM (SELECT doc_id, line - 1 AS line, unnest(string_split(l, ' ')) AS t, generate_subscripts(string_split(l, ' '), 1) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)))"


def _line_words(spark, sf_dir):
    """Words of documents' lines as if read from an image; every third is read badly."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "_l"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("_l", " ", -1)).alias("word", "text"))
    box = F.struct(F.col("word").alias("x"), F.col("line").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    return words.select("doc_id", "line", "word", "text", F.when((F.col("doc_id") + F.col("word") + 1) % 3 == 0, "low").otherwise("high").alias("confidence"), box.alias("box"), F.lit("https://a.example").alias("origin"))


@query(f"SELECT doc_id, line::INTEGER AS line, string_agg(trim(text, chr(9) || chr(13) || ' '), ' ' ORDER BY word) AS text FROM {_LINE_WORDS} WHERE trim(text, chr(9) || chr(13) || ' ') <> '' GROUP BY ALL")
def ocr_lines(spark, sf_dir):
    """Lines of all documents from their words."""
    return I.ocr_lines(_line_words(spark, sf_dir), by=["doc_id"]).select("doc_id", "line", "text")


@query(f"SELECT doc_id, count(*)::BIGINT AS n FROM {_LINE_WORDS} WHERE confidence = 'low' AND (contains(text, '@') OR len(regexp_extract_all(text, '[0-9]')) >= 4) GROUP BY ALL")
def ocr_suspects(spark, sf_dir):
    """Badly read words that may hide an identifier, counted per document."""
    return _line_words(spark, sf_dir).where(I.is_suspect(F.col("text"), F.col("confidence"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@crafted(f"SELECT id, out AS boxes FROM {L.READ_WORDS.sql()} WHERE out IS NOT NULL")
def ocr_redactions(spark, sf_dir):
    """Words of a small image that are painted over."""
    rows = L.READ_WORDS.df(spark).withColumns({"box": F.struct("x", F.col("line").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h")), "img": F.lit(1), "origin": F.lit("https://a.example")})
    painted, _ = I.redactions(rows, by=["img", "origin"])
    return painted.join(rows.select("id", F.col("word").alias("_w"), F.col("line").alias("_l")), (F.col("word") == F.col("_w")) & (F.col("line") == F.col("_l"))).select("id", F.concat_ws(",", "box.x", "box.y").alias("boxes"))


@query("SELECT event_id, CASE WHEN user_id IS NULL OR value IS NULL OR event_type = 'error' THEN 'detector_failed' ELSE 'ok' END AS outcome, CASE WHEN user_id IS NOT NULL AND value IS NOT NULL AND event_type <> 'error' THEN (user_id % 3 + 2)::INTEGER END AS n FROM events")
def send_gate(spark, sf_dir):
    """Images pass only if every detector and the tagger answered in time."""
    e = table(spark, sf_dir, "events")
    found = lambda of, n: F.when(of.isNotNull(), F.array_repeat(F.lit(1), n.cast("int")))
    faces = I.both(found(F.col("user_id"), F.col("user_id") % 3), F.array(F.lit(1)))
    texts = I.in_time(F.array(F.lit(1)), F.when(F.col("value").isNotNull(), F.lit(10)).otherwise(40_000))
    g = I.gate(faces, texts, F.array().cast("array<int>"), F.col("event_type") != "error")
    return e.select("event_id", g.alias("g")).select("event_id", "g.outcome", F.when(F.col("g.boxes").isNotNull(), F.size("g.boxes")).alias("n"))


@crafted(f"SELECT id, looked, processed FROM {L.IMAGE_STATES.sql()}")
def image_outcomes(spark, sf_dir):
    """Lookup and processing of images in every state."""
    state = F.struct(*[c for c in L.IMAGE_STATES.df(spark).columns])
    return L.IMAGE_STATES.df(spark).select("id", I.lookup(state).alias("looked"), I.process(state).alias("processed"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE user_id IS NOT NULL AND event_type <> 'error') SELECT user_id AS page_id, event_id AS node, CASE WHEN place > 4 OR value >= 50 THEN 'request_limit' END AS image_omitted FROM r WHERE place > 4 OR value >= 50 UNION ALL SELECT user_id, event_id, 'unreadable' FROM events WHERE user_id IS NOT NULL AND event_type = 'error'")
def image_marks(spark, sf_dir):
    """Images over the limit, too large at every step, or missing."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(40).alias("w"), F.lit(40).alias("h"))
    nodes = e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("node"), "value", F.lit("img").alias("image"), F.lit(None).cast("string").alias("image_omitted"), F.lit(True).alias("visible"), F.lit(True).alias("in_viewport"), box.alias("box"), (F.col("event_type") != "error").alias("available"))
    fits = nodes.select("page_id", "node", F.when(F.col("value") < 50, 0).alias("fit"))
    return I.marks(budget.select_images(nodes.drop("value")), fits)


@query("WITH r AS (SELECT *, event_id // 1000 AS step FROM events), l AS (SELECT user_id, max(step) AS step FROM r GROUP BY ALL) SELECT r.user_id AS session_id, r.step::BIGINT AS step, r.event_id AS node FROM r JOIN l ON r.user_id IS NOT DISTINCT FROM l.user_id AND r.step = l.step WHERE event_type = 'click'")
def sendable_images(spark, sf_dir):
    """What passed in each session's last step."""
    e = table(spark, sf_dir, "events")
    images = e.select(F.col("user_id").alias("session_id"), F.expr("event_id DIV 1000").alias("step"), F.col("event_id").alias("node"), F.lit("i").alias("img_id"), F.when(F.col("event_type") == "click", "ok").otherwise("detector_failed").alias("outcome"))
    return I.sendable(images).drop("img_id")


# --- Agents ---


@crafted(f"SELECT session_id, step, idx, reason FROM {L.POLICY_REASONS.sql()}")
def policy_check(spark, sf_dir):
    return agent.check_policy(L.ACTIONS.df(spark), L.POLICY_NODES.df(spark), L.POLICY_TOKENS.df(spark)).select("session_id", "step", "idx", "reason")


@crafted(f"WITH r AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN idx END) OVER (PARTITION BY session_id, step) AS f FROM {L.POLICY_REASONS.sql()}) SELECT session_id, step, idx, CASE WHEN f IS NULL OR idx < f THEN 'run' WHEN idx = f THEN 'blocked' ELSE 'not_run' END AS result FROM r")
def policy_prefix(spark, sf_dir):
    return agent.until_blocked(agent.check_policy(L.ACTIONS.df(spark), L.POLICY_NODES.df(spark), L.POLICY_TOKENS.df(spark))).select("session_id", "step", "idx", "result")


_ANSWERS = L.Table(
    "session_id string, step int, attempt int, answer string",
    [
        ("s", 1, 1, 'Sure: {"thought":"t","actions":[{"type":"click","node_id":"n1"}],"done":false} ok'), ("s", 2, 1, '{"thought":"t"}'), ("s", 2, 2, '{"thought":"b {","actions":[],"done":true,"answer":"x"}'),
        ("s", 3, 1, "no json"), ("s", 3, 2, '{"thought":"t","actions":[{"type":"wait","ms":4000}],"done":false}'),
    ],
)


@crafted("SELECT * FROM (VALUES ('s', 1::INTEGER, 't', NULL), ('s', 2, 'b {', NULL), ('s', 3, NULL, 'backend_invalid_response')) AS t(session_id, step, thought, reason)")
def response_retry(spark, sf_dir):
    return agent.first_valid(_ANSWERS.df(spark)).select("session_id", "step", "response.thought", "reason")


@crafted(f"SELECT id, object FROM {L.ANSWERS.sql()}")
def first_object(spark, sf_dir):
    return L.ANSWERS.df(spark).select("id", agent.first_json_object(F.col("answer")).alias("object"))


@crafted("""SELECT id, 'ok' AS status, '{"a":3,"b":2}' AS index FROM (VALUES (0::BIGINT)) AS t(id)""")
def image_index(spark, sf_dir):
    """Images of an observation by node; of equal ones the last counts."""
    image = lambda i, n: F.struct(F.lit(i).alias("img_id"), F.lit(n).alias("node"))
    seen = spark.range(1).select("id", F.lit("ok").alias("status"), F.array(image("a", 1), image("b", 2), image("a", 3)).alias("images"))
    return agent.to_wire(seen, by=["id"]).select("id", F.get_json_object("json", "$.status").alias("status"), F.get_json_object("json", "$.image_index").alias("index"))


@crafted(f"SELECT session_id, step, count(*)::INTEGER AS n FROM {L.STEPS.sql()} WHERE kept GROUP BY ALL")
def session_history(spark, sf_dir):
    return agent.history(L.STEPS.df(spark).drop("kept")).select("session_id", "step", F.size("actions").alias("n"))


@query()
def observation_json(spark, sf_dir):
    """Sanitized observations of pages as JSON for the wire."""
    nodes = written(_nodes(spark, sf_dir), "nodes")
    clean = written(_sanitized_pages(spark, sf_dir, nodes), "clean")
    dom = agent.contents(clean.where("node >= 0"), nodes.select("page_id", "node", "parent", "tag", "role", "secret", "visible"), by=["page_id"])
    of = lambda i, name: F.max(F.when(F.col("node") == -i, F.col("text"))).alias(name)
    pages = clean.where("node < 0").groupBy("page_id").agg(of(1, "task"), of(2, "url"), of(3, "title"))
    return agent.to_wire(agent.assemble(pages, dom, by=["page_id"]), by=["page_id"])


def _sanitized_pages(spark, sf_dir, nodes):
    """Units of pages and of their task, URL and title, sanitized with one token map a page."""
    pages = table(spark, sf_dir, "pages")
    content = W.numbered_units(W.units_of(nodes)).drop("field_at")
    units = content.unionByName(W.page_level_units(pages, "read"), allowMissingColumns=True)
    named = units.withColumns({"session_id": F.col("page_id").cast("string"), "origin": F.regexp_extract("page_url", "^[a-z]+://[^/]+", 0)})
    return T.sanitize(named)[0]


@query("""
SELECT page_id, 'href' AS field, array_to_string(list_transform(string_split(h, '/'), lambda s: replace(replace(replace(replace(replace(url_encode(url_decode(s)), '%21', '!'), '%2A', '*'), '%27', chr(39)), '%28', '('), '%29', ')')), '/') AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
UNION ALL SELECT page_id, 'url', url FROM pages
UNION ALL SELECT page_id, 'title', replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') FROM pages
UNION ALL SELECT page_id, 'task', 'read' FROM pages
""")
def page_links(spark, sf_dir):
    """Links, URL, title and task of pages as they leave."""
    clean = _sanitized_pages(spark, sf_dir, _nodes(spark, sf_dir))
    field = F.when(F.col("node") == -1, "task").when(F.col("node") == -2, "url").when(F.col("node") == -3, "title").otherwise(F.col("field"))
    return clean.where("field = 'href' OR node < 0").select("page_id", field.alias("field"), "text")


@crafted(f"SELECT unit, out AS text FROM {L.LINKS.sql()}")
def link_tokens(spark, sf_dir):
    """Links and texts of one session share tokens; sensitive values go whole."""
    return T.sanitize(L.LINKS.df(spark).drop("out"))[0].select("unit", "text")


# --- Metrics ---

_LOGS = "(SELECT event_type AS op, value AS duration_ms, CASE WHEN user_id % 3 = 0 THEN value / 2 END AS queue_ms, CASE event_type WHEN 'error' THEN 'fail_closed' ELSE 'ok' END AS outcome FROM events)"


def _logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("op"), F.col("value").alias("duration_ms"), F.when(F.col("user_id") % 3 == 0, F.col("value") / 2).alias("queue_ms"), F.when(F.col("event_type") == "error", "fail_closed").otherwise("ok").alias("outcome"))


def _at(v: str, p: float) -> str:
    return f"list_sort(list({v}) FILTER ({v} IS NOT NULL))[(least(count({v}) - 1, floor({p}::DOUBLE * count({v}))) + 1)::INT]"


@query(f"SELECT op, count(duration_ms)::BIGINT AS n, {_at('duration_ms', 0.5)} AS p50, {_at('duration_ms', 0.95)} AS p95, {_at('queue_ms', 0.5)} AS queue_p50, {_at('queue_ms', 0.95)} AS queue_p95 FROM {_LOGS} GROUP BY op")
def op_percentiles(spark, sf_dir):
    return metrics.op_summary(_logs(spark, sf_dir))


@query("SELECT count_if(event_type = 'click')::DOUBLE / nullif(count_if(event_type IN ('click', 'view')), 0) AS hit_rate, count_if(event_type = 'error')::BIGINT AS fail_closed FROM events")
def cache_hit_rate(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    named = F.when(F.col("op") == "click", "image.cache_hit").when(F.col("op") == "view", "image.cache_miss").otherwise(F.col("op"))
    return metrics.rates(logs.withColumn("op", named))


@crafted("""SELECT * FROM (VALUES ('"a,b",1,x,,,,,,,,,'), ('"q""q",,y,,,,,"l1' || chr(10) || 'l2",,,,'), ('plain,3,z,,,,,ok,,,,')) AS t(line)""")
def log_csv(spark, sf_dir):
    empty = {c: F.lit(None).cast("string") for c in metrics.CSV_COLUMNS if c not in ("session_id", "step", "op", "reason")}
    return csv_lines(L.LOG_FIELDS.df(spark).withColumns(empty))


_TRUTH = L.Table("img_id bigint, truth_id bigint, size bigint, x double, y double, w double, h double", [(1, 1, 20, 0.0, 0.0, 20.0, 20.0), (1, 2, 40, 100.0, 100.0, 40.0, 40.0), (2, 3, 20, 0.0, 0.0, 20.0, 20.0)])
_FOUND = L.Table("img_id bigint, det_id bigint, x double, y double, w double, h double", [(1, 1, 1.0, 1.0, 18.0, 18.0), (1, 2, 2.0, 2.0, 17.0, 17.0), (2, 3, 90.0, 90.0, 5.0, 5.0)])


@crafted("SELECT * FROM (VALUES (20::BIGINT, 2::BIGINT, 1::BIGINT, 0.5::DOUBLE), (40, 1, 0, 0.0)) AS t(size, n, found, recall)")
def recall_by_size(spark, sf_dir):
    return metrics.recall_by_size(metrics.match_boxes(_TRUTH.df(spark), _FOUND.df(spark)))


@query("SELECT conv_id, string_agg(role || ' ' || n, ', ' ORDER BY role || ' ' || n) AS breakdown FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def role_breakdown(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("kind")).agg(F.count("*").alias("n"))
    return metrics.breakdown(counts, by=["conv_id"])


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def session_upsert(spark, sf_dir):
    return budget.latest(table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "event_id"), key=["user_id"], order="event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10000")
def ring_buffer(spark, sf_dir):
    return budget.newest(table(spark, sf_dir, "events").select("event_id"), order="event_id", most=10_000)


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 200)::INTEGER AS chunk FROM conversations")
def unit_chunks(spark, sf_dir):
    from ..operators.windows import numbered_chunks

    return numbered_chunks(table(spark, sf_dir, "conversations"), ["role"], ["conv_id", "turn"]).select("conv_id", "turn", "chunk")


@query("SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3 AS started FROM events")
def budget_queue(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("ok"))
    return budget.run_with_budget(items, by=["user_id"], order=["event_id"], budget=3).select("user_id", "event_id", "started")


from . import derived  # noqa: E402, F401  registers its queries here
