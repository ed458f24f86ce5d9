"""Queries over inputs derived from the shared tables, and SQL that derives and answers the same.

Each query makes what its operator takes (numbers, addresses, links, boxes,
answers of a model) from columns of a table by a rule that both sides know, so
its work grows with the table; small fixed lists only give the kinds of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import hosts as H
from ..functions.checksums import is_luhn, is_verhoeff
from ..functions.email import FREE_MAIL, ROLE_NAMES, is_public, public_score
from ..functions.spans import pattern_spans, placeholder_counts
from ..functions.urls import masked_url
from ..operators import agent, budget, metrics
from ..operators import detect as D
from ..operators import html as W
from ..operators import images as I
from ..operators import tokens as T
from ..sources.logs import csv_lines
from ..sources.tables import dealt, table
from . import literals as L
from .queries import _LUHN, _VERHOEFF, query


def pick(key: Column, *values) -> Column:
    """One of the values by key modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def picked(key: str, *values) -> str:
    """SQL of pick()."""
    text = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{text}])[(({key}) % {len(values)} + 1)::INT]"


def _customers(spark, sf_dir, *columns: str) -> DataFrame:
    """Customers by key, with the given columns."""
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", *columns), "c_custkey")


def _spans(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    each = rows.select(*keep, F.explode(pattern_spans(text)).alias("s"))
    return each.select(*keep, "s.type", "s.start", F.col("s.end").alias("end_"))


# --- Texts ---


@query(f"WITH d AS (SELECT o_orderkey, lpad(((o_orderkey * 7919 + 4111111111111) % 100000000000000)::VARCHAR, (13 + o_orderkey % 4)::INT, '0') AS d FROM orders) SELECT o_orderkey, {_LUHN.format(d='d')} AS ok FROM d")
def luhn(spark, sf_dir):
    key = F.col("o_orderkey")
    digits = F.lpad(((key * 7919 + F.lit(4111111111111)) % F.lit(100000000000000)).cast("string"), (13 + key % 4).cast("int"), F.lit("0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", is_luhn(digits).alias("ok"))


@query(f"WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 104729 + 234567890124)::VARCHAR, 12, '0') AS d FROM orders) SELECT o_orderkey, {_VERHOEFF.format(d='d')} AS ok FROM d")
def verhoeff(spark, sf_dir):
    digits = F.lpad((F.col("o_orderkey") * 104729 + F.lit(234567890124)).cast("string"), 12, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", is_verhoeff(digits).alias("ok"))


@query("""
WITH u AS (SELECT c_custkey, 'u' || c_custkey AS u FROM customer)
SELECT c_custkey, 'UPI' AS type, 4 AS start, (4 + length(u) + 7)::INTEGER AS end_ FROM u
UNION ALL SELECT c_custkey, 'EMAIL', (4 + length(u) + 7 + 4)::INTEGER, (4 + 2 * length(u) + 7 + 4 + 11)::INTEGER FROM u
UNION ALL SELECT c_custkey, 'GSTIN', (4 + 2 * length(u) + 7 + 4 + 11 + 1)::INTEGER, (4 + 2 * length(u) + 7 + 4 + 11 + 16)::INTEGER FROM u
""")
def span_claims(spark, sf_dir):
    """Handles, addresses and numbers that hold one another: earlier patterns claim their text first."""
    u = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    text = F.concat(F.lit("pay "), u, F.lit("@okbank or "), u, F.lit("@okbank.com 27ABCPE1234F1Z5"))
    return _spans(_customers(spark, sf_dir), text, "c_custkey")


def _planted(spark, sf_dir) -> DataFrame:
    """Documents by id, each with one of the canaries."""
    ids = dealt(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id"), "doc_id")
    return ids.join(F.broadcast(L.CANARIES.df(spark)), F.pmod("doc_id", F.lit(len(L.CANARIES.rows))) == -F.col("id") - 1)


_PLANTED = f"(SELECT doc_id, c.* FROM documents JOIN {L.CANARIES.sql()} c ON doc_id % {len(L.CANARIES.rows)} = -c.id - 1)"


@query(f"SELECT doc_id, kind AS type, (length(doc_id::VARCHAR) + 2)::INTEGER AS start, (length(doc_id::VARCHAR) + 2 + length(value))::INTEGER AS end_ FROM {_PLANTED} WHERE found")
def canary_spans(spark, sf_dir):
    return _spans(_planted(spark, sf_dir), F.concat(F.col("doc_id").cast("string"), F.lit(": "), "value", F.lit(" .")), "doc_id")


@query(f"SELECT doc_id, found AND kind <> 'EMAIL' AS blocked FROM {_PLANTED}")
def final_guard(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", D.guard_triggered(F.array(F.lit("title"), F.concat(F.lit("x "), "value"))).alias("blocked"))


_MARKED = "(SELECT conv_id, turn, 'to [PII_NAME_' || (turn % 2) || '], [PII_NAME_2]: ' || repeat('[SECRET] ', (conv_id % 3)::INT) || '[PII_EMAIL_' || conv_id || ']' AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"


def _marked(spark, sf_dir) -> DataFrame:
    """Texts with tokens, one a turn of a conversation."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    text = F.concat(F.lit("to [PII_NAME_"), (F.col("turn") % 2).cast("string"), F.lit("], [PII_NAME_2]: "), F.expr("repeat('[SECRET] ', CAST(conv_id % 3 AS INT))"), F.lit("[PII_EMAIL_"), F.col("conv_id").cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", text.alias("text"))


@query(f"SELECT conv_id, turn, k.kind, CASE k.kind WHEN 'NAME' THEN 2 WHEN 'EMAIL' THEN 1 ELSE conv_id % 3 END::INTEGER AS n FROM {_MARKED}, (SELECT unnest(['NAME', 'EMAIL', 'SECRET']) AS kind) k WHERE k.kind <> 'SECRET' OR conv_id % 3 > 0", "placeholder_counts")
def placeholder_counts_query(spark, sf_dir):
    return _marked(spark, sf_dir).select("conv_id", "turn", F.explode(placeholder_counts(F.col("text"))).alias("kind", "n"))


@query(f"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN replace(replace(text, '[PII_NAME_1]', 'name ' || conv_id), '[PII_EMAIL_' || conv_id || ']', 'u' || conv_id || '@a.example') ELSE text END AS text FROM {_MARKED}")
def resolve_tokens(spark, sf_dir):
    """Tokens of every second conversation are known; others stay."""
    texts = _marked(spark, sf_dir)
    key = F.col("conv_id").cast("string")
    held = texts.select("conv_id").distinct().where("conv_id % 2 = 0")
    pair = lambda token, value: F.struct(token.alias("token"), value.alias("value"))
    tokens = held.select(key.alias("session_id"), F.inline(F.array(pair(F.lit("[PII_NAME_1]"), F.concat(F.lit("name "), key)), pair(F.concat(F.lit("[PII_EMAIL_"), key, F.lit("]")), F.concat(F.lit("u"), key, F.lit("@a.example"))))))
    rows = texts.distinct().select(key.alias("session_id"), F.struct("conv_id", "turn").alias("id"), "text")
    return T.resolve(rows, tokens).select("id.conv_id", "id.turn", "text")


# --- Deciding ---

_LOCALS, _DOMAINS = ("support", "ram", "HR", "no-reply", "info"), ("gmail.com", "shop.example.com", "example.com", "EXAMPLE.com", "other.org", "proton.me", "example.com.evil.org")


def _addresses(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    flag = lambda n: (key % n == 0)
    hints = F.struct(flag(2).alias("in_landmark"), flag(3).alias("near_contact_heading"), flag(5).alias("in_contact_markup"), flag(7).alias("in_ugc_block"))
    email = F.concat(pick(key, *_LOCALS), F.lit("@"), pick(key, *_DOMAINS))
    return table(spark, sf_dir, "customer").select("c_custkey", email.alias("email"), F.lit("https://example.com").alias("origin"), hints.alias("hints"), flag(4).alias("is_mailto"))


_SCORED = f"""(SELECT c_custkey, (CASE WHEN lower({picked('c_custkey', *_LOCALS)}) IN ({', '.join(f"'{r}'" for r in ROLE_NAMES)}) THEN 3 ELSE 0 END
 + CASE WHEN lower({picked('c_custkey', *_DOMAINS)}) = 'example.com' OR ends_with(lower({picked('c_custkey', *_DOMAINS)}), '.example.com') THEN 3 ELSE 0 END
 - CASE WHEN lower({picked('c_custkey', *_DOMAINS)}) IN ({', '.join(f"'{h}'" for h in FREE_MAIL)}) THEN 4 ELSE 0 END
 + CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 4 = 0) THEN 2 ELSE 0 END - CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END)::INTEGER AS score FROM customer)"""


@query(f"SELECT c_custkey, score FROM {_SCORED}")
def email_score(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", public_score(F.col("email"), F.col("origin"), F.col("hints"), F.col("is_mailto")).alias("score"))


@query(f"SELECT c_custkey, score >= 4 AS public FROM {_SCORED}")
def public_email(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", is_public(F.col("email"), F.col("origin"), F.col("hints"), F.col("is_mailto")).alias("public"))


@query("SELECT c_custkey, 'NAME:0:' || length(c_name) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ',EMAIL:' || (length(c_name) + 4) || ':' || (length(c_name) + 4 + length('u' || c_custkey || '@b.example')) END || ',OTHER:' || (length(c_name) + 5 + length(CASE WHEN c_custkey % 2 = 0 THEN 'support@example.com' ELSE 'u' || c_custkey || '@b.example' END)) || ':' || (length(c_name) + 10 + length(CASE WHEN c_custkey % 2 = 0 THEN 'support@example.com' ELSE 'u' || c_custkey || '@b.example' END)) AS spans FROM customer")
def decide_spans(spark, sf_dir):
    """A name, an address and a word of unknown kind: tags on addresses fall away, public addresses go, kinds nobody knows are OTHER."""
    mail = F.when(F.col("c_custkey") % 2 == 0, "support@example.com").otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@b.example")))
    rows = _customers(spark, sf_dir, "c_name").select("c_custkey", F.length("c_name").alias("n"), F.length(mail).alias("m"), F.concat("c_name", F.lit(" to "), mail, F.lit(" today")).alias("text"))
    tag = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    n, m = F.col("n"), F.col("m")
    tags = F.array(tag("NAME", F.lit(0), n), tag("EMAIL", n + 5, n + 8), tag("WHAT", n + m + 5, n + m + 10))
    decided = D.decide(F.col("text"), pattern_spans(F.col("text")), tags, F.lit("https://example.com"))
    return rows.select("c_custkey", F.array_join(F.transform(decided, lambda s: F.concat_ws(":", s["type"], s["start"], s["end"])), ",").alias("spans"))


@query("SELECT c_custkey, 'mail [PII_EMAIL] or ' || c_name AS shown, 'NAME:' || (5 + length('u' || c_custkey || '@c.example') + 4) || ':' || (5 + length('u' || c_custkey || '@c.example') + 4 + length(c_name)) AS moved FROM customer")
def mask_map(spark, sf_dir):
    """What a tagger sees, and its tags moved back; a tag on the mask is dropped."""
    text = F.concat(F.lit("mail u"), F.col("c_custkey").cast("string"), F.lit("@c.example or "), "c_name")
    rows = _customers(spark, sf_dir, "c_name").select("c_custkey", "c_name", text.alias("text")).withColumn("m", D.masked(F.col("text"), pattern_spans(F.col("text"))))
    tag = lambda s, e: F.struct(F.lit("NAME").alias("type"), s.cast("int").alias("start"), e.cast("int").alias("end"))
    moved = D.unmasked(F.array(tag(F.lit(20), F.lit(20) + F.length("c_name")), tag(F.lit(4), F.lit(8))), F.col("m.places"))
    return rows.select("c_custkey", F.col("m.text").alias("shown"), F.array_join(F.transform(moved, lambda s: F.concat_ws(":", s["type"], s["start"], s["end"])), ",").alias("moved"))


_ENTITIES = ("B-PERSON", "I-PERSON", "I-PERSON", "O", "I-LOCATION", "S-AGE", "E-LOCATION")


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, min(l_partkey * 31 + l_suppkey) AS k, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
e AS (SELECT l_orderkey, l_linenumber, q / 50 AS score, {picked('k', *_ENTITIES)} AS entity FROM t),
l AS (SELECT *, regexp_replace(entity, '^[BIESU]-', '') AS label, CASE WHEN entity = 'O' THEN 'O' ELSE substr(entity, 1, 1) END AS mark FROM e),
s AS (SELECT *, CASE WHEN mark IN ('B', 'S', 'U') OR lag(label) OVER w IS NULL OR lag(label) OVER w <> label OR lag(mark) OVER w IN ('O', 'S', 'E', 'U') THEN 1 ELSE 0 END AS starts FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM s)
SELECT l_orderkey AS text_id, any_value(label) AS label, min(l_linenumber * 10)::INTEGER AS start, max(l_linenumber * 10 + 9)::INTEGER AS end_, avg(score) AS score FROM r WHERE mark <> 'O' GROUP BY l_orderkey, run
""")
def bio_group(spark, sf_dir):
    """Tagged pieces, one a line of an order, as entities."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") * 31 + F.col("l_suppkey")).alias("k"), F.min("l_quantity").alias("q"))
    at = F.col("l_linenumber")
    pieces = lines.select(F.col("l_orderkey").alias("text_id"), at.cast("int").alias("idx"), pick(F.col("k"), *_ENTITIES).alias("entity"), (F.col("q") / 50).alias("score"), (at * 10).cast("int").alias("start"), (at * 10 + 9).cast("int").alias("end"))
    return D.group_entities(pieces).withColumnRenamed("end", "end_")


_LABELS = ("PERSON", "LOCATION", "ORGANIZATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_PASSPORT", "DATE_TIME", "NEVER_SEEN")
_TYPES = ("NAME", "ADDRESS", None, "EMAIL", "PHONE", "CARD", "PASSPORT", "OTHER", "OTHER")


@query(f"SELECT event_id, {picked('event_id', *_LABELS)} AS label, {picked('event_id', *_TYPES)} AS type FROM events")
def label_map(spark, sf_dir):
    label = pick(F.col("event_id"), *_LABELS)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"), D.label_type(label).alias("type"))


@query("SELECT event_id, CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS ner, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS face, CASE WHEN value >= 85 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS ocr FROM (SELECT event_id, value, value / 100 AS s FROM events)")
def bucketize(spark, sf_dir):
    s = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", D.bucket(s, "ner").alias("ner"), D.bucket(s, "face").alias("face"), D.bucket(F.col("value"), "ocr").alias("ocr"))


# --- URLs, hosts, devices ---


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://host' || page_id || '.example/a/b?token=%5BPII_OTHER%5D&page=' || page_id || '#top' WHEN 1 THEN '/p/%5BPII_EMAIL%5D?id=' || CASE WHEN length((page_id * 1000)::VARCHAR) > 8 THEN '%5BPII_OTHER%5D' ELSE (page_id * 1000)::VARCHAR END
 WHEN 2 THEN 'https://x.example/?email=&q=%5BPII_EMAIL%5D' WHEN 3 THEN 'mailto://%5BPII_EMAIL%5D' WHEN 4 THEN NULL ELSE '/%zz/[PII_EMAIL]/' || page_id END AS clean FROM pages
""")
def url_sanitize_crafted(spark, sf_dir):
    """Links of all kinds, one a page: users and sensitive values go, relative paths gain a slash, absolute links with malformed codes are withheld."""
    key = F.col("page_id").cast("string")
    at = F.pmod("page_id", F.lit(6))
    url = F.when(at == 0, F.concat(F.lit("https://user:pw@Host"), key, F.lit(".example:443/a/b?token=t"), key, F.lit("&page="), key, F.lit("#top")))
    url = url.when(at == 1, F.concat(F.lit("/p/u"), key, F.lit("%40b.example?id="), key, F.lit("000"))).when(at == 2, F.concat(F.lit("https://x.example/?email=&q=u"), key, F.lit("@b.example")))
    url = url.when(at == 3, F.concat(F.lit("mailto:u"), key, F.lit("@b.example"))).when(at == 4, F.concat(F.lit("https://x.example/50%zz?token="), key)).otherwise(F.concat(F.lit("/%zz/u"), key, F.lit("@b.example/"), key))
    return dealt(table(spark, sf_dir, "pages").select("page_id"), "page_id").select("page_id", masked_url(url).alias("clean"))


_NETS = (10, 172, 192, 169, 100, 127, 8, 0)


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 2 = 0 ELSE a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) END AS private FROM (SELECT c_custkey, {picked('c_custkey', *_NETS)} AS a, CASE WHEN c_custkey % 3 = 0 THEN 168 WHEN c_custkey % 5 = 0 THEN 254 ELSE c_custkey % 130 END AS b FROM customer)")
def private_host(spark, sf_dir):
    """Addresses and names of hosts, one a customer."""
    key = F.col("c_custkey")
    b = F.when(key % 3 == 0, 168).when(key % 5 == 0, 254).otherwise(key % 130)
    url = F.concat(F.lit("http://"), pick(key, *_NETS).cast("string"), F.lit("."), b.cast("string"), F.lit(".1.2:80/x"))
    named = F.when(key % 9 == 0, F.concat(F.lit("https://h"), key.cast("string"), F.when(key % 2 == 0, ".LAN/").otherwise(".lan.example/"))).otherwise(url)
    return table(spark, sf_dir, "customer").select("c_custkey", H.is_private_host(named).alias("private"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://api' || c_custkey || '.example/v1' WHEN 1 THEN 'http://localhost:' || (3000 + c_custkey) WHEN 4 THEN 'https://h' || c_custkey || '.example' END AS endpoint FROM customer")
def endpoint_ok(spark, sf_dir):
    key, at = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    raw = F.when(at == 0, F.concat(F.lit(" https://API"), key, F.lit(".example:443/v1/"))).when(at == 1, F.concat(F.lit("http://localhost:"), (F.col("c_custkey") + 3000).cast("string"), F.lit("//")))
    raw = raw.when(at == 2, F.concat(F.lit("http://api"), key, F.lit(".example"))).when(at == 3, F.concat(F.lit("https://u:p@api"), key, F.lit(".example"))).otherwise(F.concat(F.lit("https://h"), key, F.lit(".example")))
    return table(spark, sf_dir, "customer").select("c_custkey", H.endpoint(raw).alias("endpoint"))


_VENDORS = ("nvidia", "intel", "apple", "google", "amd")


@query(f"SELECT event_id, kind, kind = 'discrete' OR (kind = 'integrated' AND vendor = 'apple') AS usable FROM (SELECT event_id, {picked('event_id', *_VENDORS)} AS vendor, CASE WHEN event_id % 11 = 0 THEN 'software' ELSE {picked('event_id', 'discrete', 'integrated', 'integrated', 'software', 'unknown')} END AS kind FROM events)")
def gpu_kind(spark, sf_dir):
    key = F.col("event_id")
    vendor, arch = pick(key, *_VENDORS), pick(key, "ampere", "gen-9", "m1", "swiftshader", "rdna")
    kind = H.gpu_kind(vendor, arch, F.lit(None).cast("string"), key % 11 == 0)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), H.gpu_usable(kind, vendor).alias("usable"))


@query("SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s = 426 THEN 'backend_version_unsupported' WHEN s = 429 THEN 'backend_rate_limited' ELSE 'backend_error' END AS reason FROM (SELECT event_id, 200 + event_id % 331 AS s FROM events)")
def http_reason(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", H.http_reason(200 + F.col("event_id") % 331).alias("reason"))


@query("SELECT event_id, least(greatest(c - 2, 1), 3)::INTEGER AS vision, least(greatest(c // 2, 1), 3)::INTEGER AS ocr FROM (SELECT event_id, event_id % 17 + 1 AS c FROM events)")
def pool_sizes(spark, sf_dir):
    cores = F.col("event_id") % 17 + 1
    return table(spark, sf_dir, "events").select("event_id", H.pool_size(cores, "vision").alias("vision"), H.pool_size(cores, "ocr").alias("ocr"))


@query("SELECT event_id, CASE WHEN f = 'wasm' OR NOT u THEN 'wasm' ELSE 'webgpu' END AS compute, coalesce(f = 'wasm' OR (f = 'webgpu' AND u), false) AS forced FROM (SELECT event_id, event_id % 2 = 0 AS u, ([NULL, 'wasm', 'webgpu'])[(event_id % 3 + 1)::INT] AS f FROM events)")
def compute_target(spark, sf_dir):
    force = pick(F.col("event_id"), None, "wasm", "webgpu")
    return table(spark, sf_dir, "events").select("event_id", H.compute_target(F.col("event_id") % 2 == 0, force).alias("c")).select("event_id", "c.*")


_WORDS, _WORD_FLAGS = ("btn", "is-invalid", "disabled-link", "Active", "d-none", "interactive"), ("", "error", "disabled", "active", "hidden", "")


@query(f"SELECT event_id, array_to_string(list_filter([a, CASE WHEN b <> a THEN b ELSE '' END], lambda x: x <> ''), ',') AS flags FROM (SELECT event_id, {picked('event_id', *_WORD_FLAGS)} AS a, {picked('user_id', *_WORD_FLAGS)} AS b FROM events WHERE user_id IS NOT NULL)")
def class_flags(spark, sf_dir):
    classes = F.concat(pick(F.col("event_id"), *_WORDS), F.lit("  "), pick(F.col("user_id"), *_WORDS))
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("event_id", F.array_join(W.class_flags(classes), ",").alias("flags"))


# --- Budgets and boxes ---


@query("SELECT doc_id, least(floor(n_chars * 0.4::DOUBLE) * 4, 12000)::INTEGER AS chars FROM documents")
def char_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", budget.char_budget(F.col("n_chars")).alias("chars"))


@query("""
WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS node FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT *, CASE WHEN (node * 7 + page_id) % 30 * 60 - 100 + 20 <= 0 THEN -((node * 7 + page_id) % 30 * 60 - 80) WHEN (node * 7 + page_id) % 30 * 60 - 100 >= 800 THEN (node * 7 + page_id) % 30 * 60 - 900 ELSE 0 END AS dist, node % 5 <> 0 AS visible, node % 3 = 0 AS inside FROM l),
t AS (SELECT *, CASE WHEN NOT visible THEN 3 WHEN dist > 0 THEN 2 WHEN inside THEN 0 ELSE 1 END AS tier FROM n),
r AS (SELECT page_id, node, sum(length(text)) OVER w AS c, count(*) OVER w AS u FROM t WINDOW w AS (PARTITION BY page_id ORDER BY tier, CASE WHEN tier >= 2 THEN dist ELSE 0 END, inside DESC, node ROWS UNBOUNDED PRECEDING))
SELECT page_id, node::INTEGER AS node, c <= 600 AND u <= 12 AS kept FROM r
""")
def budget_select(spark, sf_dir):
    """Lines of documents as nodes of a page, nearest first within both budgets."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    lines = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("node", "text"))
    top = F.pmod(F.col("node") * 7 + F.col("page_id"), F.lit(30)) * 60 - 100
    units = lines.withColumns({"field": F.lit("text"), "unit": F.col("node"), "visible": F.col("node") % 5 != 0, "inside_interactive": F.col("node") % 3 == 0, "distance": budget.distance(F.struct(top.alias("y"), F.lit(20).alias("h")), F.lit(800))})
    return budget.select_units(units, by=["page_id"], max_chars=600, max_units=12).select("page_id", "node", "kept")


_BOXED = "(SELECT event_id, (event_id % 37) * 3.5::DOUBLE - 5 AS x, (event_id % 23) * 4.0::DOUBLE AS y, (event_id % 11) * 2.5::DOUBLE AS w, (event_id % 7) * 6.0::DOUBLE AS h, 100 AS iw, 90 AS ih FROM events)"


def _boxed(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", B.box((k % 37) * 3.5 - 5, (k % 23) * 4.0, (k % 11) * 2.5, (k % 7) * 6.0).alias("box"))


@query(f"SELECT event_id, CASE WHEN w > 0 AND h > 0 AND x1 > x0 AND y1 > y0 THEN x0 || ',' || y0 || ',' || (x1 - x0) || ',' || (y1 - y0) END AS box FROM (SELECT *, greatest(0, floor(x - w * 0.1::DOUBLE))::INT AS x0, greatest(0, floor(y - h * 0.1::DOUBLE))::INT AS y0, least(iw, ceil(x + w + w * 0.1::DOUBLE))::INT AS x1, least(ih, ceil(y + h + h * 0.1::DOUBLE))::INT AS y1 FROM {_BOXED})")
def pad_box(spark, sf_dir):
    rows = _boxed(spark, sf_dir).select("event_id", B.pad_box(F.col("box"), F.lit(100), F.lit(90)).alias("p"))
    return rows.select("event_id", F.when(F.col("p").isNotNull(), F.concat_ws(",", "p.x", "p.y", "p.w", "p.h")).alias("box"))


@query("SELECT event_id, CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(1, floor(w * (1024.0::DOUBLE / greatest(w, h)) + 0.5)) END::INTEGER AS fw, CASE WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(1, floor(h * (1024.0::DOUBLE / greatest(w, h)) + 0.5)) END::INTEGER AS fh FROM (SELECT event_id, (event_id * 7 % 3000 + 1)::INTEGER AS w, (event_id * 11 % 2500 + 1)::INTEGER AS h FROM events)")
def fit_within(spark, sf_dir):
    k = F.col("event_id")
    fit = B.fit_within((k * 7 % 3000 + 1).cast("int"), (k * 11 % 2500 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", fit.alias("f")).select("event_id", F.col("f.w").alias("fw"), F.col("f.h").alias("fh"))


_OVERLAP = "CASE WHEN a.w * a.h + b.w * b.h - i > 0 THEN i / (a.w * a.h + b.w * b.h - i) ELSE 0.0 END"
_TWO = f"(SELECT a.event_id, {_OVERLAP} AS iou FROM (SELECT a, b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM {_BOXED} a JOIN (SELECT event_id, x + event_id % 4 AS x, y + event_id % 3 AS y, w + 1 AS w, h + event_id % 2 AS h FROM {_BOXED}) b ON a.event_id = b.event_id))"


def _other(box: Column) -> Column:
    k = F.col("event_id")
    return B.box(box["x"] + k % 4, box["y"] + k % 3, box["w"] + 1, box["h"] + k % 2)


@query(f"SELECT event_id, iou FROM {_TWO}")
def iou(spark, sf_dir):
    return _boxed(spark, sf_dir).select("event_id", B.iou(F.col("box"), _other(F.col("box"))).alias("iou"))


@query(f"SELECT event_id, (CASE WHEN iou > 0.4 THEN 1 ELSE 2 END)::INTEGER AS n, 0.9::DOUBLE AS best FROM {_TWO}")
def nms(spark, sf_dir):
    """Two detections each: the weaker one goes if they overlap too much."""
    scored = lambda b, s: F.struct(F.lit(s).alias("score"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))
    rows = _boxed(spark, sf_dir).select("event_id", B.nms(F.array(scored(_other(F.col("box")), 0.5), scored(F.col("box"), 0.9))).alias("k"))
    return rows.select("event_id", F.size("k").alias("n"), F.get("k", F.lit(0))["score"].alias("best"))


@query("""
WITH a AS (SELECT event_id, unnest(range(5)) AS i FROM events), s AS (SELECT event_id, i, ((event_id + i * 3) % 10) / 10.0::DOUBLE AS score, (i // 2) * 8 AS cx, (event_id + i) % 3 AS l, event_id % 2 AS t, (event_id * 2 + i) % 4 AS r, 1 + i % 2 AS b FROM a),
d AS (SELECT event_id, i, score, greatest(0.0, (cx - l * 8) / 2.0::DOUBLE) AS x0, greatest(0.0, (0 - t * 8) / 2.0::DOUBLE) AS y0, least(16.0, (cx + r * 8) / 2.0::DOUBLE) AS x1, least(8.0, (b * 8) / 2.0::DOUBLE) AS y1 FROM s)
SELECT event_id, count(*)::BIGINT AS n, sum((x1 - x0) * (y1 - y0)) AS area FROM d WHERE score >= 0.3 AND x1 > x0 AND y1 > y0 GROUP BY event_id
""")
def decode_boxes(spark, sf_dir):
    """Boxes of a detector's level in an image of half the size, with offsets and scores by event."""
    k = F.col("event_id")
    offset = lambda i: F.struct(((k + i) % 3).cast("double").alias("left"), (k % 2).cast("double").alias("top"), ((k * 2 + i) % 4).cast("double").alias("right"), F.lit(1.0 + i % 2).alias("bottom"))
    scores = F.array(*[((k + i * 3) % 10) / 10 for i in range(5)])
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(B.decode_level(scores, F.array(*[offset(i) for i in range(5)]), 8, F.lit(2.0), F.lit(16.0), F.lit(8.0))).alias("d"))
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.col("d.w") * F.col("d.h")).alias("area"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'miss' WHEN 10000000 - event_id * 1000.0::DOUBLE <= 1800000 THEN 'fresh' WHEN event_id % 3 <> 0 AND (event_id % 2 = 0 OR event_id % 5 = 0) THEN 'conditional' ELSE 'rehash' END AS decision FROM events")
def cache_decide(spark, sf_dir):
    k = F.col("event_id")
    record = F.struct((k * 1000.0).alias("validated_at"), F.when(k % 3 == 0, "pixels").otherwise("fetch").alias("acquired_via"), F.when(k % 2 == 0, "e").alias("etag"), F.when(k % 5 == 0, "m").alias("last_modified"))
    return table(spark, sf_dir, "events").select("event_id", B.cache_decision(F.when(F.col("event_type") != "error", record), F.lit(10_000_000.0)).alias("decision"))


def _copies(spark, sf_dir, rows: L.Table) -> DataFrame:
    """The cases of a small list of fixed length for every customer."""
    return _customers(spark, sf_dir).join(F.broadcast(rows.df(spark)))


def _each(rows: L.Table) -> str:
    return f"(SELECT c_custkey, r.* FROM customer, {rows.sql()} r)"


@query(f"SELECT c_custkey, id, looked, processed FROM {_each(L.IMAGE_STATES)}")
def image_outcomes(spark, sf_dir):
    """Lookup and processing of images in every state, for each customer."""
    rows = _copies(spark, sf_dir, L.IMAGE_STATES)
    state = F.struct(*[c for c, _ in L.IMAGE_STATES.columns])
    return rows.select("c_custkey", "id", I.lookup(state).alias("looked"), I.process(state).alias("processed"))


@query(f"SELECT c_custkey, id, out AS boxes FROM {_each(L.READ_WORDS)} WHERE out IS NOT NULL")
def ocr_redactions(spark, sf_dir):
    """Words of an image of each customer that are painted over."""
    rows = _copies(spark, sf_dir, L.READ_WORDS).withColumns({"box": F.struct("x", F.col("line").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h")), "origin": F.lit("https://a.example")})
    painted, _ = I.redactions(rows, by=["c_custkey", "origin"])
    named = rows.select("c_custkey", "id", "word", "line")
    return painted.join(named, ["c_custkey", "word", "line"]).select("c_custkey", "id", F.concat_ws(",", "box.x", "box.y").alias("boxes"))


# --- Agents ---

_TWIN = lambda c: F.concat(F.col(c), F.lit("-"), F.col("c_custkey").cast("string")).alias(c)


def _sessions(spark, sf_dir, rows: L.Table) -> DataFrame:
    """The rows of a small list, as sessions of each customer."""
    held = _copies(spark, sf_dir, rows)
    return held.select(_TWIN("session_id"), *[c for c, _ in rows.columns if c != "session_id"])


def _policy(spark, sf_dir) -> DataFrame:
    return agent.check_policy(*[_sessions(spark, sf_dir, rows) for rows in (L.ACTIONS, L.POLICY_NODES, L.POLICY_TOKENS)])


_REASONS = f"(SELECT session_id || '-' || c_custkey AS session_id, step, idx, reason FROM {_each(L.POLICY_REASONS)})"


@query(f"SELECT session_id, step, idx, reason FROM {_REASONS}")
def policy_check(spark, sf_dir):
    return _policy(spark, sf_dir).select("session_id", "step", "idx", "reason")


@query(f"WITH r AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN idx END) OVER (PARTITION BY session_id, step) AS f FROM {_REASONS}) SELECT session_id, step, idx, CASE WHEN f IS NULL OR idx < f THEN 'run' WHEN idx = f THEN 'blocked' ELSE 'not_run' END AS result FROM r")
def policy_prefix(spark, sf_dir):
    return agent.until_blocked(_policy(spark, sf_dir)).select("session_id", "step", "idx", "result")


@query("SELECT event_id AS step, CASE WHEN event_id % 4 IN (0, 1) THEN 't' || event_id WHEN event_id % 4 = 2 THEN 'again' END AS thought, CASE WHEN event_id % 4 = 3 THEN 'backend_invalid_response' END AS reason FROM events")
def response_retry(spark, sf_dir):
    """Two answers of a model a step: the first that is valid counts, a third is never asked for."""
    k = F.col("event_id")
    good = F.concat(F.lit('Sure: {"thought":"t'), k.cast("string"), F.lit('","actions":[{"type":"click","node_id":"n1"}],"done":false} ok'))
    first = F.when(k % 4 < 2, good).when(k % 4 == 2, '{"thought":"t"}').otherwise("no json")
    second = F.when(k % 4 == 3, '{"thought":"t","actions":[{"type":"wait","ms":4000}],"done":false}').otherwise('{"thought":"again","actions":[],"done":true}')
    answer = lambda n, a: F.struct(F.lit(n).alias("attempt"), a.alias("answer"))
    rows = table(spark, sf_dir, "events").select(F.lit("s").alias("session_id"), k.alias("step"), F.inline(F.array(answer(1, first), answer(2, second), answer(3, F.lit('{"thought":"late","actions":[],"done":true}')))))
    return agent.first_valid(rows).select("step", "response.thought", "reason")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a":' || event_id || ',"b":"}{"}' WHEN event_id % 3 = 1 THEN props END AS object FROM events""")
def first_object(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.lit('See {"a":'), k.cast("string"), F.lit(',"b":"}{"} and {"c":1}'))).when(k % 3 == 1, F.concat("event_type", F.lit(" "), "props", F.lit(" end"))).otherwise(F.concat(F.lit("{bad} "), "props"))
    return table(spark, sf_dir, "events").select("event_id", agent.first_json_object(text).alias("object"))


@query("""
WITH i AS (SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL), l AS (SELECT user_id, event_type, max(event_id) AS node FROM i GROUP BY ALL)
SELECT user_id, event_type AS img_id, node FROM l
""")
def image_index(spark, sf_dir):
    """Images of each user's observation by node, read back from the wire; of equal ones the last counts."""
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: F.struct(e["event_type"].alias("img_id"), e["event_id"].alias("node"))).alias("images"))
    wire = agent.to_wire(rows.withColumn("status", F.lit("ok")), by=["user_id"])
    index = F.from_json(F.get_json_object("json", "$.image_index"), "map<string,bigint>")
    return wire.select("user_id", F.explode(index).alias("img_id", "node"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, (pos - 1) // 2 + 1 AS step FROM r), e AS (SELECT user_id, min(step) FILTER (event_type = 'error') AS stop FROM s GROUP BY user_id)
SELECT s.user_id, step, count(*)::INTEGER AS n FROM s JOIN e USING (user_id) WHERE step <= least(coalesce(stop, 10), 10) GROUP BY s.user_id, step
""")
def session_history(spark, sf_dir):
    """Two events of a user are a step; an error says that the session is done."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    steps = e.select(F.col("user_id").alias("session_id"), (F.floor(F.col("at") / 2) + 1).alias("step"), (F.col("at") % 2).alias("idx"), F.col("event_type").alias("type"), F.lit("ok").alias("result"), (F.col("event_type") == "error").alias("done"))
    return agent.history(steps).select(F.col("session_id").alias("user_id"), "step", F.size("actions").alias("n"))


@query(f"SELECT c_custkey, unit, out AS text FROM {_each(L.LINKS)} WHERE session_id = 's'")
def link_tokens(spark, sf_dir):
    """Links and texts of a session of each customer share tokens; values that a link has shown are masked in later texts."""
    rows = _copies(spark, sf_dir, L.LINKS).where("session_id = 's'")
    units = rows.select(F.col("c_custkey").cast("string").alias("session_id"), *[c for c, _ in L.LINKS.columns if c not in ("session_id", "out")])
    return T.sanitize(units)[0].select(F.col("session_id").cast("long").alias("c_custkey"), "unit", "text")


# --- Metrics ---


@query("""SELECT '"s,' || event_id || '",' || (event_id % 4) || ',' || event_type || ',,,,,' || CASE WHEN event_id % 2 = 0 THEN '"a ""quoted"" word"' ELSE '' END || ',,,,' AS line FROM events""")
def log_csv(spark, sf_dir):
    k = F.col("event_id")
    named = {"session_id": F.concat(F.lit("s,"), k.cast("string")), "step": k % 4, "op": F.col("event_type"), "reason": F.when(k % 2 == 0, 'a "quoted" word')}
    return csv_lines(table(spark, sf_dir, "events").select(*[named.get(c, F.lit(None).cast("string")).alias(c) for c in metrics.CSV_COLUMNS]))


@query("""
WITH t AS (SELECT user_id, event_id, 20 + 10 * (event_id % 3) AS size, event_id % 5 AS off, event_id % 4 <> 0 AS seen FROM events WHERE user_id IS NOT NULL),
m AS (SELECT size, seen AND (size - off)::DOUBLE * (size - off) / (2.0 * size * size - (size - off) * (size - off)) >= 0.2 AS hit FROM t)
SELECT size::BIGINT AS size, count(*)::BIGINT AS n, count_if(hit)::BIGINT AS found, count_if(hit) / count(*)::DOUBLE AS recall FROM m GROUP BY size
""")
def recall_by_size(spark, sf_dir):
    """True boxes, one an event, and detections moved a little, three of four: an image is a user's, boxes lie apart."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    size, off = (20 + 10 * (F.col("event_id") % 3)).cast("double"), (F.col("event_id") % 5).cast("double")
    x, y = (F.col("event_id") % 100 * 200).cast("double"), (F.floor(F.col("event_id") / 100) * 200).cast("double")
    truth = e.select(F.col("user_id").alias("img_id"), F.col("event_id").alias("truth_id"), size.cast("long").alias("size"), x.alias("x"), y.alias("y"), size.alias("w"), size.alias("h"))
    found = e.where("event_id % 4 <> 0").select(F.col("user_id").alias("img_id"), F.col("event_id").alias("det_id"), (x + off).alias("x"), (y + off).alias("y"), size.alias("w"), size.alias("h"))
    return metrics.recall_by_size(metrics.match_boxes(truth, found))
