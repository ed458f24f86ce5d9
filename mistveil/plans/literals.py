"""Small fixed tables for queries, as DataFrames and as SQL. All values are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


class Table:
    """Rows with a flat schema such as "id bigint, name string"."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [tuple(c.split()) for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A SELECT that DuckDB reads."""

        def cell(v) -> str:
            return "NULL" if v is None else repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"

        names = ", ".join(n for n, _ in self.columns)
        rows = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"{n}::{_DUCK[t]} AS {n}" for n, t in self.columns)
        return f"(SELECT {casts} FROM (VALUES {rows}) AS t({names}))"


CANARIES = Table(
    "id bigint, kind string, value string, found boolean",
    [
        (-1, "EMAIL", "priya.sharma.canary@example.com", True),
        (-2, "EMAIL", "support@example.com", True),
        (-3, "UPI", "priya.sharma@okaxis", True),
        (-4, "PHONE", "+91 98765 43210", True),
        (-5, "AADHAAR", "2345 6789 0124", True),
        (-6, "AADHAAR", "2345 6789 0125", False),
        (-7, "AADHAAR", "XXXX XXXX 1234", True),
        (-8, "PAN", "ABCPE1234F", True),
        (-9, "CARD", "4111 1111 1111 1111", True),
        (-10, "CARD", "4111 1111 1111 1112", False),
        (-11, "IFSC", "HDFC0001234", True),
        (-12, "PASSPORT", "K1234567", True),
        (-13, "VOTER_ID", "ABC1234567", True),
        (-14, "GSTIN", "27ABCPE1234F1Z5", True),
        (-15, "VEHICLE_REG", "DL01AB1234", True),
        (-16, "PHONE", "+14155550123", True),
        (-17, "DOB", "14/08/1990", False),
        (-18, "NAME", "Priya Sharma Canary", False),
        (-19, "OTHER", "Sup3rSecretCanary!", False),
    ],
)

#: Texts whose hits overlap, and the spans that win.
OVERLAPS = Table(
    "id bigint, text string",
    [
        (1, "pay a.b@okbank or a.b@okbank.com"),
        (2, "2345 6789 0124 3210"),
        (3, "27ABCPE1234F1Z5 ABCPE1234F"),
        (4, "no 9876543210 and +919876543210"),
        (5, "K1234567, ABC1234567; DL01AB1234."),
        (6, None),
        (7, "4111-1111-1111-1111 4111111111111112"),
        (8, "xABCPE1234F ABCPE1234Fx ABCDE1234F"),
    ],
)
CLAIMED = Table(
    "id bigint, type string, start int, end_ int",
    [
        (1, "UPI", 4, 14), (1, "EMAIL", 18, 32), (2, "AADHAAR", 0, 14), (3, "GSTIN", 0, 15), (3, "PAN", 16, 26), (4, "PHONE", 3, 13), (4, "PHONE", 18, 31),
        (5, "PASSPORT", 0, 8), (5, "VOTER_ID", 10, 20), (5, "VEHICLE_REG", 22, 32), (7, "CARD", 0, 19),
    ],
)

DIGITS = Table("id bigint, digits string", [(1, "4111111111111111"), (2, "4111111111111112"), (3, "0"), (4, "234567890124"), (5, "234567890125"), (6, ""), (7, "5500005555555559"), (8, "12345678901234567890"), (9, "4222222222222"), (10, "41111111x1111111")])

EMAILS = Table(
    "id bigint, email string, origin string, in_landmark boolean, near_contact_heading boolean, in_contact_markup boolean, in_ugc_block boolean, is_mailto boolean",
    [
        (1, "support@example.com", "https://example.com", False, False, False, False, False),
        (2, "support@gmail.com", "https://example.com", False, True, False, False, False),
        (3, "a.person@shop.example.com", "https://example.com", True, False, False, False, True),
        (4, "info@example.com", "https://shop.example.com", False, False, True, False, None),
        (5, "hr@EXAMPLE.com", "https://example.com", None, None, None, True, False),
        (6, "plain", "https://example.com", True, True, True, False, True),
        (7, "careers@proton.me", "not a url", False, True, False, False, False),
        (8, "ram@example.com", "https://example.com", True, False, False, False, False),
    ],
)

HOSTS = Table(
    "id bigint, url string, private boolean",
    [
        (1, "http://10.1.2.3/x", True), (2, "https://example.com/a", False), (3, "http://localhost:8080", True), (4, "http://172.20.0.1", True), (5, "http://172.32.0.1", False),
        (6, "http://192.168.1.1/", True), (7, "http://169.254.169.254/latest", True), (8, "http://100.64.0.1", True), (9, "http://100.128.0.1", False), (10, "data:image/png;base64,AA", False),
        (11, "nonsense", True), (12, "http://printer.local/", True), (13, "http://intra", True), (14, "http://[::1]/", True), (15, "http://[fd00::1]/", True), (16, "http://[fe80::1]/", True),
        (17, "http://[2001:db8::1]/", False), (18, "http://[::ffff:a00:1]/", True), (19, "https://box.home.arpa.", True), (20, None, True), (21, "http://8.8.8.8/", False), (22, "https://notlocal.com", False),
    ],
)

ENDPOINTS = Table(
    "id bigint, raw string, endpoint string",
    [
        (1, "https://api.example.com/v1/", "https://api.example.com/v1"), (2, "http://localhost:3000//", "http://localhost:3000"), (3, "http://api.example.com", None), (4, "https://u:p@api.example.com", None),
        (5, "https://api.example.com/?q=1", None), (6, " https://api.example.com#x", None), (7, "http://127.0.0.1", "http://127.0.0.1"), (8, "https://API.example.com:443/x", "https://api.example.com/x"), (9, "ftp://x", None),
    ],
)

GPUS = Table(
    "id bigint, vendor string, architecture string, type string, fallback boolean, kind string, usable boolean",
    [
        (1, "nvidia", "ampere", None, False, "discrete", True), (2, "intel", "gen-12hp", None, None, "discrete", True), (3, "intel", "gen-9", None, None, "integrated", False), (4, "apple", "m1", None, None, "integrated", True),
        (5, "google", "swiftshader", None, None, "software", False), (6, "amd", "rdna", None, None, "unknown", False), (7, "amd", None, "discrete GPU", None, "discrete", True), (8, "nvidia", None, None, True, "software", False), (9, None, None, "CPU", None, "software", False),
    ],
)

CLASSES = Table(
    "id bigint, class string, flags string",
    [(1, "btn is-invalid Active", "error,active"), (2, "d-none", "hidden"), (3, "disabled-link interactive", "disabled"), (4, None, ""), (5, "current hidden selected", "active,hidden"), (6, "unhidden x", "")],
)

BOXES = Table(
    "id bigint, x double, y double, w double, h double, iw int, ih int",
    [(1, 10.0, 10.0, 20.0, 30.0, 100, 100), (2, 95.0, 95.0, 20.0, 20.0, 100, 100), (3, 120.0, 0.0, 10.0, 10.0, 100, 100), (4, 5.0, 5.0, 0.0, 10.0, 100, 100), (5, 1.0, 2.0, 1000.0, 3.0, 640, 480), (6, 0.25, 0.5, 3.5, 3.5, 50, 60)],
)

DETECTIONS = Table(
    "img bigint, score double, x double, y double, w double, h double",
    [(1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 0.7, 20.0, 20.0, 5.0, 5.0), (2, 0.5, 0.0, 0.0, 4.0, 4.0), (2, 0.6, 3.0, 3.0, 4.0, 4.0), (2, 0.4, 0.0, 0.0, 4.0, 3.9)],
)

CACHE = Table(
    "id bigint, validated_at double, acquired_via string, etag string, last_modified string, decision string",
    [
        (1, 10_000_000.0, "fetch", "e", None, "fresh"), (2, 8_200_000.0, "fetch", None, None, "fresh"), (3, 8_199_999.0, "fetch", "e", None, "conditional"), (4, 1.0, "fetch", None, "m", "conditional"), (5, 1.0, "fetch", None, None, "rehash"),
        (6, 1.0, "pixels", "e", "m", "rehash"), (7, None, None, None, None, "miss"),
    ],
)

NODES = Table(
    "page_id bigint, node int, parent int, tag string, role string, field string, text string, y int, h int, visible boolean, inside_interactive boolean",
    [
        (1, 0, None, "a", None, "text", "near link", 10, 20, True, True), (1, 1, None, "p", None, "text", "near words of some length", 50, 20, True, False), (1, 2, None, "p", None, "text", "far words", 900, 20, True, False),
        (1, 3, None, "a", None, "text", "far link", 900, 20, True, True), (1, 4, None, "p", None, "text", "further", 2000, 20, True, False), (1, 5, None, "p", None, "text", "hidden", 10, 20, False, False),
        (1, 6, None, "p", None, "text", "above", -300, 20, True, False), (2, 0, None, "p", None, "text", "all of it", 0, 10, True, False),
    ],
)

ACTIONS = Table(
    "session_id string, step int, idx int, page_origin string, type string, node_id string, text string, value string, url string",
    [
        ("s", 1, 0, "https://a.example", "click", "n1", None, None, None), ("s", 1, 1, "https://a.example", "type", "n1", "hi [PII_NAME_1]", None, None), ("s", 1, 2, "https://a.example", "type", "n2", "hi", None, None),
        ("s", 2, 0, "https://a.example", "navigate", None, None, None, "https://x.example/?q=[PII_NAME_1]"), ("s", 2, 1, "https://a.example", "navigate", None, None, None, "javascript:alert(1)"), ("s", 2, 2, "https://a.example", "navigate", None, None, None, "/next"),
        ("s", 3, 0, "https://a.example", "type", "n1", "[PII_EMAIL_9]", None, None), ("s", 3, 1, "https://a.example", "type", "n1", "[PII_EMAIL_1]", None, None), ("s", 3, 2, "https://a.example", "type", "n3", "x", None, None),
        ("s", 4, 0, "https://a.example", "select", "n4", None, "[PII_NAME_1]", None), ("s", 4, 1, "https://a.example", "select", "n9", None, "x", None), ("s", 4, 2, "https://a.example", "type", "n5", "x", None, None), ("s", 5, 0, "https://a.example", "wait", None, None, None, None),
    ],
)
POLICY_NODES = Table(
    "session_id string, step int, node_id string, tag string, role string, secret boolean, form_origin string",
    [(s, st, n, t, r, x, f) for st in range(1, 6) for s, n, t, r, x, f in (("s", "n1", "input", "textbox", None, None), ("s", "n2", "a", "link", False, None), ("s", "n3", "input", "textbox", True, None), ("s", "n4", "select", None, None, "https://a.example"), ("s", "n5", "div", "textbox", None, "https://evil.example"))],
)
POLICY_TOKENS = Table("session_id string, token string, origin string, value string", [("s", "[PII_NAME_1]", "https://a.example", "Priya"), ("s", "[PII_EMAIL_1]", "https://b.example", "p@b.example")])
POLICY_REASONS = Table(
    "session_id string, step int, idx int, reason string",
    [
        ("s", 1, 0, None), ("s", 1, 1, None), ("s", 1, 2, "policy_target"), ("s", 2, 0, "policy_url_token"), ("s", 2, 1, "policy_url_token"), ("s", 2, 2, None), ("s", 3, 0, "policy_unknown_token"), ("s", 3, 1, "policy_cross_origin"), ("s", 3, 2, "policy_target"),
        ("s", 4, 0, None), ("s", 4, 1, "policy_target"), ("s", 4, 2, "policy_form_origin"), ("s", 5, 0, None),
    ],
)

URLS = Table(
    "id bigint, url string, clean string",
    [
        (1, "https://user:pw@Example.com:443/a/b?token=abc&page=2#top", "https://example.com/a/b?token=%5BPII_OTHER%5D&page=2#top"),
        (2, "/p/a%40b.example?id=123456789&id=5", "/p/%5BPII_EMAIL%5D?id=5"),
        (3, "https://x.example/?email=&q=a@b.example", "https://x.example/?email=&q=%5BPII_EMAIL%5D"),
        (4, "https://x.example/a b#aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "https://x.example/a%20b"),
        (5, "mailto:a@b.example", "mailto://%5BPII_EMAIL%5D"),
        (6, "page.html?x=1+2", "/page.html?x=1+2"),
        (7, "https://x.example/%zz?token=abc", None),
        (8, "https://x.example/it's(ok)!", "https://x.example/it's(ok)!"),
        (9, "/%zz/a@b.example", "/%zz/[PII_EMAIL]"),
    ],
)

LOG_FIELDS = Table("id bigint, session_id string, step int, op string, reason string", [(1, "a,b", 1, "x", None), (2, 'q"q', None, "y", "l1\nl2"), (3, "plain", 3, "z", "ok")])

BIO = Table(
    "text_id bigint, idx int, entity string, score double, start int, end_ int",
    [(1, 0, "B-PERSON", 0.5, 0, 5), (1, 1, "I-PERSON", 1.0, 6, 12), (1, 2, "O", 0.9, 13, 15), (1, 3, "I-PERSON", 0.75, 16, 20), (1, 4, "B-PERSON", 0.25, 21, 25), (1, 5, "I-LOCATION", 0.5, 26, 30), (2, 0, "S-AGE", 0.5, 0, 2), (2, 1, "I-AGE", 0.5, 3, 4)],
)
BIO_GROUPS = Table(
    "text_id bigint, label string, start int, end_ int, score double",
    [(1, "PERSON", 0, 12, 0.75), (1, "PERSON", 16, 20, 0.75), (1, "PERSON", 21, 25, 0.25), (1, "LOCATION", 26, 30, 0.5), (2, "AGE", 0, 2, 0.5), (2, "AGE", 3, 4, 0.5)],
)
TEXTS_WITH_TOKENS = Table("session_id string, id bigint, text string", [("s", 1, "to [PII_NAME_1], from [PII_NAME_2]: [PII_NAME_1]"), ("s", 2, "nothing"), ("t", 3, "[PII_NAME_1]"), ("s", 4, "[SECRET] [PII_EMAIL_1] [SECRET]")])
RESOLVED = Table("session_id string, id bigint, text string", [("s", 1, "to Priya, from [PII_NAME_2]: Priya"), ("s", 2, "nothing"), ("t", 3, "[PII_NAME_1]"), ("s", 4, "[SECRET] p@b.example [SECRET]")])

#: What a model may answer, and the first balanced object in it if that is JSON.
ANSWERS = Table(
    "id bigint, answer string, object string",
    [
        (1, 'Sure: {"a":1} and {"b":2}', '{"a":1}'), (2, '{bad} {"a":1}', None), (3, '{x: {"a":1}}', None), (4, '{"a":"}{"} tail', '{"a":"}{"}'), (5, '{"a":"\\"}"} x', '{"a":"\\"}"}'),
        (6, "none", None), (7, '{"a":{"b":1}', None), (8, None, None), (9, '} {"a":{"b":[]}} {', '{"a":{"b":[]}}'),
    ],
)

#: Results of sessions' steps, and the steps that stay: up to the limit of ten and the first one that is done.
STEPS = Table(
    "session_id string, step int, idx int, type string, result string, done boolean, kept boolean",
    [("a", 1, 0, "click", "ok", None, True), ("a", 2, 0, "wait", "ok", True, True), ("a", 3, 0, "click", "ok", None, False)] + [("b", k, 0, "wait", "ok", False, k <= 10) for k in range(8, 13)] + [("b", 8, 1, "click", "failed", False, True)],
)

LINKS = Table(
    "session_id string, origin string, unit bigint, field string, text string, out string",
    [
        ("s", "https://a.example", 0, "text", "mail p@q.example now", "mail [PII_EMAIL_1] now"),
        ("s", "https://a.example", 1, "href", "https://a.example/u/p@q.example/x?token=secret&n=1#top", "https://a.example/u/%5BPII_EMAIL_1%5D/x?token=%5BPII_OTHER_1%5D&n=1#top"),
        ("s", "https://a.example", 2, "src", "/img?session=secret&v=a+b", "/img?session=%5BPII_OTHER_1%5D&v=a+b"),
        ("s", "https://a.example", 3, "href", "https://a.example/bad%zz/p@q.example?token=other", None),
        ("s", "https://a.example", 4, "href", "mailto:p@q.example", "mailto://%5BPII_EMAIL_1%5D"),
        ("s", "https://a.example", 5, "href", None, None),
        ("s", "https://a.example", 6, "text", "the SECRET is secret, secrets are not", "the [PII_OTHER_1] is [PII_OTHER_1], secrets are not"),
        ("s", "https://b.example", 7, "text", "secret of another origin", "secret of another origin"),
        ("s", "https://a.example", 8, "href", "/bad%zz/p@q.example", "/bad%zz/[PII_EMAIL_1]"),
        ("s", "https://a.example", 9, "href", "https://a.example/secret/x", "https://a.example/%5BPII_OTHER_1%5D/x"),
        ("t", "https://a.example", 0, "href", "/?id=123456789&id2=7&key=", "/?id=%5BPII_OTHER_1%5D&id2=7&key="),
    ],
)

READ_WORDS = Table(
    "id bigint, word bigint, line bigint, text string, confidence string, x bigint, out string",
    [(1, 0, 0, "call", "high", 0, None), (2, 1, 0, "98765", "high", 1, "1,0"), (3, 2, 0, "43210", "high", 2, "2,0"), (4, 3, 1, "  ", "low", 0, None), (5, 4, 1, "a@b", "low", 1, "1,1"), (6, 5, 1, "1l2o34", "low", 2, "2,1"), (7, 6, 1, "12l34", "high", 3, None), (8, 7, 2, "p@q.example,", "medium", 0, "0,2")],
)

IMAGE_STATES = Table(
    "id bigint, inline boolean, readback boolean, version string, decision string, usable boolean, fetched boolean, not_modified boolean, same boolean, stages string, decoded boolean, hashed boolean, looked string, processed string",
    [
        (1, True, True, "v", "fresh", True, None, None, True, "ok", True, True, "need_pixels", "ok"),
        (2, False, False, "v", "fresh", True, None, None, True, "ok", True, True, "need_pixels", "unreadable"),
        (3, False, True, "v", "fresh", True, None, None, None, None, True, True, "ok", "detector_failed"),
        (4, False, True, "v", "fresh", False, None, None, True, "ok", False, None, "need_pixels", "unreadable"),
        (5, False, True, "v", "rehash", True, None, None, True, None, True, True, "need_pixels", "ok"),
        (6, False, True, "v", "conditional", True, True, True, None, None, True, False, "ok", "unreadable"),
        (7, False, True, "v", "conditional", True, True, False, True, None, True, True, "ok", "ok"),
        (8, False, True, "v", "conditional", True, True, False, False, "detector_failed", True, True, "detector_failed", "detector_failed"),
        (9, False, True, "v", "conditional", True, None, None, None, "ok", True, True, "need_pixels", "ok"),
        (10, False, True, None, "fresh", True, None, None, True, None, True, True, "need_pixels", "detector_failed"),
        (11, False, True, "v", "miss", None, None, None, None, "encode_failed", True, True, "need_pixels", "encode_failed"),
        (12, True, True, "v", None, None, None, None, True, None, True, True, "need_pixels", "detector_failed"),
    ],
)
