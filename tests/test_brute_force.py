"""The queries without SQL against plain Python over the same tables."""

import json
from collections import Counter

import pytest
import regex

from mistveil.functions.email import FREE_MAIL, PUBLIC_FROM, ROLE_NAMES
from mistveil.functions.patterns import PAN_HOLDERS, PATTERNS, PLACEHOLDER
from mistveil.operators import html as W
from mistveil.operators.windows import OVERLAP, WINDOW_CHARS
from mistveil.plans import queries
from test_trees_and_order import pruned



def digits(text):
    return regex.sub(r"[^0-9]", "", text)


def luhn(text):
    d = [int(c) for c in reversed(digits(text))]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def verhoeff(text):
    """The dihedral group of ten: a rotation below 5, a reflection from 5 on."""
    times = lambda a, b: (a + b) % 5 + 5 * (b > 4) if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5
    turn, total = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], 0
    for i, c in enumerate(reversed(digits(text))):
        x = int(c)
        for _ in range(i % 8):
            x = turn[x]
        total = times(total, x)
    return total == 0


CHECKS = {"luhn": luhn, "aadhaar": lambda t: digits(t)[0] not in "01" and verhoeff(t), "pan": lambda t: t[3] in PAN_HOLDERS, None: lambda t: True}


def spans(text):
    """Hits of all patterns, earlier ones first, none over another; those with a wrong checksum claim nothing."""
    kept = []
    for kind, pattern, check in PATTERNS:
        for m in regex.finditer(pattern, text):
            if CHECKS[check](m.group()) and not any(m.start() < e and s < m.end() for s, e, _ in kept):
                kept.append((m.start(), m.end(), kind))
    return sorted(kept)


def public(email, host):
    name, _, domain = email.rpartition("@")
    score = 3 * (name.lower() in ROLE_NAMES) + 3 * bool(host and (domain.lower() == host or domain.lower().endswith("." + host))) - 4 * (domain.lower() in FREE_MAIL)
    return score >= PUBLIC_FROM


def test_checks():
    assert {c for _, _, c in PATTERNS} <= set(CHECKS)
    assert CHECKS["aadhaar"]("2345 6789 0124") and not CHECKS["aadhaar"]("2345 6789 0125") and CHECKS["luhn"]("4111 1111 1111 1111")


@pytest.fixture(scope="module")
def documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    out = {}
    for r in rows:
        text = r.text or ""
        held = [(s, e, k) for s, e, k in spans(text) if k != "EMAIL" or not public(text[s:e], f"{r.source}.example".lower())]
        numbers, names, parts, at = Counter(), {}, [], 0
        for s, e, k in held:
            key = (k, text[s:e].strip().lower())
            if key not in names:
                numbers[k] += 1
                names[key] = f"[PII_{k}_{numbers[k]}]"
            parts += [text[at:s], names[key]]
            at = e
        out[r.doc_id] = ("".join(parts) + text[at:], len(held), numbers)
    assert len(out) == len(rows)  # ids do not repeat here
    return out


def test_sanitize_documents(spark, folder, documents):
    got = {r.doc_id: (r.text, r.n_spans) for r in queries.QUERIES["sanitize_documents"](spark, folder).collect()}
    assert got == {i: v[:2] for i, v in documents.items()} and sum(v[1] for v in documents.values()) > 5


def test_token_map_documents(spark, folder, documents):
    got = {(r.doc_id, r.type): (r.n, r.last_token) for r in queries.QUERIES["token_map_documents"](spark, folder).collect()}
    want = {(i, k): (n, max(f"[PII_{k}_{j}]" for j in range(1, n + 1))) for i, v in documents.items() for k, n in v[2].items()}
    assert got == want


def windows(text):
    return [text] if len(text) <= WINDOW_CHARS else [text[s : s + WINDOW_CHARS] for s in range(0, max(1, len(text) - OVERLAP), WINDOW_CHARS - OVERLAP)]


@pytest.fixture(scope="module")
def pages(spark, folder):
    """Nodes of each page, and its units (node, field, text) in order."""
    out = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        nodes, units = W.parse_page(r.url, r.html), []
        for n in nodes:
            for field in n["fields"]:
                value = n["name"] if field == "accessible_name" else n[field]
                if field in ("href", "src") and value and value.startswith(("data:", "blob:")):
                    value = "[inline-data]"
                for text in windows(value) if field == "text" else [value]:
                    if text:
                        units.append((n["node"], field, text))
        out[r.page_id] = nodes, units
    return out


def test_page_units(spark, folder, pages):
    got = {(r.page_id, r.unit): (r.node, r.field, r.chars, r.n_spans) for r in queries.QUERIES["page_units"](spark, folder).collect()}
    assert got == {(p, i): (n, f, len(t), len(spans(t))) for p, (_, units) in pages.items() for i, (n, f, t) in enumerate(units)}


def test_prune_pages(spark, folder, pages):
    want = {}
    for page, (nodes, units) in pages.items():
        by = {n["node"]: n for n in nodes}
        far = lambda n: max(n - 40, 0)
        first = {}
        for i, (n, f, _) in enumerate(units):
            first.setdefault((n, f), i)
        tier = lambda n: 3 if not by[n]["visible"] else 2 if far(n) > 0 else 0 if by[n]["inside_interactive"] else 1  # noqa: B023, E731
        fields = sorted({(n, f) for n, f, _ in units}, key=lambda x: (tier(x[0]), far(x[0]) if tier(x[0]) >= 2 else 0, not by[x[0]]["inside_interactive"], first[x], x[0], x[1]))  # noqa: B023
        chosen, chars, n_units = set(), 0, 0
        for n, f in fields:
            mine = [t for a, b, t in units if (a, b) == (n, f)]
            chars, n_units = chars + sum(map(len, mine)), n_units + len(mine)
            chosen.add((n, chars <= 2000 and n_units <= 100))
        rows = [(page, n["node"], n["parent"], n["last"], n["marker"], n["image"], None, n["interactive"], n["node"] < 40, n["secret"]) for n in nodes]
        kept = pruned(rows, chosen)
        if kept:
            want[page] = (len(kept), sum(kept.values()))
    got = {r.page_id: (r.n, r.n_trimmed) for r in queries.QUERIES["prune_pages"](spark, folder).collect()}
    assert got == want and any(t for _, t in want.values())


def test_observation_json(spark, folder, pages):
    """Nodes and their content, sanitized, as they go on the wire; blocked pages are not there."""
    seen = 0
    for r in queries.QUERIES["observation_json"](spark, folder).collect():
        body, (nodes, units) = json.loads(r.json), pages[r.page_id]
        assert [n["node"] for n in body["dom"]] == [n["node"] for n in nodes] and body["schema_version"] == "1"
        for shown, node in zip(body["dom"], nodes, strict=True):
            content = json.loads(shown["content"])
            assert shown["tag"] == node["tag"] and set(content) == {f for n, f, _ in units if n == node["node"]}
            for field, text in content.items():
                given = "".join(t if i == 0 else t[OVERLAP:] for i, t in enumerate(t for n, f, t in units if (n, f) == (node["node"], field)))
                if field == "text":
                    assert not [s for s in spans(text) if s[2] != "EMAIL"]
                    if not spans(given) and not regex.search(PLACEHOLDER, text):
                        assert text == given
                        seen += 1
    assert seen > 100


def test_landmarks_hold_interactive_nodes_only(pages):
    for nodes, _ in pages.values():
        assert not [n for n in nodes if n["in_landmark"] and not n["interactive"] and not n["inside_interactive"]]


def test_nothing_is_left_after_sanitizing(spark, folder, documents):
    left = queries.QUERIES["residual_after_sanitize"](spark, folder).collect()
    assert {r.kind: r.n for r in left if r.kind != "EMAIL_LIKELY_PUBLIC"} == {} or all(spans(v[0]) == [] for v in documents.values())
