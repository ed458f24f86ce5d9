"""Patterns of identifiers, in the order in which they claim text."""

from __future__ import annotations

#: JavaScript's white space as a character class body; Java's \s is narrower.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_SEP = rf"[{JS_SPACE}\-]?"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![A-Za-z0-9_.+\-])", r"(?![A-Za-z0-9_.\-])"
_ALONE_BEFORE, _ALONE_AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_LOCAL = r"[A-Za-z0-9_.+\-]+"

#: Fixed values: (type, pattern, checksum or None).
PATTERNS = (
    ("UPI", rf"{_NO_WORD_BEFORE}{_LOCAL}@[a-zA-Z]{{2,64}}{_NO_WORD_AFTER}", None),
    ("EMAIL", rf"{_NO_WORD_BEFORE}{_LOCAL}@[a-zA-Z0-9\-]+(?:\.[a-zA-Z0-9\-]+)+{_NO_WORD_AFTER}", None),
    ("AADHAAR", rf"{_ALONE_BEFORE}[Xx]{{4}}{_SEP}[Xx]{{4}}{_SEP}[0-9]{{4}}(?![0-9])", None),
    ("AADHAAR", rf"(?<![0-9])[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}}(?![0-9])", "aadhaar"),
    ("CARD", rf"(?<![0-9])(?:[0-9]{_SEP}){{13,19}}(?<=[0-9])(?![0-9])", "luhn"),
    ("PAN", rf"{_ALONE_BEFORE}[A-Z]{{5}}[0-9]{{4}}[A-Z]{_ALONE_AFTER}", "pan"),
    ("IFSC", rf"{_ALONE_BEFORE}[A-Z]{{4}}0[A-Z0-9]{{6}}{_ALONE_AFTER}", None),
    ("GSTIN", rf"{_ALONE_BEFORE}[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]{_ALONE_AFTER}", None),
    ("VOTER_ID", rf"{_ALONE_BEFORE}[A-Z]{{3}}[0-9]{{7}}{_ALONE_AFTER}", None),
    ("PASSPORT", rf"{_ALONE_BEFORE}[A-PR-WY][1-9][0-9]{{6}}{_ALONE_AFTER}", None),
    ("VEHICLE_REG", rf"{_ALONE_BEFORE}[A-Z]{{2}}[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{4}}{_ALONE_AFTER}", None),
    ("PHONE", r"(?<![0-9])(?:\+91" + _SEP + r"|0)?[6-9][0-9]{4}" + _SEP + r"[0-9]{5}(?![0-9])", None),
    ("PHONE", r"(?<![0-9])\+[1-9][0-9]{7,14}(?![0-9])", None),
)

#: Any text with a hit of one of the patterns matches this, so one scan tells most texts that have none.
MAYBE_DIGITS = rf"[0-9]{{4}}|(?:[0-9]{_SEP}){{13}}|[A-Z]{{4}}0"
MAYBE = rf"@|{MAYBE_DIGITS}"

#: The types, first among the patterns, whose hits hold an at sign; hits of all others match MAYBE_DIGITS.
WITH_AT = ("UPI", "EMAIL")

#: All types of personal data, of patterns and of taggers.
PII_TYPES = ("NAME", "ADDRESS", "DOB", "EMAIL", "PHONE", "CARD", "AADHAAR", "PAN", "PASSPORT", "UPI", "IFSC", "VOTER_ID", "GSTIN", "VEHICLE_REG", "OTHER")

#: Codes that the fourth letter of a PAN may be.
PAN_HOLDERS = "ABCFGHJLPT"

TOKEN = r"\[PII_[A-Z_]+_[0-9]+\]"
PLACEHOLDER = rf"{TOKEN}|\[SECRET\]"
