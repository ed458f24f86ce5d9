"""URLs without personal data: the parts are split, cleaned and joined again as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let, pattern_spans

#: Fixed values.
SENSITIVE_KEYS = ("token", "auth", "session", "sid", "key", "code", "email", "phone", "user", "uid")
LONG_ID, LONGEST_ANCHOR = 8, 24

_SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_RELATIVE = r"^()()([^?#]*)(\?[^#]*)?(#.*)?$"


def split_url(raw: Column) -> Column:
    """scheme, host (without user), path, query (with ?), fragment (with #); scheme and host are empty for relative URLs."""

    def of(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i - 1))
        scheme, host = F.lower(part(1)), F.lower(F.regexp_replace(part(2), "^.*@", ""))
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        path = part(3)
        rooted = F.when((scheme.isin("http", "https", "")) & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
        return F.struct(scheme.alias("scheme"), host.alias("host"), rooted.alias("path"), part(4).alias("query"), part(5).alias("fragment"))

    read = lambda shape: F.array(*[F.regexp_extract(raw, shape, i) for i in range(1, 6)])
    return let(F.when(raw.rlike(_SHAPE), read(_SHAPE)).otherwise(read(_RELATIVE)), of)


def encode_component(text: Column) -> Column:
    """Percent encoding that leaves letters, digits and - _ . ! ~ * ' ( ) alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def is_sensitive(key: Column, value: Column) -> Column:
    """Query keys whose value goes whatever it is; "id" only if the value is long."""
    name = F.lower(key)
    return name.isin(*SENSITIVE_KEYS) | ((name == "id") & (F.length(value) > LONG_ID))


def decode(text: Column) -> Column:
    """Percent decoding where + stays; null if malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _segments(path: Column) -> Column:
    """Decoded path segments; a null one is malformed."""
    return F.transform(F.split(path, "/", -1), lambda s: F.when(s == "", s).otherwise(decode(s)))


def _values(query: Column) -> Column:
    """(k, v) of a query: of repeated keys the last value, at the first place."""
    pairs = F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&", -1), lambda p: p != "")
    form = lambda t: F.coalesce(F.try_url_decode(t), t)
    read = F.transform(pairs, lambda p: F.struct(form(F.substring_index(p, "=", 1)).alias("k"), form(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))

    def last(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda p: p["k"]))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(rows, lambda p: p["k"] == k), -1)["v"].alias("v")))

    return let(read, last)


def _malformed(segments: Column) -> Column:
    return F.exists(segments, lambda s: s.isNull())


def url_texts(raw: Column) -> Column:
    """What a URL says, as an array of (text, opaque): its path segments, then its query values.

    opaque texts go whatever they hold. A relative URL with a malformed percent
    code in its path is one text, as it is; an absolute one says nothing that
    could be shown (one null text).
    """
    part = lambda t, o: F.struct(t.alias("text"), o.alias("opaque"))

    def said(url: Column) -> Column:
        unread = F.when(url["scheme"] == "", raw)
        values = F.transform(_values(url["query"]), lambda p: part(p["v"], (p["v"] != "") & is_sensitive(p["k"], p["v"])))
        return let(_segments(url["path"]), lambda segments: F.when(_malformed(segments), F.array(part(unread, F.lit(False)))).otherwise(F.concat(F.transform(segments, lambda s: part(s, F.lit(False))), values)))

    return let(split_url(raw), said)


def url_of(raw: Column, texts: Column) -> Column:
    """The URL again with texts in the places of url_texts(raw): user names go, a fragment stays if it is a short anchor, relative paths gain a leading slash.

    Null for an absolute URL with a malformed percent code in its path, so that nothing of it gets out.
    """

    def joined(url: Column, segments: Column, values: Column) -> Column:
        path = F.array_join(F.transform(F.slice(texts, F.lit(1), F.size(segments)), lambda s: F.when(s == "", s).otherwise(encode_component(s))), "/")
        cleaned = F.slice(texts, F.size(segments) + 1, F.size(values))
        pairs = F.array_join(F.zip_with(values, cleaned, lambda p, t: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(t))), "&")
        query = let(pairs, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        anchor = url["fragment"].rlike(rf"^#[A-Za-z0-9_\-]{{1,{LONGEST_ANCHOR}}}$")
        front = F.when(url["scheme"] == "", "").otherwise(F.concat(url["scheme"], F.lit("://"), url["host"]))
        return F.concat(front, path, query, F.when(anchor, url["fragment"]).otherwise(""))

    def whole(url: Column) -> Column:
        read = F.struct(_segments(url["path"]).alias("segments"), _values(url["query"]).alias("values"))
        return let(read, lambda r: F.when(_malformed(r["segments"]), F.get(texts, F.lit(0))).otherwise(joined(url, r["segments"], r["values"])))

    return let(split_url(raw), whole)


def clean_url(raw: Column, clean_text, opaque) -> Column:
    """A URL with path segments and query values cleaned by clean_text and sensitive values replaced by opaque; see url_of.

    With a malformed percent code in its path a relative one is cleaned as one text, an absolute one is null.
    """
    return url_of(raw, F.transform(url_texts(raw), lambda p: F.when(p["opaque"], opaque(p["text"])).when(p["text"] == "", p["text"]).otherwise(clean_text(p["text"]))))


def masked_url(raw: Column) -> Column:
    """A URL with identifiers and sensitive values shown by type only: [PII_<TYPE>]."""
    from ..operators.detect import masked

    return clean_url(raw, lambda t: masked(t, pattern_spans(t))["text"], lambda v: F.lit("[PII_OTHER]"))
