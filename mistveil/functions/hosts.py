"""Predicates over URLs, hosts and devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PRIVATE_SUFFIXES = ("localhost", "local", "internal", "lan", "intranet", "home.arpa")
INTEGRATED_VENDORS = ("apple", "qualcomm", "arm", "imgtec", "imagination", "broadcom", "samsung")


def _private_v4(a: Column, b: Column) -> Column:
    return a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))


def is_private_host(url: Column) -> Column:
    """Whether a URL points into a private network; unreadable: true, other schemes than http and https: false."""
    parts = r"^(?i)([a-z][a-z0-9+.\-]*):(?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?(?:[/?#].*)?)?"
    scheme, host = F.lower(F.regexp_extract(url, r"^(?i)([a-z][a-z0-9+.\-]*):", 1)), F.regexp_replace(F.lower(F.regexp_extract(url, parts, 2)), r"\.$", "")
    octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("int"))
    is_v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: o <= 255)
    inner = F.regexp_replace(host, r"^\[|\]$", "")
    mapped = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    word = lambda i: F.conv(F.regexp_extract(inner, mapped, i), 16, 10).cast("int")
    high = word(1)
    first = F.coalesce(F.conv(F.nullif(F.substring_index(inner, ":", 1), F.lit("")), 16, 10).cast("int"), F.lit(0))
    v6 = F.when(inner.isin("::", "::1"), True).when(inner.rlike(mapped), _private_v4(F.shiftright(high, 8), high.bitwiseAND(255)))
    v6 = v6.otherwise((first.bitwiseAND(0xFE00) == 0xFC00) | (first.bitwiseAND(0xFFC0) == 0xFE80))
    suffix = host.isin(*PRIVATE_SUFFIXES)
    for s in PRIVATE_SUFFIXES:
        suffix = suffix | F.endswith(host, F.lit(f".{s}"))
    named = F.when(~F.contains(host, F.lit(".")), True).otherwise(suffix)
    web = F.when(host == "", True).when(F.startswith(host, F.lit("[")), v6).when(is_v4, _private_v4(F.get(octets, F.lit(0)), F.get(octets, F.lit(1)))).otherwise(named)
    return F.coalesce(F.when(scheme == "", True).when(~scheme.isin("http", "https"), False).otherwise(web), F.lit(True))


def endpoint(raw: Column) -> Column:
    """A usable HTTP endpoint without trailing slashes: https, or http on this machine; no user, query or fragment. Else null."""
    shape = r"^(?i)(https?)://([^/?#@:]+)(:\d+)?(/[^?#]*)?$"
    url = F.trim(raw)
    scheme, host = F.lower(F.regexp_extract(url, shape, 1)), F.lower(F.regexp_extract(url, shape, 2))
    port = F.regexp_extract(url, shape, 3)
    usual = ((scheme == "https") & (port == ":443")) | ((scheme == "http") & (port == ":80"))
    fine = url.rlike(shape) & ((scheme == "https") | host.isin("localhost", "127.0.0.1"))
    whole = F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(port), F.regexp_extract(url, shape, 4))
    return F.when(fine, F.regexp_replace(whole, "/+$", ""))


def may_leave_worker(url: Column, own_origin: Column) -> Column:
    """Egress allow-list of a worker: inline data, its own origin, blobs of its own origin."""
    blob = F.startswith(url, F.concat(F.lit("blob:"), own_origin, F.lit("/")))
    own = (url == own_origin) | F.startswith(url, F.concat(own_origin, F.lit("/")))
    return F.coalesce(F.startswith(url, F.lit("data:")) | blob | own, F.lit(False))


def gpu_kind(vendor: Column, architecture: Column, kind: Column, is_fallback: Column) -> Column:
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    v, a, t = text(vendor), text(architecture), text(kind)
    software = "swiftshader|llvmpipe|lavapipe|software"
    return (
        F.when(F.coalesce(is_fallback, F.lit(False)), "software")
        .when(F.contains(t, F.lit("discrete")), "discrete")
        .when(F.contains(t, F.lit("integrated")), "integrated")
        .when((t == "cpu") | v.rlike(software) | a.rlike(software), "software")
        .when(v == "nvidia", "discrete")
        .when(v == "intel", F.when(F.contains(a, F.lit("hp")), "discrete").otherwise("integrated"))
        .when(v.isin(*INTEGRATED_VENDORS), "integrated")
        .otherwise("unknown")
    )


def gpu_usable(kind: Column, vendor: Column) -> Column:
    return F.coalesce((kind == "discrete") | ((kind == "integrated") & (F.lower(vendor) == "apple")), F.lit(False))


def compute_target(usable: Column, force: Column) -> Column:
    """(compute, forced): a force may always pick wasm, but webgpu only where it is usable."""
    able = F.coalesce(usable, F.lit(False))
    compute = F.when((force == "wasm") | ~able, "wasm").otherwise("webgpu")
    return F.struct(compute.alias("compute"), F.coalesce((force == "wasm") | ((force == "webgpu") & able), F.lit(False)).alias("forced"))


def http_reason(status: Column) -> Column:
    """Reason code of a backend's HTTP status; null for success."""
    return F.when(status.between(200, 299), F.lit(None).cast("string")).when(status == 426, "backend_version_unsupported").when(status == 429, "backend_rate_limited").otherwise("backend_error")


def pool_size(cores: Column, kind: str) -> Column:
    """Workers for a device: "vision" leaves two cores free, "ocr" takes half of them; 1 to 3."""
    wanted = cores - 2 if kind == "vision" else F.floor(cores / 2)
    return F.least(F.greatest(wanted, F.lit(1)), F.lit(3)).cast("int")
