"""URLs, hosts, addresses and geography."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "100.100.100.200", "fd00:ec2::254", "169.254.170.2")
REBINDING = ("nip.io", "xip.io", "sslip.io", "localtest.me", "lvh.me", "rebind.network")
DANGEROUS_SCHEMES = ("file", "gopher", "dict", "ftp", "ldap", "tftp", "jar", "netdoc", "phar", "data", "javascript")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The host of an absolute url, lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]{1,5})", 1).try_cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def normalize_path(value: Column) -> Column:
    """Leading slash, no doubled ones, none at the end, numbers and ids as {id}."""
    slashes = F.regexp_replace(F.concat(F.lit("/"), value), "/+", "/")
    ids = F.regexp_replace(F.regexp_replace(slashes, r"/[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "/{id}"), r"/[0-9]+(?=/|$)", "/{id}")
    return F.when(ids == "/", ids).otherwise(F.regexp_replace(ids, "/$", ""))


def path_matches(value: Column, pattern: str) -> Column:
    """A pattern with * for one segment and ** for any number."""
    escaped = "".join(c if c.isalnum() or c in "/_-*" else "\\" + c for c in pattern)
    return value.rlike("^" + escaped.replace("**", "\x00").replace("*", "[^/]*").replace("\x00", ".*") + "$")


def ip_number(value: Column) -> Column:
    """IPv4 address as a long; null for anything else."""
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).try_cast("long")
    good = value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    return F.when(good, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


# Address blocks and their classes; the first that holds counts.
BLOCKS = (
    ("loopback", "127.0.0.0", 8), ("private", "10.0.0.0", 8), ("private", "172.16.0.0", 12), ("private", "192.168.0.0", 16), ("link_local", "169.254.0.0", 16),
    ("shared", "100.64.0.0", 10), ("unspecified", "0.0.0.0", 8), ("multicast", "224.0.0.0", 4), ("reserved", "240.0.0.0", 4),
)


def _number(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ip_class(value: Column) -> Column:
    n = ip_number(value)
    out = F.when(n.isNotNull(), "public")
    for name, base, bits in reversed(BLOCKS):
        low = _number(base)
        out = F.when(n.between(low, low + 2 ** (32 - bits) - 1), name).otherwise(out)
    return out


def is_internal(value: Column) -> Column:
    """A host that a request from outside should not reach."""
    v6 = value.rlike(r"^\[?(?:::1|::|f[cd][0-9a-f]{2}:|fe80:)")
    return F.coalesce(ip_class(value).isin("loopback", "private", "link_local", "shared", "unspecified"), F.lit(False)) | v6 | value.isin("localhost", "localhost.localdomain") | value.rlike(r"\.(?:local|internal|intranet|corp|lan|localhost)$")


def encoded_ip(value: Column) -> Column:
    """Addresses written as one number, in hexadecimal or with octal parts."""
    return value.rlike(r"^(?:[0-9]{8,10}|0x[0-9a-f]{8}|(?:0[0-7]{1,3}|0x[0-9a-f]{1,2})(?:\.(?:0[0-7]{1,3}|0x[0-9a-f]{1,2}|[0-9]{1,3})){3})$")


def ssrf_threats(url: Column) -> Column:
    """array<string> of what makes a url dangerous to fetch."""
    h = host(url)
    rebinding = F.lit(False)
    for name in REBINDING:
        rebinding = rebinding | (h == name) | h.endswith("." + name)
    return F.array_compact(F.array(
        F.when(h.isin(*METADATA_HOSTS), "cloud_metadata"), F.when(is_internal(h), "internal_host"), F.when(encoded_ip(h), "encoded_ip"),
        F.when(rebinding, "dns_rebinding"), F.when(scheme(url).isin(*DANGEROUS_SCHEMES), "dangerous_scheme"), F.when(url.rlike(r"://[^/?#]*@"), "credentials"),
    ))


def mac_normalize(value: Column) -> Column:
    bare = F.lower(F.regexp_replace(value, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(bare) == 12, F.regexp_replace(bare, r"(..)(?!$)", "$1:"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course in degrees, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360, F.lit(360.0))


def dms(value: Column, latitude: bool = True) -> Column:
    """Decimal degrees as degrees, minutes, seconds and hemisphere."""
    a = F.abs(value)
    d, m = F.floor(a), F.floor((a - F.floor(a)) * 60)
    s = (a - d) * 3600 - m * 60
    side = F.when(value < 0, "S" if latitude else "W").otherwise("N" if latitude else "E")
    return F.concat(d.cast("string"), F.lit("°"), m.cast("string"), F.lit("'"), F.format_string("%.2f", s), F.lit('"'), side)


def ddm(value: Column, latitude: bool = True) -> Column:
    a = F.abs(value)
    side = F.when(value < 0, "S" if latitude else "W").otherwise("N" if latitude else "E")
    return F.concat(F.floor(a).cast("string"), F.lit("°"), F.format_string("%.4f", (a - F.floor(a)) * 60), F.lit("'"), side)


def from_dms(value: Column) -> Column:
    part = lambda i: F.regexp_extract(value, r"([0-9]+)°([0-9]+)'([0-9.]+)\"([NSEW])", i)
    number = part(1).try_cast("double") + part(2).try_cast("double") / 60 + part(3).try_cast("double") / 3600
    return F.when(part(4).isin("S", "W"), -number).otherwise(number)
