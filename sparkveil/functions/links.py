"""Links in running text: where they end, and which bare hosts are some.

A link with a scheme ends before white space, quotes, angle brackets and closing brackets that it didn't open; closing punctuation
stays outside, balanced brackets and quotes inside. A bare host is one only under a known suffix and without a path, port or user.
All of it is two patterns, so that it runs where the other types run; groups are possessive, so that time is linear in a text.
The rule is our own, after what prose does with links; hosts follow RFC 1123, schemes RFC 3986.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brackets within brackets count as balanced to this depth; an opening one beyond it is a character like others.
NESTING = 4

# Top-level domains under which a bare host is a link; a table of all suffixes may take their place.
SUFFIXES = frozenset(
    """com org net edu gov mil int info biz name pro io co ai app dev me tv cc xyz online site store shop blog cloud tech space live news media agency studio digital
    ac ad ae af al am ar at au az ba bd be bg bh bo br by bz ca ch ci cl cm cn cr cu cy cz de dk do dz ec ee eg es eu fi fr ge gh gr gt hk hn hr hu id ie il in iq ir is it
    jo jp ke kg kh kr kw kz la lb li lk lt lu lv ly ma md mg mk mm mn mo mt mu mx my mz na ng ni nl no np nz om pa pe ph pk pl pr pt py qa ro rs ru rw sa se sg si sk sn
    su sv sy th tn to tr tw tz ua ug uk us uy uz ve vn ye za zm zw arpa onion""".split()
)

_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}_-]{0,61}[\p{L}\p{N}])?"
_HOST = rf"(?:\[[0-9A-Fa-f:.]++\]|{_LABEL}(?:\.{_LABEL})*+)"
_AUTHORITY = rf"(?:[^\s<>\"/?#@\[\]]{{1,256}}+@)?{_HOST}(?::[0-9]{{1,5}}(?![0-9]))?"
_PLAIN = r"[^\s<>\"`|\\^{}()\[\]'?!.,:;\p{Cntrl}]"
_WEB = r"(?:https?|wss?|ftp)://"


def _balanced(depth: int) -> str:
    """A pair of brackets with all between them."""
    inner = r"[^\s<>\"`|\\^{}()\[\]\p{Cntrl}]++" + (f"|{_balanced(depth - 1)}" if depth > 1 else "")
    return "(?:" + "|".join(rf"\{a}(?:{inner})*+\{b}" for a, b in ("()", "[]", "{}")) + ")"


def _tail() -> str:
    """What follows a host: pieces that end on what may be a link's last character."""
    whole = rf"(?:{_balanced(NESTING)}|'[^\s'<>\"]*+')"
    held = rf"(?:[?!.,:;]|(?!{whole})[(\[{{'])++"
    return rf"(?:(?=[/?#])(?:{whole}|{_PLAIN}++|{held}(?:{whole}|{_PLAIN}))++)"


#: A scheme with what it needs: a host for those of the web, a host or a path for others.
SCHEME_LINK = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_WEB}{_AUTHORITY}{_tail()}?+|(?!{_WEB})[a-z][a-z0-9+.-]{{0,31}}://(?:{_AUTHORITY}{_tail()}?+|{_tail()}))"
#: A host that nothing joins to a longer word, address or path.
BARE_HOST = rf"(?<![\p{{L}}\p{{N}}@_.:/+%=-])(?:{_LABEL}\.(?=[\p{{L}}\p{{N}}]))++[A-Za-z]{{2,63}}(?![\p{{L}}\p{{N}}@_/%-]|:[0-9]|\.[\p{{L}}\p{{N}}])"


def known_host(value: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """Whether a name of two labels or more ends in one of the suffixes, which may have several labels themselves."""
    lower, by_length = F.lower(value), {}
    for s in suffixes:
        by_length.setdefault(s.count(".") + 1, []).append(s.lower())
    out = F.lit(False)
    for labels, some in sorted(by_length.items()):
        out = out | F.substring_index(lower, ".", -labels).isin(*sorted(some))
    return out & lower.contains(".")


def acceptable(value: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """Whether what a pattern took for a link is one: a port in range, or a host under a known suffix."""
    number = F.regexp_extract(value, r"^[^/]*//[^/?#]*:([0-9]{1,5})(?:[/?#]|$)", 1).try_cast("int")
    return F.when(value.contains("://"), F.coalesce(number <= 65535, F.lit(True))).otherwise(known_host(value, suffixes))


def is_link(value: Column, suffixes: Iterable[str] = SUFFIXES) -> Column:
    """Whether a value, trimmed, is one link as a whole."""
    v = F.trim(value)
    return (v.rlike(f"(?i)^(?:{SCHEME_LINK[4:]})$") | v.rlike(f"^(?:{BARE_HOST})$")) & acceptable(v, suffixes)


# Hosts, endings and beginnings that are reserved for tests or stand for development.
TEST_HOSTS = ("://localhost", "://127.0.0.1", "://[::1]", "example.com", "example.net", "example.org", "example.edu")
TEST_SUFFIXES = (".test", ".example", ".invalid", ".localhost")
TEST_BEGINNINGS = ("://dev.", "://staging.", "://test.", "://demo.", "://qa.", "://sandbox.", "://local.")


def is_test_link(value: Column) -> Column:
    """Whether a link goes to a test or development host."""
    lower, out = F.lower(value), F.lit(False)
    for part in (*TEST_HOSTS, *TEST_BEGINNINGS):
        out = out | lower.contains(part)
    for suffix in TEST_SUFFIXES:
        out = out | lower.contains(f"{suffix}/") | lower.contains(f"{suffix}:") | lower.endswith(suffix)
    return out
