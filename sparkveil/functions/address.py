"""Postal addresses in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUFFIXES = {
    "street": "St", "avenue": "Ave", "boulevard": "Blvd", "road": "Rd", "drive": "Dr", "lane": "Ln", "court": "Ct", "place": "Pl", "square": "Sq", "terrace": "Ter", "parkway": "Pkwy",
    "highway": "Hwy", "circle": "Cir", "north": "N", "south": "S", "east": "E", "west": "W", "apartment": "Apt", "suite": "Ste", "building": "Bldg", "floor": "Fl",
}
POSTAL = {
    "US": r"[0-9]{5}(?:-[0-9]{4})?", "UK": r"[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}", "CA": r"[ABCEGHJ-NPRSTVXY][0-9][A-Z] [0-9][A-Z][0-9]", "DE": r"[0-9]{5}", "FR": r"(?:0[1-9]|[1-8][0-9]|9[0-8])[0-9]{3}",
    "AU": r"[0-9]{4}", "JP": r"[0-9]{3}-[0-9]{4}", "IN": r"[1-8][0-9]{5}", "NL": r"[1-9][0-9]{3} [A-Z]{2}", "BR": r"[0-9]{5}-[0-9]{3}",
}


def normalize_address(value: Column) -> Column:
    """Single spaces, words capitalised, usual abbreviations without full stops."""
    out = F.initcap(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))))
    for word, short in SUFFIXES.items():
        out = F.regexp_replace(out, rf"\b{word.capitalize()}\b\.?", short)
    return F.regexp_replace(out, r"\b(St|Ave|Blvd|Rd|Dr|Ln|Ct|Pl|Apt|Ste|Hwy)\.", "$1")


def normalize_postal(value: Column, country: str) -> Column:
    """The usual form of a postal code; null if the country has no such code."""
    bare = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    shaped = {
        "US": F.when(F.length(bare) == 9, F.regexp_replace(bare, r"^(.{5})", "$1-")).otherwise(bare), "UK": F.regexp_replace(bare, r"(.{3})$", " $1"), "CA": F.regexp_replace(bare, r"(.{3})$", " $1"),
        "JP": F.regexp_replace(bare, r"^(.{3})", "$1-"), "NL": F.regexp_replace(bare, r"^(.{4})", "$1 "), "BR": F.regexp_replace(bare, r"^(.{5})", "$1-"),
    }.get(country, bare)
    return F.when(shaped.rlike(f"^{POSTAL[country]}$"), shaped)


def postal_country(value: Column) -> Column:
    """Countries whose codes have the value's form."""
    return F.array_compact(F.array(*[F.when(F.upper(F.trim(value)).rlike(f"^{p}$"), c) for c, p in POSTAL.items()]))
