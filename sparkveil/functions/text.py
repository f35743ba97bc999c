"""Text hygiene: control characters, terminal escapes, log lines, Unicode tricks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ANSI = r"\x1B(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])"
ZERO_WIDTH = "[\\u200B-\\u200D\\u2060\\uFEFF]"
BIDI = "[\\u202A-\\u202E\\u2066-\\u2069\\u200E\\u200F\\u061C]"
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}"}
# Letters that look like Latin ones, position by position.
LOOKS, LATIN = "аеорсухіјѕԁһӏвнктмАВЕКМНОРСТХУοανρτιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbhktmABEKMHOPCTXYoavptiABEZHIKMNOPTYX"


def has_control(text: Column) -> Column:
    return text.rlike(CONTROL)


def count_control(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CONTROL))


def strip_control(text: Column, by: str = "") -> Column:
    """Without control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, CONTROL, by)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def has_crlf(text: Column) -> Column:
    return text.rlike(r"[\r\n]|(?i)%0[ad]")


def strip_crlf(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, r"\r\n|[\r\n]", by)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, n: int, suffix: str = "...") -> Column:
    """At most n characters, suffix included."""
    keep = max(0, n - len(suffix))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, keep), F.lit(suffix[: n - keep]))).otherwise(text)


def log_line(text: Column, max_chars: int | None = None, control_by: str = "", escape_unicode: bool = False) -> Column:
    """One safe line: escapes gone, line breaks and tabs written out, control characters replaced,
    length bounded by `max_chars`, if given."""
    out = F.replace(strip_ansi(text), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    out = strip_control(out, control_by)
    if escape_unicode:
        out = F.regexp_replace(out, r"[^\x20-\x7E]", "?")
    return truncate(out, max_chars, "...[truncated]") if max_chars else out


def has_zero_width(text: Column) -> Column:
    return text.rlike(ZERO_WIDTH)


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def has_bidi(text: Column) -> Column:
    return text.rlike(BIDI)


def strip_bidi(text: Column) -> Column:
    return F.regexp_replace(text, BIDI, "")


def scripts(text: Column) -> Column:
    """Scripts whose letters occur."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in SCRIPTS.items()]))


def is_mixed_script(text: Column) -> Column:
    return F.size(scripts(text)) > 1


def skeleton(text: Column) -> Column:
    """Look-alike letters as the Latin ones they imitate."""
    return F.translate(text, LOOKS, LATIN)


def has_confusables(text: Column) -> Column:
    return skeleton(text) != text


def normalize(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; an Arrow function, since Spark has no expression for it."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(form)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run(text)
