"""Threat detection over single values: injections into queries, shells, paths, markup and files.

Patterns are fixed values. Every detector is boolean algebra over `rlike`; every `*_threats` lists what it
found, in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import has_external_entities, xml_threats

SQL_KEYWORD = r"(?i)\b(?:select|insert|update|delete|drop|alter|create|truncate|exec(?:ute)?|union|grant|revoke|merge)\b"
SQL_COMMENT = r"--|/\*|\*/|#\s*$"
SQL = {
    "stacked_query": r"(?i);\s*(?:select|insert|update|delete|drop|alter|create|truncate|exec(?:ute)?|grant|shutdown)\b",
    "union_select": r"(?i)\bunion\s+(?:all\s+|distinct\s+)?select\b",
    "time_based": r"(?i)\b(?:sleep|pg_sleep|benchmark|dbms_lock\.sleep)\s*\(|\bwaitfor\s+delay\b",
    "boolean_based": r"(?i)['\"]?\s*\b(?:or|and)\b\s+(?:['\"]?[0-9a-z_]+['\"]?\s*=\s*['\"]?[0-9a-z_]+|true\b|1\b|not\s+false)",
}
SQL_HEX, SQL_CHAR, SQL_QUOTE = r"(?i)\b0x[0-9a-f]{2,}", r"(?i)\b(?:char|chr|nchar)\s*\(\s*[0-9]", r"['\"`]"
NOSQL = {
    "operator": r"\$(?:where|ne|gt|gte|lt|lte|in|nin|regex|exists|or|and|not|nor|elemMatch|expr|function|accumulator)\b",
    "prototype_pollution": r"__proto__|constructor\s*[\[.]\s*[\"']?prototype|\bprototype\s*\[",
    "javascript": r"(?i)\bfunction\s*\(|=>|\bthis\.[a-z_]+\s*[=!<>]|\bsleep\s*\(|\breturn\s+(?:true|1)\b",
    "array_injection": r"\[\s*\$|\]\s*=\s*\$|\[(?:\$[a-z]+)\]",
}
LDAP = {
    "filter_break": r"\)\s*\(|\(\s*[|&!]", "wildcard": r"=\s*\*", "null_byte": r"\x00|%00|\\00", "always_true": r"\(\s*(?:objectClass|cn|uid)\s*=\s*\*\s*\)",
}
SHELL = {
    "separator": r"[;\n]|&&|\|\|", "pipe": r"(?:^|[^|])\|(?:[^|]|$)", "substitution": r"\$\(|`", "variable": r"\$\{|\$[A-Za-z_]", "redirect": r"[<>]{1,2}",
    "background": r"(?:^|[^&])&(?:[^&]|$)", "dangerous_command": r"(?i)\b(?:rm\s+-[a-z]*[rf]|mkfs|dd\s+if=|chmod\s+[0-7]{3,4}|chown|wget|curl|nc|ncat|bash\s+-i|sh\s+-c|python[0-9.]*\s+-c|perl\s+-e|eval|sudo)\b",
}
PATH = {
    "traversal": r"(?:^|[/\\])\.\.(?:[/\\]|$)", "encoded_traversal": r"(?i)%2e%2e|%252e|\.%2e|%2e\.|%c0%ae", "null_byte": r"\x00|%00",
    "absolute": r"^(?:/|[A-Za-z]:[/\\]|\\\\)", "home": r"^~", "shell_meta": r"[;|&`$<>]", "mixed_separators": r"/.*\\|\\.*/",
    "sensitive": r"(?i)(?:^|/)(?:etc/(?:passwd|shadow|hosts)|proc/self|\.ssh/|\.aws/|\.env\b|\.git/|windows/system32)",
}
XSS = {
    "script": r"(?i)<\s*script\b", "handler": r"(?i)<[^>]*\bon[a-z]{3,}\s*=", "javascript_url": r"(?i)\bjavascript\s*:", "data_url": r"(?i)\bdata\s*:\s*text/html",
    "embedding": r"(?i)<\s*(?:iframe|object|embed|svg|base|meta|link)\b", "expression": r"(?i)expression\s*\(|vbscript\s*:",
}
GRAPHQL = {"introspection": r"__schema\b|__type\b", "fragment": r"\bfragment\s+\w+\s+on\b|\.\.\.", "directive": r"@(?:include|skip|defer|stream)\b", "mutation": r"\bmutation\b"}


def _list(value: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(value.rlike(p), name) for name, p in patterns.items()]))


def _any(value: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(False)
    for p in patterns.values():
        out = out | value.rlike(p)
    return out


def is_sql_injection(value: Column) -> Column:
    keyword = value.rlike(SQL_KEYWORD)
    return _any(value, SQL) | ((value.rlike(SQL_HEX) | value.rlike(SQL_CHAR)) & keyword) | (value.rlike(SQL_QUOTE) & (value.rlike(SQL_COMMENT) | keyword))


def sql_threats(value: Column) -> Column:
    keyword, quote = value.rlike(SQL_KEYWORD), value.rlike(SQL_QUOTE)
    more = F.array_compact(F.array(
        F.when(value.rlike(SQL_HEX) & keyword, "hex_encoding"), F.when(value.rlike(SQL_CHAR) & keyword, "char_function"),
        F.when(quote & value.rlike(SQL_COMMENT), "comment"), F.when(quote & keyword, "quoted_keyword"),
    ))
    return F.concat(_list(value, SQL), more)


def is_nosql_injection(value: Column) -> Column:
    return _any(value, NOSQL)


def nosql_threats(value: Column) -> Column:
    return _list(value, NOSQL)


def is_ldap_injection(value: Column) -> Column:
    return _any(value, LDAP)


def ldap_threats(value: Column) -> Column:
    return _list(value, LDAP)


def is_command_injection(value: Column) -> Column:
    return _any(value, SHELL)


def command_threats(value: Column) -> Column:
    return _list(value, SHELL)


def is_path_traversal(value: Column) -> Column:
    return value.rlike(PATH["traversal"]) | value.rlike(PATH["encoded_traversal"])


def path_threats(value: Column) -> Column:
    return _list(value, PATH)


def is_xss(value: Column) -> Column:
    return _any(value, XSS)


def xss_threats(value: Column) -> Column:
    return _list(value, XSS)


def is_xxe(value: Column) -> Column:
    return has_external_entities(value)


def xxe_threats(value: Column) -> Column:
    return xml_threats(value)


def graphql_depth(value: Column) -> Column:
    """Deepest nesting of braces outside strings."""
    braces = F.regexp_replace(F.regexp_replace(value, r'"[^"]*"', ""), r"[^{}]", "")
    step = lambda acc, c: F.struct(
        (acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"),
        F.greatest(acc["top"], acc["now"] + F.when(c == "{", 1).otherwise(0)).alias("top"),
    )
    return F.when(value.isNotNull(), F.aggregate(F.split(braces, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step)["top"])


def graphql_counts(value: Column) -> Column:
    """struct(depth, fields, aliases)."""
    body = F.regexp_replace(value, r'"[^"]*"|\([^)]*\)', "")
    return F.struct(graphql_depth(value).alias("depth"), F.regexp_count(body, F.lit(r"[A-Za-z_]\w*\s*(?:[{}\n,]|$|\s)")).alias("fields"), F.regexp_count(body, F.lit(r"[A-Za-z_]\w*\s*:\s*[A-Za-z_]\w*")).alias("aliases"))


def is_graphql_abuse(value: Column, max_depth: int = 10, max_aliases: int = 30) -> Column:
    return value.rlike(GRAPHQL["introspection"]) | (graphql_depth(value) > max_depth) | (graphql_counts(value)["aliases"] > max_aliases)


def sql_literal(value: Column) -> Column:
    """A quoted string literal."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_identifier(value: Column, quote: str = '"') -> Column:
    return F.concat(F.lit(quote), F.replace(value, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def sql_like(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\%_])", r"\\$1")


def ldap_filter_value(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\5c"))
    for raw, code in (("*", "\\2a"), ("(", "\\28"), (")", "\\29"), ("\x00", "\\00")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def shell_quote(value: Column) -> Column:
    """A word that a shell reads literally."""
    return F.when(value.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def html_escape(value: Column) -> Column:
    out = value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out
