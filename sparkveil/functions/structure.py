"""Structured texts as a risk: threats in JSON, XML and YAML by policy, and exact shapes held against limits.

Threats go by patterns and counts, shapes by structure: strings, comments and declarations are left out, depth is folded over the
brackets that remain, a piece of the text at a time. Both are expressions. Only what references expand to (entities, anchors)
needs Python, and only texts that define some reach it, in Arrow batches. Null texts give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind, pieces

# The threats with their weakness numbers and severities (1 to 5), and the patterns that show them.
CWE = {
    "xxe_external_entity": "CWE-611", "xxe_parameter_entity": "CWE-611", "xxe_billion_laughs": "CWE-776", "dtd_present": "CWE-827",
    "json_depth_exceeded": "CWE-400", "json_size_exceeded": "CWE-400", "yaml_unsafe_tag": "CWE-502", "yaml_anchor_bomb": "CWE-776",
}
SEVERITY = {
    "xxe_external_entity": 5, "xxe_parameter_entity": 4, "xxe_billion_laughs": 4, "dtd_present": 2,
    "json_depth_exceeded": 3, "json_size_exceeded": 3, "yaml_unsafe_tag": 5, "yaml_anchor_bomb": 4,
}
DOCTYPE = r"(?i)<!DOCTYPE\s"
EXTERNAL_ENTITY = r"(?i)<!ENTITY\s+\w+\s+(SYSTEM|PUBLIC)\s+"
PARAMETER_ENTITY = r"(?i)<!ENTITY\s+%\s*\w+"
PROTOCOL = r"(?i)(file|http|https|ftp|data|php|expect|jar)://"
ENTITY_EXPANSION = r"""<!ENTITY\s+\w+\s+["'][^"']*&\w+;[^"']*["']>"""
UNSAFE_TAGS = (
    r"!!python/(object|module|name|exec|apply|import)", r"!!ruby/(object|hash|struct|sym|exception)", r"!!php/(object|class)", r"!!java/(object|class)",
    r"!<tag:yaml\.org,2002:python/object/apply>",
)
ANCHOR, ALIAS = r"&\w+", r"\*\w+"

#: More expansions than this, and those of cycles, count as this many.
ENDLESS = 2**62


@dataclass(frozen=True)
class JsonPolicy:
    """max_depth: of nested brackets; max_size: in bytes."""

    max_depth: int = 64
    max_size: int = 10 * 1024 * 1024


@dataclass(frozen=True)
class XmlPolicy:
    """allow_dtd: document types may be declared; allow_external: and external or parameter entities."""

    allow_dtd: bool = False
    allow_external: bool = False


@dataclass(frozen=True)
class YamlPolicy:
    """max_aliases: references to anchors."""

    max_aliases: int = 0


STRICT_JSON, PERMISSIVE_XML, PERMISSIVE_YAML = JsonPolicy(32, 1024 * 1024), XmlPolicy(allow_dtd=True), YamlPolicy(100)


@dataclass(frozen=True)
class Limits:
    """Bounds of a shape: bytes, depth, elements, and nodes or references that expand."""

    max_bytes: int = 10 * 1024 * 1024
    max_depth: int = 64
    max_elements: int = 1_000_000
    max_expansions: int = 10_000


def _named(*found: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in found]))


def _present(text: Column, threats: Column) -> Column:
    return F.when(text.isNotNull(), threats)


def _deepest(marks: Column, opening: str, closing: str, leaf: str = "") -> Column:
    """The greatest depth in a string of marks; a closing mark without an opening one counts for nothing."""

    def step(acc: Column, c: Column) -> Column:
        inside = acc["now"] + F.when(c.isin(*opening, *leaf), 1).otherwise(0)
        now = F.when(c.isin(*opening), inside).when(c.isin(*closing), F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["top"], inside).alias("top"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(pieces(marks), zero, lambda acc, part: F.aggregate(F.split(part, ""), acc, step))["top"]


def bracket_depth(text: Column) -> Column:
    """Depth of braces and square brackets, wherever they stand."""
    return _deepest(F.regexp_replace(text, r"[^{}\[\]]+", ""), "{[", "}]")


def json_threats(text: Column, p: JsonPolicy = JsonPolicy()) -> Column:
    """array<string>: json_size_exceeded, json_depth_exceeded."""
    return _present(text, _named(("json_size_exceeded", F.octet_length(text) > p.max_size), ("json_depth_exceeded", bracket_depth(text) > p.max_depth)))


def xml_threats(text: Column) -> Column:
    """array<string>: external and parameter entities, entities within entities; dtd_present only where nothing else is."""
    worse = _named(("xxe_external_entity", text.rlike(EXTERNAL_ENTITY)), ("xxe_parameter_entity", text.rlike(PARAMETER_ENTITY)), ("xxe_billion_laughs", text.rlike(ENTITY_EXPANSION)))
    return _present(text, bind(worse, lambda w: F.when((F.size(w) == 0) & text.rlike(DOCTYPE), F.array(F.lit("dtd_present"))).otherwise(w)))


def has_external_entities(text: Column) -> Column:
    """External or parameter entities, or a protocol beside a document type."""
    return text.rlike(EXTERNAL_ENTITY) | text.rlike(PARAMETER_ENTITY) | (text.rlike(DOCTYPE) & text.rlike(PROTOCOL))


def has_unsafe_tags(text: Column) -> Column:
    out = F.lit(False)
    for tag in UNSAFE_TAGS:
        out = out | text.rlike(tag)
    return out


def has_anchor_bomb(text: Column) -> Column:
    """Anchors, and over three times as many aliases, or over ten."""
    anchors, aliases = F.regexp_count(text, F.lit(ANCHOR)), F.regexp_count(text, F.lit(ALIAS))
    return (anchors > 0) & ((aliases > anchors * 3) | (aliases > 10))


def yaml_threats(text: Column, p: YamlPolicy = YamlPolicy()) -> Column:
    """array<string>: yaml_unsafe_tag, yaml_anchor_bomb."""
    bomb = (F.regexp_count(text, F.lit(ALIAS)) > p.max_aliases) | has_anchor_bomb(text)
    return _present(text, _named(("yaml_unsafe_tag", has_unsafe_tags(text)), ("yaml_anchor_bomb", bomb)))


def json_safe(text: Column, p: JsonPolicy = JsonPolicy()) -> Column:
    return F.size(json_threats(text, p)) == 0


def xml_safe(text: Column, p: XmlPolicy = XmlPolicy()) -> Column:
    """Whether the policy allows all that a text declares. Entities within entities are never allowed."""
    excused = (("dtd_present",) if p.allow_dtd else ()) + (("xxe_external_entity", "xxe_parameter_entity") if p.allow_external else ())
    left = F.filter(xml_threats(text), lambda t: ~t.isin(*excused)) if excused else xml_threats(text)
    out = F.size(left) == 0
    if not p.allow_external:
        out = out & ~has_external_entities(text)
    return out if p.allow_dtd else out & ~text.rlike(DOCTYPE)


def yaml_safe(text: Column, p: YamlPolicy = YamlPolicy()) -> Column:
    return F.size(yaml_threats(text, p)) == 0


# ---- exact shapes

_JSON_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"?+'
#: What is no element: comments, character data, instructions, declarations with or without a subset.
_XML_OTHER = r"(?s)<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<\?.*?(?:\?>|$)|<![A-Za-z][^\[<>]*+(?:\[.*?\]\s*+)?+>"
_XML_INSIDE = r"""[A-Za-z_:](?:[^<>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+"""
_OPEN, _CLOSE, _LEAF = "\x01", "\x02", "\x03"


def json_shape(text: Column) -> Column:
    """struct(depth, elements, expansions): of brackets outside strings; objects, arrays and keys; none expand."""

    def made(bare: Column) -> Column:
        elements = F.regexp_count(bare, F.lit(r"[{\[]")) + F.regexp_count(bare, F.lit(r'"\s*:'))
        return F.struct(bracket_depth(bare).alias("depth"), elements.alias("elements"), F.lit(0).cast("long").alias("expansions"))

    return F.when(text.isNotNull(), bind(F.regexp_replace(text, _JSON_STRING, '"'), made))


def _xml_marks(text: Column) -> Column:
    """An opening, a closing or a leaf mark for each tag."""
    out = F.regexp_replace(F.regexp_replace(text, "[\x01-\x03]+", ""), _XML_OTHER, "")
    for pattern, mark in ((f"<{_XML_INSIDE}/>", _LEAF), (r"</[^<>]*+>", _CLOSE), (f"<{_XML_INSIDE}>", _OPEN)):
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(out, "[^\x01-\x03]+", "")


def xml_shape(text: Column) -> Column:
    """struct(depth, elements, expansions): of elements; expansions are the entity references of the body, each with those
    that its value holds."""

    def made(marks: Column) -> Column:
        elements = F.length(F.replace(marks, F.lit(_CLOSE), F.lit("")))
        return F.struct(_deepest(marks, _OPEN, _CLOSE, _LEAF).alias("depth"), elements.alias("elements"))

    # Python can't stand within a lambda, so it is added to what the lambda made.
    return F.when(text.isNotNull(), bind(_xml_marks(text), made).withField("expansions", _counted(text, text.contains("<!ENTITY"), xml_expansions)))


def yaml_shape(text: Column) -> Column:
    """struct(depth, elements, expansions): flow brackets outside double quotes or levels of indentation, whichever is deeper; items
    and keys; nodes that aliases stand for. What isn't YAML expands to nothing."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)(?:^|(?<=\s))#.*$", ""), _JSON_STRING, '"')
    indents = F.transform(F.regexp_extract_all(bare, F.lit(r"(?m)^( *)\S"), F.lit(1)), F.length)
    levels = F.size(F.array_distinct(indents))
    elements = F.regexp_count(bare, F.lit(r"(?m)^\s*+-(?:\s|$)|[^\s:,\[{]\s*+:(?:\s|$)|[{\[]"))
    aliased = text.rlike(r"&[^\s\[\]{},]") & text.rlike(r"\*[^\s\[\]{},]")
    made = F.struct(F.greatest(levels, bracket_depth(bare)).alias("depth"), elements.alias("elements"), _counted(text, aliased, yaml_expansions).alias("expansions"))
    return F.when(text.isNotNull(), made)


def _counted(text: Column, some: Column, count: Callable[[str], int]) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(count, na_action="ignore").astype("Int64")

    return F.coalesce(run(F.when(some, text)), F.lit(0).cast("long"))


def weights(parts: dict[str, list[str]]) -> dict[str, int]:
    """What each name expands to, itself included, where it consists of other names; without recursion."""
    done: dict[str, int] = {}
    for root in parts:
        stack, path = [(root, False)], set()
        while stack:
            name, closed = stack.pop()
            if closed:
                path.discard(name)
                done[name] = min(ENDLESS, 1 + sum(done.get(x, 0) for x in parts[name]))
            elif name in path:
                done[name] = ENDLESS
            elif name not in done:
                path.add(name)
                stack.append((name, True))
                stack += [(x, False) for x in parts[name] if x in parts and (x in path or x not in done)]
    return done


_ENTITY = re.compile(r"""<!ENTITY\s+([^\s%"'<>]+)\s+(?:"([^"]*)"|'([^']*)')\s*>""")
_REFERENCE = re.compile(r"&([^\s&;#]+);")


def xml_expansions(text: str) -> int:
    """Declared entities that a parser would put in; of two declarations of a name the first holds."""
    parts: dict[str, list[str]] = {}
    for m in _ENTITY.finditer(text):
        parts.setdefault(m[1], _REFERENCE.findall(m[2] if m[2] is not None else m[3]))
    known, body = weights(parts), re.sub(r"<!ENTITY[^>]*>", "", text)
    return min(ENDLESS, sum(known.get(name, 0) for name in _REFERENCE.findall(body)))


def yaml_expansions(text: str) -> int:
    """Nodes that aliases stand for, from the parser's events: memory follows the depth and the anchors."""
    import yaml

    sizes: dict[str, int] = {}
    open_nodes: list[list] = [[None, 0]]
    total = 0
    try:
        for event in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            if isinstance(event, yaml.AliasEvent):
                inside = any(name == event.anchor for name, _ in open_nodes)
                size = ENDLESS if inside else sizes.get(event.anchor, 0)
                total, open_nodes[-1][1] = min(ENDLESS, total + size), min(ENDLESS, open_nodes[-1][1] + size)
            elif isinstance(event, yaml.ScalarEvent):
                open_nodes[-1][1] += 1
                if event.anchor:
                    sizes[event.anchor] = 1
            elif isinstance(event, yaml.CollectionStartEvent):
                open_nodes.append([event.anchor, 1])
            elif isinstance(event, yaml.CollectionEndEvent):
                name, size = open_nodes.pop()
                open_nodes[-1][1] = min(ENDLESS, open_nodes[-1][1] + size)
                if name:
                    sizes[name] = size
    except (yaml.YAMLError, ValueError):
        return 0
    return total


SHAPES = {"json": json_shape, "xml": xml_shape, "yaml": yaml_shape}


def over_limits(text: Column, kind: str, p: Limits = Limits()) -> Column:
    """array<string> of the limits that a text breaks: size, depth, elements, expansions."""
    if kind not in SHAPES:
        raise ValueError(f"no format {kind!r}; there are {', '.join(SHAPES)}")
    s = SHAPES[kind](text)
    broken = _named(("size", F.octet_length(text) > p.max_bytes), ("depth", s["depth"] > p.max_depth), ("elements", s["elements"] > p.max_elements), ("expansions", s["expansions"] > p.max_expansions))
    return _present(text, broken)
