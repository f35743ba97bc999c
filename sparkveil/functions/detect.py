"""Detection: spans, counts and presence of identifiers in text columns, all as Column expressions.

Offsets are in characters, half-open; `byte_spans` gives UTF-8 bytes. Texts of any length are scanned whole;
with `max_bytes`, a guard that is off by default (`GUARD_BYTES` is a usual size), longer ones match nothing.
Null text gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CONFIDENCE, SPAN
from .arrays import bind, cut, measured, pieces, scan as running
from .checksums import VALIDATORS
from .links import acceptable
from .patterns import BY_NAME, GATES, POSTAL_WINDOW, POSTAL_WORDS, PRESETS, PROVIDERS, TYPES, Gate, Type
from .words import AMBIGUOUS

#: A usual guard for single messages.
GUARD_BYTES = 10_000


def phone(value: Column, strict: bool = True) -> Column:
    """E.164 shape. Strict: North American numbers also need an area and exchange of [2-9], other than
    N11 and the fictional exchange 555."""
    digits = F.regexp_replace(value, r"[^0-9+]", "")
    shape = digits.rlike(r"^\+[1-9][0-9]{7,14}$")
    if not strict:
        return shape
    return shape & (~digits.startswith("+1") | (digits.rlike(r"^\+1[2-9][0-9]{2}[2-9][0-9]{6}$") & ~digits.rlike(r"^\+1...(?:555|.11)")))


def guard(text: Column, max_bytes: int | None) -> Column:
    return F.lit(True) if max_bytes is None else F.octet_length(text) <= max_bytes


#: Types whose validator takes the digits alone, and those whose validator takes what stands last.
DIGITS_ONLY = frozenset(["credit_card", "ssn", "routing_number", "npi", "uk_nhs", "poland_pesel", "turkey_tckn", "india_aadhaar", "italy_vat", "sweden_personnummer", *(t.name for t in TYPES if t.name.startswith("australia_"))])
LAST_PART = frozenset(["vin", "dea_number"])


def passes(kind: Type, match: Column) -> Column:
    """Whether a match passes its type's validator."""
    if kind.check is None:
        return F.lit(True)
    if kind.check == "phone":
        return phone(match)
    if kind.check == "hostname":
        return match.rlike("[-0-9:]")
    if kind.check == "username":
        return match.rlike("[_.-]") & ~match.rlike("^[0-9]+$")
    if kind.check == "postal":  # the short forms only count with context: see `find`
        return ~match.rlike("^[0-9]{4}$") & ~match.rlike("^[0-9]{6}$")
    if kind.check == "link":
        return acceptable(match)
    bare = match
    if kind.name in DIGITS_ONLY:
        bare = F.regexp_replace(match, r"[^0-9]", "")
    elif kind.name in LAST_PART:
        bare = F.regexp_extract(match, r"([A-Za-z0-9]+)$", 1)
    return F.coalesce(VALIDATORS[kind.check](bare), F.lit(False))


def _meant(kind: Type, match: Column) -> Column:
    """Whether a match of a lexical type counts: names that are words as well need a capital."""
    return match.rlike(r"^\p{Lu}") | ~F.lower(match).isin(*AMBIGUOUS) if set(kind.words) & AMBIGUOUS else F.lit(True)


def _in_place(kind: Type, text: Column) -> Callable[[Column], Column]:
    """`passes` for a span of a text, or of its pieces for types that also look at what stands around."""

    def holds(span: Column) -> Column:
        match = span["matched_text"]
        if kind.words:
            return _meant(kind, match)
        if kind.check != "postal":
            return passes(kind, match)
        near = cut(text, F.greatest(span["start"] - POSTAL_WINDOW, F.lit(0)), span["end"] + POSTAL_WINDOW).rlike(POSTAL_WORDS)
        return passes(kind, match) | (near & (match.rlike("^[0-9]{6}$") | (match >= "0200")))

    return holds


def _valid_spans(kind: Type, text: Column, pattern: str) -> Column:
    """The spans of one of a type's patterns that pass."""
    spans = raw_spans(text, pattern)
    if kind.check == "postal":
        return bind(pieces(text), lambda parts: F.filter(spans, _in_place(kind, parts)))
    return F.filter(spans, _in_place(kind, text))


#: What stands for matches where a text is cut at them.
MARK = "\u0001"


def gaps(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches. `split` compiles its pattern anew for each text, which for long
    patterns takes far longer than the search: matches become a mark first, unless the text holds it itself."""
    return F.when(text.contains(MARK), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK)), MARK, -1))


def raw_spans(text: Column, pattern: str) -> Column:
    """All matches of one pattern as array<struct(start, end, matched_text)>. The gaps between matches and the
    matches' lengths add up to the offsets; both are found once a text."""
    pairs = F.zip_with(gaps(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["gap"], at + x["gap"] + F.length(x["m"])
        made = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("matched_text"))
        return F.coalesce(end, at), F.when(x["m"].isNotNull(), made)

    return F.when(text.isNotNull(), running(pairs, F.lit(0), step, "struct<start:int,end:int,matched_text:string>"))


def replaced(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """`text` with each match of `pattern` rewritten (or left, where `rewrite` gives it back): gaps and matches are
    laid side by side and joined once."""
    parts = F.zip_with(gaps(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.when(m.isNull(), gap).otherwise(F.concat(gap, F.coalesce(rewrite(m), F.lit("")))))
    return F.array_join(parts, "")


def dedupe(spans: Column) -> Column:
    """Drop spans that start before the last kept one ends, taken by start, then longest, then most
    confident."""
    rank = lambda s: F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), s["confidence"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-(s["end"] - s["start"])).alias("b"), (-rank(s)).alias("c"), s.alias("s")))
    sorted_spans = F.transform(F.array_sort(keyed), lambda x: x["s"])
    return running(sorted_spans, F.lit(0), lambda end, s: (F.when(s["start"] >= end, s["end"]).otherwise(end), F.when(s["start"] >= end, s)), SPAN.simpleString())


def find(text: Column, name: str, max_bytes: int | None = None) -> Column:
    """Spans of one type: array of `SPAN`, in order, without overlaps."""
    kind = BY_NAME[name]
    found = []
    for pattern in kind.patterns:
        spans = _valid_spans(kind, text, pattern)
        made = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["matched_text"].alias("matched_text"), F.lit(name).alias("identifier_type"), F.lit(kind.confidence).alias("confidence")))
        found.append(F.when(text.rlike(pattern), made).otherwise(F.array().cast(f"array<{SPAN.simpleString()}>")) if len(kind.patterns) > 1 else made)
    every = found[0] if len(found) == 1 else bind(F.concat(*found), lambda x: F.when(F.size(x) > 1, dedupe(x)).otherwise(x))
    empty = F.array().cast(f"array<{SPAN.simpleString()}>")
    return F.when(text.isNotNull(), F.when(guard(text, max_bytes) & gate(text, kind), every).otherwise(empty))


def densest(text: Column) -> Column:
    """The most digits in a row, where up to three other characters between two digits don't part them."""
    joined = F.regexp_replace(text, "(?<=[0-9])[^0-9]{1,3}(?=[0-9])", "")
    return F.coalesce(F.array_max(F.transform(F.split(joined, "[^0-9]+", -1), F.length)), F.lit(0))


def any_word(words: Iterable[str]) -> str:
    """A pattern of any of the words, as a whole word of letters and digits: a tree of their letters, so that a word that is
    none of them fails at its first letters, however many they are."""

    def tree(some: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in some:
            by.setdefault(w[:1], []).append(w[1:])
        made = [re.escape(c) + tree(rest) for c, rest in sorted(by.items()) if c]
        return "" if not made else (made[0] if len(made) == 1 and "" not in by else f"(?:{'|'.join(made)})" + ("?+" if "" in by else ""))

    return rf"(?<![\p{{L}}\p{{N}}]){tree(sorted(set(words)))}(?![\p{{L}}\p{{N}}])"


def firsts(kind: Type) -> list[str]:
    """The first words of a lexical type's phrases."""
    return [w.split()[0] for w in kind.words]


#: Any first word of a lexical type.
FIRST_WORDS = any_word(w for t in TYPES for w in firsts(t))


def facts(text: Column) -> Column:
    """What the gates of all types look at, once a text; of its words those that a phrase of a lexical type begins with."""
    lower = F.lower(text)
    words = F.regexp_extract_all(lower, F.lit(FIRST_WORDS), F.lit(0))
    return F.struct(text.alias("text"), lower.alias("lower"), F.when(text.rlike("[0-9]"), densest(text)).otherwise(0).alias("digits"), words.alias("words"))


def _marked(lower: Column, marks: Iterable[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | lower.contains(m)
    return out


def open_gate(seen: Column, kind: Type) -> Column:
    """Whether a text, by its `facts`, may hold the type at all."""
    g = GATES.get(kind.name, Gate())
    out = F.lit(True) if not g.digits else seen["digits"] >= g.digits
    if g.otherwise:
        out = out | _marked(seen["lower"], g.otherwise)
    if kind.words:
        out = out & (F.size(seen["words"]) > 0) & F.arrays_overlap(seen["words"], F.array(*[F.lit(w) for w in firsts(kind)]))
    if g.marks:
        out = out & _marked(seen["lower"], g.marks)
    if g.hint:
        out = out & seen["text"].rlike(g.hint)
    return out


def gate(text: Column, kind: Type) -> Column:
    """The cheap test that runs first: whether any pattern of the type occurs at all."""
    g = GATES.get(kind.name, Gate())
    out = bind(F.lower(text), lambda low: _marked(low, g.marks)) if g.marks else F.lit(True)
    any_of = F.lit(False)
    for pattern in kind.patterns:
        any_of = any_of | text.rlike(pattern)
    return out & any_of


def count(text: Column, name: str, max_bytes: int | None = None) -> Column:
    """Number of matches. A type with one pattern and no validator needs no spans."""
    kind = BY_NAME[name]
    if len(kind.patterns) == 1 and kind.check is None and not kind.words:
        return F.when(text.isNotNull(), F.when(guard(text, max_bytes), F.regexp_count(text, F.lit(kind.patterns[0]))).otherwise(0))
    return F.size(find(text, name, max_bytes))


def _holds(text: Column, kind: Type) -> Column:
    """Whether a text has a match that passes."""
    out = F.lit(False)
    for pattern in kind.patterns:
        some = text.rlike(pattern)
        if kind.check == "postal":  # most forms count anywhere; the others only in a text with one of the words
            anywhere = F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: passes(kind, m))
            some = some & (anywhere | text.rlike(POSTAL_WORDS.replace(r"\b", "")) & (F.size(_valid_spans(kind, text, pattern)) > 0))
        elif set(kind.words) & AMBIGUOUS:
            some = some & F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _meant(kind, m))
        elif kind.check is not None:
            some = some & F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: passes(kind, m))
        out = out | some
    return out


def present(text: Column, name: str, max_bytes: int | None = None) -> Column:
    kind = BY_NAME[name]
    g = GATES.get(name, Gate())
    marked = bind(F.lower(text), lambda low: _marked(low, g.marks)) if g.marks else F.lit(True)
    return guard(text, max_bytes) & marked & _holds(text, kind)


def matches(value: Column, name: str) -> Column:
    """Whether a single value, trimmed, is an identifier of the type and passes its validator."""
    kind = BY_NAME[name]
    v = F.trim(value)
    whole = F.lit(False)
    for pattern in kind.patterns + kind.alone:
        flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        whole = whole | v.rlike(f"{flags}^(?:{body})$")
    return whole & passes(kind, v)


#: Types that most single values have the form of: only what is nothing else is one of these.
LOOSE = ("postal_code", "domain", "username", "hostname", "port")


def identifier_type(value: Column, preset: str = "all") -> Column:
    """The first type, in scanner order but with `LOOSE` last, that the whole value belongs to; null if none."""
    kinds = [t.name for t in types_of(preset)]
    ordered = [n for n in kinds if n not in LOOSE] + [n for n in LOOSE if n in kinds]
    return F.coalesce(*[F.when(matches(value, n), n) for n in ordered], F.lit(None).cast("string"))


def medical_type(value: Column) -> Column:
    """The first medical type that the whole value belongs to: provider, DEA number, record, insurance, prescription, code."""
    return identifier_type(value, ("medical",))


def session_like(text: Column) -> Column:
    """Whether a whole value looks like a session id: 20 characters at least, letters and digits, and over half of the
    characters different."""
    v = F.trim(text)
    return (F.length(v) >= 20) & v.rlike(r"\p{L}") & v.rlike(r"\p{N}") & (F.size(F.array_distinct(F.split(v, ""))) > F.length(v) / 2)


def types_of(preset: str | Iterable[str] = "default") -> list[Type]:
    domains = PRESETS[preset] if isinstance(preset, str) else tuple(preset)
    return [t for t in TYPES if t.domain in domains]


def scan(text: Column, preset: str | Iterable[str] = "default", max_bytes: int | None = None) -> Column:
    """The types present, in scanner order: array<string>.

    Each text is looked at once for what the gates need; a type's patterns run only behind its gate. A user name
    counts where the text has other personal data, `api_key` where no provider's token was found; `session_id` is
    told of whole texts.
    """
    kinds = types_of(preset)

    def found(seen: Column) -> Column:
        return F.array_compact(F.array(*[F.when(open_gate(seen, t) & _holds(seen["text"], t), t.name) for t in kinds if t.name != "username"]))

    def settled(names: Column) -> Column:
        has = lambda some: F.arrays_overlap(names, F.array(*[F.lit(n) for n in some]))
        out = F.filter(names, lambda n: ~((n == "api_key") & has(PROVIDERS)))
        if any(t.domain == "tokens" for t in kinds):
            out = F.concat(out, F.when(session_like(text), F.array(F.lit("session_id"))).otherwise(F.array().cast("array<string>")))
        if any(t.name == "username" for t in kinds):
            person = has(("email", "phone", "name", "birthdate")) & _holds(text, BY_NAME["username"])
            out = F.concat(out, F.when(person, F.array(F.lit("username"))).otherwise(F.array().cast("array<string>")))
        order = [t.name for t in kinds] + ["session_id"]
        return F.array_intersect(F.array(*[F.lit(n) for n in order]), out)

    if not kinds:
        return F.when(text.isNotNull(), F.array().cast("array<string>")).alias("pii_types")
    types = bind(bind(facts(text), found), settled)
    return F.when(text.isNotNull(), F.when(guard(text, max_bytes), types).otherwise(F.array().cast("array<string>"))).alias("pii_types")


def is_pii_present(text: Column, preset: str | Iterable[str] = "default", max_bytes: int | None = None) -> Column:
    out = F.lit(False)
    for t in types_of(preset):
        out = out | F.coalesce(present(text, t.name, max_bytes), F.lit(False))
    return out


def find_all(text: Column, names: Iterable[str], max_bytes: int | None = None) -> Column:
    """Spans of several types, concatenated; overlaps between types stay."""
    return F.concat(*[find(text, n, max_bytes) for n in names])


def byte_spans(text: Column, spans: Column) -> Column:
    """The same spans with byte_start and byte_end."""
    return measured(text, F.octet_length, lambda upto: F.transform(spans, lambda s: s.withField("byte_start", upto(s["start"])).withField("byte_end", upto(s["end"]))))


def line_spans(text: Column, spans: Column) -> Column:
    """The same spans with start_line and end_line, the line breaks before each."""
    breaks = lambda part: F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
    return measured(text, breaks, lambda upto: F.transform(spans, lambda s: s.withField("start_line", upto(s["start"])).withField("end_line", upto(s["end"]))))
