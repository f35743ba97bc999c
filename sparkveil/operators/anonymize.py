"""Span-based anonymization: conflicts between detections, operators per entity type, and their reverse.

Detections are an array column of `DETECTION` structs with character offsets. Configurations are checked
on the driver before anything runs. The result is a struct column (text, items).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import masking, tokens
from ..functions.arrays import bind, cut, pieces, scan
from ..functions.patterns import SECRET_TYPES
from ..schemas import DETECTION, ENGINE_RESULT, ITEM
from .sweep import sweep_frame

STRATEGIES = ("none", "keep_best", "trim")
Custom = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Operator:
    """name: replace, redact, mask, hash, encrypt, decrypt, keep or custom; params: its settings."""

    name: str
    params: dict = field(default_factory=dict)


DEFAULT = Operator("replace")


def _check(entity: str, op: Operator) -> None:
    p = op.params
    known = {
        "replace": {"new_value"}, "redact": set(), "keep": set(), "mask": {"masking_char", "chars_to_mask", "from_end"}, "hash": {"algorithm", "salt"},
        "encrypt": {"key", "deterministic", "derive"}, "decrypt": {"key", "strict", "derive"}, "custom": {"function", "reverse"},
    }
    if op.name not in known:
        raise ValueError(f"{entity}: no operator {op.name!r}")
    if extra := set(p) - known[op.name]:
        raise ValueError(f"{entity}: {op.name} takes no {sorted(extra)}")
    if op.name == "mask" and not p.get("masking_char", "*"):
        raise ValueError(f"{entity}: masking_char is empty")
    if op.name == "hash" and 0 < len(p.get("salt", "").encode()) < 16:
        raise ValueError(f"{entity}: a salt has 16 bytes at least")
    if op.name == "hash" and p.get("algorithm", "").startswith("hmac") and not p.get("salt"):
        raise ValueError(f"{entity}: {p['algorithm']} needs a salt, which is its key")
    if op.name in ("encrypt", "decrypt") and not p.get("key"):
        raise ValueError(f"{entity}: {op.name} needs a key")
    if op.name == "custom" and not callable(p.get("function")):
        raise ValueError(f"{entity}: custom needs a function")
    if op.name == "hash" and p.get("algorithm") == "argon2" and entity.lower() not in SECRET_TYPES:
        raise ValueError(f"{entity}: argon2 is for secrets only")


def validate(operators: dict[str, Operator]) -> None:
    for entity, op in operators.items():
        _check(entity, op)


def apply(op: Operator, value: Column, entity: Column) -> Column:
    """What an operator writes for a value."""
    p = op.params
    if op.name == "replace":
        return F.lit(p["new_value"]) if p.get("new_value") else F.concat(F.lit("<"), entity, F.lit(">"))
    if op.name == "redact":
        return F.lit("")
    if op.name == "keep":
        return value
    if op.name == "mask":
        return masking.mask_chars(value, max(0, p.get("chars_to_mask", 1 << 30)), p.get("masking_char", "*"), p.get("from_end", False))
    if op.name == "hash":
        return tokens.tagged_hash(value, p.get("algorithm", "sha256"), p.get("salt", ""))
    if op.name == "encrypt":
        return tokens.encrypt(value, p["key"], entity, p.get("deterministic", False), p.get("derive", False))
    if op.name == "decrypt":
        return tokens.decrypt(value, p["key"], entity, p.get("strict", True), p.get("derive", False))
    return p["function"](value, entity)


EMPTY = f"array<{DETECTION.simpleString()}>"


def _fold(spans: Column, keep: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(spans, F.array().cast(EMPTY), lambda acc, s: F.when(keep(acc, s), F.concat(acc, F.array(s))).otherwise(acc))


def by_place(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("c"), (-s["score"]).alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def by_priority(spans: Column) -> Column:
    """Best score first, then longest, then leftmost."""
    keyed = F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["entity_type"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def typed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(*[s[f.name].cast(f.dataType).alias(f.name) for f in DETECTION.fields]))


def _trimmed(spans: Column) -> Column:
    """Each span, best first, cut to the longest part that better ones leave free (of equal ones the first): a part
    begins with the span or where a better one ends, and ends with the span or where the next begins."""

    def step(acc: Column, s: Column) -> Column:
        def cut(near: Column) -> Column:
            begins = F.concat(F.array(s["start"]), F.transform(near, lambda t: t["end"]))
            free = F.filter(begins, lambda b: (b >= s["start"]) & (b < s["end"]) & ~F.exists(near, lambda t: (t["start"] <= b) & (b < t["end"])))
            upto = lambda b: F.coalesce(F.array_min(F.filter(F.transform(near, lambda t: t["start"]), lambda x: x >= b)), s["end"])
            return F.array_max(F.transform(free, lambda b: F.struct((F.least(upto(b), s["end"]) - b).alias("n"), (-b).alias("back"))))

        part = cut(F.filter(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
        made = bind(part, lambda x: F.struct(s["entity_type"].alias("entity_type"), (-x["back"]).alias("start"), (x["n"] - x["back"]).alias("end"), s["score"].alias("score")))
        return bind(made, lambda m: F.when(m["start"].isNotNull(), F.concat(acc, F.array(m))).otherwise(acc))

    return F.aggregate(spans, F.array().cast(EMPTY), step)


def _groups(spans: Column) -> Column:
    """Spans by place, as arrays of those that hang together: a group begins where all before have ended."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    begins = scan(numbered, F.lit(-1), lambda reach, s: (F.greatest(reach, s["end"]), F.when(s["start"] >= reach, s["i"])), "int")
    both = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(spans))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(bind(begins, both), lambda x: F.slice(spans, x["a"] + 1, x["b"] - x["a"]))


def resolve(spans: Column, strategy: str = "keep_best", length: Column | None = None) -> Column:
    """Detections without overlaps, in order. none: a span that starts before the last one ends goes;
    keep_best: the better one of two that overlap stays; trim: the worse one keeps its longest free part. With the `length` of their
    text, only spans with 0 <= start < end <= length count.

    An expression, so it may stand anywhere: n log n in the spans, but quadratic in those of one group that hangs together by
    overlaps; `anonymize_frame(swept=True)` is n log n in these too."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {STRATEGIES}")
    spans = typed(spans)
    sound = (lambda s: s["start"] < s["end"]) if length is None else (lambda s: (s["start"] >= 0) & (s["start"] < s["end"]))
    whole = F.filter(spans, sound) if length is None else bind(length, lambda n: F.filter(spans, lambda s: sound(s) & (s["end"] <= n)))
    if strategy == "none":
        return scan(by_place(whole), F.lit(0), lambda end, s: (F.when(s["start"] >= end, s["end"]).otherwise(end), F.when(s["start"] >= end, s)), DETECTION.simpleString())
    apart = lambda acc, s: ~F.exists(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    best = (lambda g: _fold(by_priority(g), apart)) if strategy == "keep_best" else (lambda g: _trimmed(by_priority(g)))
    return bind(by_place(whole), lambda p: F.when(F.size(p) > 0, F.flatten(F.transform(_groups(p), lambda g: F.when(F.size(g) > 1, by_place(best(g))).otherwise(g)))).otherwise(p))


def _chosen(operators: dict[str, Operator], value: Column, entity: Column) -> tuple[Column, Column]:
    default = operators.get("DEFAULT", DEFAULT)
    out, name = apply(default, value, entity), F.lit(default.name)
    for kind, op in operators.items():
        if kind != "DEFAULT":
            out, name = F.when(entity == kind, apply(op, value, entity)).otherwise(out), F.when(entity == kind, op.name).otherwise(name)
    return out, name


def anonymize(text: Column, detections: Column, operators: dict[str, Operator] | None = None, strategy: str = "keep_best", items: bool = True) -> Column:
    """struct(text, items): the text with each resolved detection replaced by its operator's output, and
    where each output stands; without `items` the text alone. Detections outside the text are left out; null text gives
    null, null detections count as none."""
    operators = operators or {}
    validate(operators)
    if any(op.name == "hash" and op.params.get("algorithm", "sha256") not in ("sha256", "sha512", "hmac-sha256", "hmac-sha512") for op in operators.values()):
        raise ValueError("this hash runs in Arrow and can't stand inside an array expression; use anonymize_frame")
    spans = resolve(F.coalesce(detections, F.array().cast(EMPTY)), strategy, F.length(text))

    empty = F.array().cast(f"array<{ITEM.simpleString()}>")

    def laid(parts: Column) -> Column:
        """The text and items of (gap, new, name, entity_type) in order: strings are joined once, only lengths run on."""
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["gap"])
            end = start + F.coalesce(F.length(x["new"]), F.lit(0))
            return end, F.struct(start.alias("start"), end.alias("end"), x["entity_type"].alias("entity_type"), x["new"].alias("text"), x["name"].alias("operator"))

        joined = F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(x["new"], F.lit("")))), "")
        if not items:
            return F.struct(joined.alias("text"))
        return F.struct(joined.alias("text"), scan(parts, F.lit(0), step, ITEM.simpleString()).alias("items"))

    def over(found: Column, whole: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            new, name = _chosen(operators, cut(whole, s["start"], s["end"]), s["entity_type"])
            gap = cut(whole, F.coalesce(F.get(found, i - 1)["end"], F.lit(0)), s["start"])
            return F.struct(gap.alias("gap"), new.alias("new"), name.alias("name"), s["entity_type"].alias("entity_type"))

        tail = cut(whole, F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0)), F.length(text))
        return bind(bind(F.transform(found, part), laid), lambda done: F.struct(F.concat(done["text"], tail).alias("text"), done["items"].alias("items")) if items else F.concat(done["text"], tail))

    none = F.struct(text.alias("text"), empty.alias("items")) if items else text
    done = bind(spans, lambda found: F.when(F.size(found) > 0, bind(pieces(text), lambda whole: over(found, whole))).otherwise(none))
    return F.when(text.isNotNull(), done.cast(ENGINE_RESULT) if items else done)


def _reverse(op: Operator, strict: bool) -> Operator:
    """What undoes an operator: decrypt, custom's reverse, or nothing. A value that doesn't decrypt fails the query if
    `strict`, else it stays as it is."""
    if op.name == "encrypt":
        key, derive = op.params["key"], op.params.get("derive", False)
        return Operator("decrypt", {"key": key, "derive": derive}) if strict else Operator("custom", {"function": lambda v, kind: F.coalesce(tokens.decrypt(v, key, kind, False, derive), v)})
    if op.name == "custom" and op.params.get("reverse"):
        return Operator("custom", {"function": op.params["reverse"]})
    return Operator("keep")


def deanonymize(text: Column, items: Column, operators: dict[str, Operator], strict: bool = False) -> Column:
    """The text with the items' outputs turned back by each type's reverse; see `_reverse` for `strict`."""
    reverse = {kind: _reverse(op, strict) for kind, op in operators.items()}
    spans = F.transform(items, lambda i: F.struct(i["entity_type"].alias("entity_type"), i["start"].alias("start"), i["end"].alias("end"), F.lit(1.0).alias("score")))
    return anonymize(text, spans, reverse | {"DEFAULT": reverse.get("DEFAULT", Operator("keep"))}, "none")


def redact_all(text: Column, detections: Column) -> Column:
    return anonymize(text, detections, {"DEFAULT": Operator("redact")}, items=False)


def anonymize_frame(df: DataFrame, text: str, detections: str, operators: dict[str, Operator] | None = None, strategy: str = "keep_best", into: str = "anonymized", swept: bool = False) -> DataFrame:
    """`df` with the result struct. Rows are independent, so the work follows the input's partitions. With `swept` conflicts are
    resolved in Arrow batches first (see `sweep`), for texts in which thousands of spans hang together by overlaps."""
    if not swept or strategy == "none":
        return df.withColumn(into, anonymize(F.col(text), F.col(detections), operators, strategy))
    ready = sweep_frame(df.withColumn(into, typed(F.coalesce(F.col(detections), F.array().cast(EMPTY)))), text, into, strategy == "trim")
    return ready.withColumn(into, anonymize(F.col(text), F.col(into), operators, "none"))


def anonymize_record(value: Column, fields: dict[str, Operator], kinds: dict[str, str] | None = None) -> Column:
    """A JSON object in text form as a map of its top-level fields with those in `fields` rewritten."""
    validate(fields)
    kinds = kinds or {}
    parsed = F.from_json(value, "map<string,string>")
    out = parsed
    for name, op in fields.items():
        new = apply(op, F.element_at(parsed, name), F.lit(kinds.get(name, name)))
        out = F.when(F.map_contains_key(parsed, F.lit(name)), F.map_concat(_without(out, name), F.create_map(F.lit(name), new))).otherwise(out)
    return out


def rewrite_nested(value: Column, kind: T.DataType, rewrites: dict[str, Callable[[Column], Column]]) -> Column:
    """A value of type `kind` (structs, arrays and maps, nested at will) with the strings at dotted paths rewritten.

    The elements of an array have its path; keys of maps are parts of a path like names of fields. Nulls stay null,
    and what no path names stays as it is. A path that leads to no string of the type is an error.
    """
    reached = set()

    def at(value: Column, kind: T.DataType, path: str) -> Column:
        under = f"{path}." if path else ""
        if path not in rewrites and not any(p.startswith(under) for p in rewrites):
            return value
        if isinstance(kind, T.StructType):
            fields = [at(value.getField(f.name), f.dataType, under + f.name).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: at(x, kind.elementType, path))
        if isinstance(kind, T.MapType):
            keys = sorted({p[len(under) :].split(".")[0] for p in rewrites if p.startswith(under)})

            def entry(k: Column, v: Column) -> Column:
                out = v
                for key in keys:
                    out = F.when(k == key, at(v, kind.valueType, under + key)).otherwise(out)
                return out

            return F.transform_values(value, entry)
        if isinstance(kind, T.StringType) and path in rewrites:
            reached.add(path)
            return F.when(value.isNotNull(), rewrites[path](value))
        return value

    made = at(value, kind, "")
    if missing := set(rewrites) - reached:
        raise ValueError(f"no strings at {sorted(missing)}")
    return made


def _by_path(fields: dict[str, Operator]) -> dict[str, Callable[[Column], Column]]:
    validate(fields)
    return {path: lambda v, op=op, path=path: apply(op, v, F.lit(path)) for path, op in fields.items()}


def anonymize_nested(value: Column, kind: T.DataType, fields: dict[str, Operator]) -> Column:
    """A nested record with the operators of the dotted paths applied to whole values; see `rewrite_nested`. JSON text is
    read with `from_json` and written with `to_json`."""
    return rewrite_nested(value, kind, _by_path(fields))


def deanonymize_nested(value: Column, kind: T.DataType, fields: dict[str, Operator], strict: bool = False) -> Column:
    """`anonymize_nested` undone, as far as its operators can be; see `_reverse` for `strict`."""
    return rewrite_nested(value, kind, _by_path({path: _reverse(op, strict) for path, op in fields.items()}))


def _without(record: Column, name: str) -> Column:
    return F.map_filter(record, lambda k, _: k != name)
