"""Threats by policy and exact shapes of JSON, XML and YAML."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import structure as st

def V():  # noqa: N802
    return F.col("v")

DTD = "<!DOCTYPE a>"
EXTERNAL = '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/hosts">]><a>&x;</a>'
PARAMETER = '<!DOCTYPE a [<!ENTITY % p "q"> %p;]><a/>'
LAUGHS = '<!DOCTYPE a [<!ENTITY a "ha"><!ENTITY b "&a;&a;">]><a>&b;</a>'


@pytest.mark.parametrize(("text", "expected"), [
    ("<a/>", []), (DTD, ["dtd_present"]), (EXTERNAL, ["xxe_external_entity"]), (PARAMETER, ["xxe_parameter_entity"]), (LAUGHS, ["xxe_billion_laughs"]), ("", []), (None, None),
])
def test_xml_threats(one, text, expected):
    assert one(st.xml_threats(V().cast("string")), v=text) == expected


@pytest.mark.parametrize(("text", "policy", "expected"), [
    ("<a>&amp;</a>", st.XmlPolicy(), True), (DTD, st.XmlPolicy(), False), (DTD, st.PERMISSIVE_XML, True), (EXTERNAL, st.PERMISSIVE_XML, False), (EXTERNAL, st.XmlPolicy(True, True), True),
    (LAUGHS, st.XmlPolicy(True, True), False), ('<!DOCTYPE a "http://x/y">', st.PERMISSIVE_XML, False), (EXTERNAL, st.XmlPolicy(False, True), False),
])
def test_xml_policy(one, text, policy, expected):
    assert one(st.xml_safe(V(), policy), v=text) is expected


@pytest.mark.parametrize(("text", "policy", "expected"), [
    ("[" * 64 + "]" * 64, st.JsonPolicy(), []), ("[" * 65, st.JsonPolicy(), ["json_depth_exceeded"]), ("]]]" + '{"a":[' * 16, st.STRICT_JSON, []), ('{"a":[' * 17, st.STRICT_JSON, ["json_depth_exceeded"]),
    ("é" * 6, st.JsonPolicy(max_size=11), ["json_size_exceeded"]), ("é" * 6, st.JsonPolicy(max_size=12), []), (None, st.JsonPolicy(), None),
])
def test_json_threats(one, text, policy, expected):
    assert one(st.json_threats(V().cast("string"), policy), v=text) == expected


@pytest.mark.parametrize(("text", "policy", "expected"), [
    ("a: 1", st.YamlPolicy(), []), ("a: !!python/object/apply:os.system [ls]", st.YamlPolicy(), ["yaml_unsafe_tag"]), ("a: &x 1\nb: *x", st.YamlPolicy(), ["yaml_anchor_bomb"]),
    ("a: &x 1\nb: *x", st.PERMISSIVE_YAML, []), ("a: &x 1\nb: [*x, *x, *x, *x]", st.PERMISSIVE_YAML, ["yaml_anchor_bomb"]), ("!<tag:yaml.org,2002:python/object/apply> x", st.PERMISSIVE_YAML, ["yaml_unsafe_tag"]),
    (None, st.YamlPolicy(), None),
])
def test_yaml_threats(one, text, policy, expected):
    assert one(st.yaml_threats(V().cast("string"), policy), v=text) == expected


def nested(rng, level):
    """A random value, its depth and its number of containers and keys."""
    kind = rng.choice("dls") if level else "s"
    if kind == "s":
        return rng.choice(["{[", 'a"b\\', "]}", 1, None, "k: v"]), 0, 0
    inner = [nested(rng, level - 1) for _ in range(rng.randrange(4))]
    depth, size = 1 + max([d for _, d, _ in inner], default=0), 1 + sum(n for _, _, n in inner)
    return ({f'{{"{i}\\': v for i, (v, _, _) in enumerate(inner)}, depth, size + len(inner)) if kind == "d" else ([v for v, _, _ in inner], depth, size)


def test_json_shape_equals_tree(spark):
    rng = random.Random(1)
    cases = [nested(rng, 6) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _, _) in enumerate(cases)], "i int, v string")
    got = {r.i: (r.s.depth, r.s.elements, r.s.expansions) for r in df.select("i", st.json_shape(V()).alias("s")).collect()}
    assert got == {i: (d, n, 0) for i, (_, d, n) in enumerate(cases)}


def element(rng, level):
    """Random markup, its depth and its elements."""
    inner = [element(rng, level - 1) for _ in range(rng.randrange(4))] if level else []
    attribute = rng.choice(["", ' a="1>2"', " b='</x>'", ' c="x/"'])
    between = rng.choice(["", "text", "<!-- <no> -->", "<![CDATA[<b>]]>", "<?pi <x> ?>", "1 < 2"])
    depth, size = 1 + max([d for _, d, _ in inner], default=0), 1 + sum(n for _, _, n in inner)
    body = between.join(t for t, _, _ in inner) + between
    return (f"<e{attribute}/>" if not body else f"<e{attribute}>{body}</e >"), depth, size


def test_xml_shape_equals_tree(spark):
    rng = random.Random(2)
    cases = [element(rng, 5) for _ in range(300)]
    head = '<?xml version="1.0"?><!DOCTYPE e [<!ELEMENT e ANY>]>'
    df = spark.createDataFrame([(i, head + t) for i, (t, _, _) in enumerate(cases)], "i int, v string")
    got = {r.i: (r.s.depth, r.s.elements, r.s.expansions) for r in df.select("i", st.xml_shape(V()).alias("s")).collect()}
    assert got == {i: (d, n, 0) for i, (_, d, n) in enumerate(cases)}


def laughs(levels):
    return "<!DOCTYPE a [" + '<!ENTITY e0 "x">' + "".join(f'<!ENTITY e{i} "{f"&e{i - 1};" * 10}">' for i in range(1, levels)) + f"]><a>&e{levels - 1};</a>"


@pytest.mark.parametrize(("text", "expected"), [
    (laughs(3), 111), (laughs(9), 111_111_111), (laughs(40), st.ENDLESS), ('<!ENTITY a "&b;"><!ENTITY b "&a;"><x>&a;</x>', st.ENDLESS), ('<!ENTITY a "&b;"><!ENTITY b "&a;"><x/>', 0),
    ("<!ENTITY a 'x'><!ENTITY a '&a;'>&a;&amp;&#65;&none;", 1), ('<!ENTITY a "&b;&b;"><!ENTITY b "&c;&c;"><!ENTITY c "">&a;&c;', 8),
])
def test_xml_expansions(one, text, expected):
    assert st.xml_expansions(text) == expected
    assert one(st.xml_shape(V())["expansions"], v=text) == expected


def bomb(levels):
    return "l0: &l0 [x, x]\n" + "".join(f"l{i}: &l{i} [{', '.join([f'*l{i - 1}'] * 5)}]\n" for i in range(1, levels))


@pytest.mark.parametrize(("text", "expected"), [
    ("a: &x 1\nb: *x\nc: [*x, *x]", 3), (bomb(2), 15), (bomb(3), 15 + 5 * 16), (bomb(60), st.ENDLESS), ("&a [*a]", st.ENDLESS), ("a: '*x &y'", 0), ("a: *none", 0), ("a: [&b *c", 0),
])
def test_yaml_expansions(one, text, expected):
    assert st.yaml_expansions(text) == expected
    assert one(st.yaml_shape(V())["expansions"], v=text) == expected


def test_limits(one):
    assert one(st.over_limits(V(), "json", st.Limits(max_depth=2)), v='{"a":[[1]]}') == ["depth"]
    assert one(st.over_limits(V(), "json", st.Limits(max_depth=2)), v='{"[[[[":[1]}') == []
    assert one(st.over_limits(V(), "xml", st.Limits(max_bytes=10, max_elements=1)), v="<a><b/></a>") == ["size", "elements"]
    assert one(st.over_limits(V(), "xml"), v=laughs(9)) == ["expansions"]
    assert one(st.over_limits(V(), "yaml"), v=bomb(9)) == ["expansions"]
    assert one(st.over_limits(V(), "yaml", st.Limits(max_depth=3)), v="a:\n  b:\n    c:\n      d: [1]") == ["depth"]
    assert one(st.over_limits(V().cast("string"), "xml"), v=None) is None
    with pytest.raises(ValueError):
        st.over_limits(V(), "toml")


def test_long_texts_take_linear_time(spark):
    """Half a million brackets, tags and quotes, and a chain of 20,000 entities."""
    chain = '<!ENTITY e0 "x">' + "".join(f'<!ENTITY e{i} "&e{i - 1};">' for i in range(1, 20_000)) + "<a>&e19999;</a>"
    rows = [("[" * 500_000,), ('"\\"' * 300_000,), ("<a>" * 200_000,), ('<a b="' * 100_000,), ("<!--" * 100_000,), (chain,)]
    df = spark.createDataFrame(rows, "v string").repartition(4)
    start = time.time()
    got = df.select(st.json_shape(V()).alias("j"), st.xml_shape(V()).alias("x"), st.yaml_shape(V()).alias("y")).collect()
    assert time.time() - start < 60
    assert max(r.j.depth for r in got) == 500_000 and max(r.x.depth for r in got) == 200_000 and max(r.x.expansions for r in got) == 20_000
