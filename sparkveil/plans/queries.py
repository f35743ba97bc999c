"""The registered queries of the privacy and audit engine, each with the SQL that checks it.

A query is a function of (spark, folder); `SQL` holds its equivalent over the same tables. Patterns come
from the one catalogue on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checksums, context, dates, detect, entropy, files, masking, network, redact, structure, text, threats, tokens, words
from ..functions.patterns import BY_NAME
from ..functions.times import micros
from ..operators import anonymize as anon
from ..operators import audit, correlate, lexicon, metrics, spans, vault, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over four partitions a core where their files give fewer: scanning a text costs far more than
    moving it. A table of many files or row groups stays as it is."""
    return spread(table(spark, sf_dir, "documents"))


def spread(df: DataFrame) -> DataFrame:
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Links of the web in texts without brackets, for the SQL.
PLAIN_URL = r"https?://[^\s<>\"]*[A-Za-z0-9/]"


def _all(name: str) -> str:
    """All patterns of a type as one, which holds where they don't overlap. Links have a plain form for engines without look-around."""
    if name == "url":
        return PLAIN_URL
    return "|".join(f"(?:{p})" for p in BY_NAME[name].patterns)


def pattern(name: str) -> str:
    return quoted(_all(name) if len(BY_NAME[name].patterns) > 1 else BY_NAME[name].patterns[0])


# ---- finding

HEX_SECRET = r"\b[0-9a-f]{40}\b"
PHONE_SHAPE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
LUHN_SQL = "(list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN (length({v}) - i) % 2 = 1 THEN (substr({v}, i, 1)::INT * 2) // 10 + (substr({v}, i, 1)::INT * 2) % 10 ELSE substr({v}, i, 1)::INT END)) % 10 = 0)"


def _found_sql(p: str) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(p)})) AS matched_text FROM documents"


def _raw(spark: SparkSession, sf_dir: str, p: str) -> DataFrame:
    docs = documents(spark, sf_dir).where(F.col("text").rlike(p))
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("matched_text"))


@query(_found_sql(BY_NAME["email"].patterns[0]))
def find_emails(spark, sf_dir):
    return spans.spans_table(documents(spark, sf_dir), ["email"]).select("doc_id", "matched_text")


@query(_found_sql(_all("ip_address")))
def find_ipv4(spark, sf_dir):
    return spans.spans_table(documents(spark, sf_dir), ["ip_address"]).select("doc_id", "matched_text")


_CARDS_SQL = f"""SELECT doc_id, m AS matched_text FROM (SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, {pattern('credit_card')})) AS m FROM documents))
WHERE {LUHN_SQL.format(v='v')} AND NOT regexp_matches(v, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$')"""


@query(_CARDS_SQL)
def find_cards(spark, sf_dir):
    return spans.spans_table(documents(spark, sf_dir), ["credit_card"]).select("doc_id", "matched_text")


def _number(factor: int, digits: int) -> str:
    """Digits that follow from a customer's key."""
    return f"lpad(CAST(c_custkey * {factor} % {10**digits} AS STRING), {digits}, '0')"


# Texts made from the customers' keys, so that types which the documents lack are found, and refused, in rows of the tables; the
# expressions mean the same in both engines.
_A, _B, _C, _D = _number(7919, 3), _number(104_729, 3), _number(31, 4), _number(1, 2)
_PHONE_TEXTS = f"""CASE c_custkey % 5 WHEN 0 THEN 'call +1-' || {_A} || '-' || {_B} || '-' || {_C} WHEN 1 THEN 'or +1 (' || {_A} || ') ' || {_B} || ' ' || {_C} || '.' WHEN 2 THEN '+44 20 ' || {_C} || ' ' || {_C}
WHEN 3 THEN '+49' || {_A} || {_B} || {_C} || {_D} ELSE '1-' || {_A} || '-' || {_B} || '-' || {_C} END"""
_SSN_TEXTS = f"""CASE c_custkey % 5 WHEN 0 THEN 'SSN: ' || {_A} || '-' || {_D} || '-' || {_C} WHEN 1 THEN 'Social Security: ' || {_A} || {_D} || {_C} WHEN 2 THEN 'no ' || {_A} || '-' || {_D} || '-' || {_C} || ' end'
WHEN 3 THEN 'no ' || {_A} || ' ' || {_D} || ' ' || {_C} || '.' ELSE 'bare ' || {_A} || {_D} || {_C} END"""
_HEX = "md5(CAST(c_custkey AS STRING))"
_PAIR_TEXTS = f"""CASE c_custkey % 6 WHEN 0 THEN 'user' || {_A} || '@example.com' || chr(10) || 'password: Pw' || {_C} WHEN 1 THEN substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-4' || substr({_HEX}, 13, 3) || '-8' || substr({_HEX}, 16, 3) || '-' || substr({_HEX}, 19, 12) || ' secret=' || {_HEX}
WHEN 2 THEN 'https://oauth.example.com/cb password=pw' || {_C} WHEN 3 THEN 'token=public' || {_HEX} || ' and secret=' || {_HEX} WHEN 4 THEN 'user' || {_A} || '@example.com ' || repeat('far ', 130) || 'password: Pw' || {_C}
ELSE 'user' || {_A} || '@example.com ' || repeat(chr(10), 6) || 'password: Pw' || {_C} END"""


def _texts_sql(made: str) -> str:
    return f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -c_custkey, {made} FROM customer)"


def _texts(spark: SparkSession, sf_dir: str, made: str) -> DataFrame:
    """The documents, and the texts made for the customers under negative ids."""
    own = spread(table(spark, sf_dir, "customer").select("c_custkey")).select((-F.col("c_custkey")).alias("doc_id"), F.expr(made.replace("chr(10)", "char(10)")).alias("text"))
    return documents(spark, sf_dir).select("doc_id", "text").unionByName(own)


@query(f"""WITH {_texts_sql(_PHONE_TEXTS)} SELECT doc_id, m AS matched_text FROM (SELECT doc_id, m, regexp_replace(m, '[^0-9+]', '', 'g') AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, {pattern('phone')})) AS m FROM texts))
WHERE regexp_matches(v, '^[+][1-9][0-9]{{7,14}}$') AND (NOT starts_with(v, '+1') OR (regexp_matches(v, '^[+]1[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') AND substr(v, 6, 3) <> '555' AND substr(v, 7, 2) <> '11'))""")
def find_phones(spark, sf_dir):
    return spans.spans_table(_texts(spark, sf_dir, _PHONE_TEXTS), ["phone"]).select("doc_id", "matched_text")


@query(_found_sql(PHONE_SHAPE))
def find_phone_shape(spark, sf_dir):
    return _raw(spark, sf_dir, PHONE_SHAPE)


@query(_found_sql(HEX_SECRET))
def find_hex_secret(spark, sf_dir):
    return _raw(spark, sf_dir, HEX_SECRET)


_LABELLED, *_BARE = BY_NAME["ssn"].patterns


@query(f"""WITH {_texts_sql(_SSN_TEXTS)}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(_LABELLED)})) AS matched_text FROM texts
UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, {quoted(_LABELLED)}, ' # ', 'g'), {quoted('|'.join(f'(?:{p})' for p in _BARE))})) FROM texts)
SELECT doc_id, matched_text FROM (SELECT *, regexp_replace(matched_text, '[^0-9]', '', 'g') AS d FROM m)
WHERE length(d) = 9 AND d[1:3] NOT IN ('000', '666') AND d[1] <> '9' AND d[4:5] <> '00' AND d[6:9] <> '0000' AND d NOT IN ('123456789', '078051120', '219099999')""")
def find_ssn(spark, sf_dir):
    return spans.spans_table(_texts(spark, sf_dir, _SSN_TEXTS), ["ssn"]).select("doc_id", "matched_text")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, {pattern('api_key')})) AS matched_text FROM documents")
def find_api_keys(spark, sf_dir):
    return spans.spans_table(documents(spark, sf_dir), ["api_key"]).select("doc_id", "matched_text")


@query(f"SELECT page_id, unnest(regexp_extract_all(url, {quoted(PLAIN_URL)})) AS matched_text FROM pages")
def find_urls(spark, sf_dir):
    return spans.spans_table(table(spark, sf_dir, "pages"), ["url"], "page_id", "url").select("page_id", "matched_text")


@query(f"""SELECT doc_id, matched_text, CASE WHEN v[1] = '4' THEN 'visa' WHEN left(v, 2)::INT BETWEEN 51 AND 55 OR left(v, 4)::INT BETWEEN 2221 AND 2720 THEN 'mastercard' WHEN left(v, 2) IN ('34', '37') THEN 'amex'
WHEN left(v, 4) = '6011' OR left(v, 3)::INT BETWEEN 644 AND 649 OR left(v, 2) = '65' THEN 'discover' WHEN left(v, 3)::INT BETWEEN 300 AND 305 OR left(v, 2) IN ('36', '38') THEN 'diners' WHEN left(v, 4)::INT BETWEEN 3528 AND 3589 THEN 'jcb'
WHEN left(v, 6)::INT BETWEEN 506099 AND 506198 THEN 'verve' WHEN left(v, 2) = '62' THEN 'unionpay' WHEN left(v, 4)::INT IN (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763) THEN 'maestro'
WHEN left(v, 2) IN ('60', '82') OR left(v, 3) = '508' THEN 'rupay' END AS brand FROM (SELECT *, regexp_replace(matched_text, '[^0-9]', '', 'g') AS v FROM ({_CARDS_SQL}))""")
def card_luhn_valid(spark, sf_dir):
    return find_cards(spark, sf_dir).withColumn("brand", checksums.card_brand(F.regexp_replace("matched_text", "[^0-9]", "")))


@query(f"""WITH m AS (SELECT doc_id, string_split_regex(text, {pattern('email')}) AS gaps, regexp_extract_all(text, {pattern('email')}) AS ms FROM documents),
e AS (SELECT doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) AS i FROM m)
SELECT doc_id, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS start,
  (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))::INT AS "end", ms[i] AS matched_text FROM e""")
def span_offsets(spark, sf_dir):
    return spans.spans_table(documents(spark, sf_dir), ["email"]).select("doc_id", "start", "end", "matched_text")


_COUNTED = ("email", "ip_address", "api_key", "uuid")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", *[detect.count(F.col("text"), n).cast("long").alias(f"n_{n}") for n in _COUNTED])


def _report_sql(by: str) -> str:
    counts = ", ".join(f"sum(len(regexp_extract_all(text, {pattern(n)})))::BIGINT AS n_{n}" for n in _COUNTED)
    return f"SELECT {by}, count(*)::BIGINT AS n_docs, {counts} FROM documents GROUP BY {by}"


def _report(spark, sf_dir, by: str) -> DataFrame:
    return _counted(documents(spark, sf_dir)).groupBy(by).agg(F.count("*").alias("n_docs"), *[F.sum(f"n_{n}").alias(f"n_{n}") for n in _COUNTED])


@query(_report_sql("lang"))
def pii_by_lang(spark, sf_dir):
    return _report(spark, sf_dir, "lang")


@query(_report_sql("source"))
def pii_by_source(spark, sf_dir):
    return _report(spark, sf_dir, "source")


_DIRTY = f"(regexp_matches(text, {pattern('email')}) OR regexp_matches(text, {pattern('ip_address')}) OR regexp_matches(text, {pattern('api_key')}))"


def _dirty() -> Column:
    t = F.col("text")
    return detect.present(t, "email") | detect.present(t, "ip_address") | detect.present(t, "api_key")


@query(f"SELECT quality, toxic, count(*)::BIGINT AS n_docs, sum({_DIRTY}::INT)::BIGINT AS n_dirty FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def pii_vs_labels(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", _dirty().cast("int").alias("dirty"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("dirty").alias("n_dirty"))


_KINDS = ("email", "ip_address", "api_key")


@query(f"SELECT doc_id FROM documents d WHERE NOT {_DIRTY}")
def clean_docs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return spans.without_any(docs, spans.spans_table(docs, _KINDS)).select("doc_id")


@query(f"SELECT doc_id FROM documents d WHERE {_DIRTY}")
def dirty_docs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return spans.with_any(docs, spans.spans_table(docs, _KINDS)).select("doc_id")


_TYPED_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS identifier_type, '{BY_NAME[n].domain}' AS domain, unnest(regexp_extract_all(text, {pattern(n)})) AS m FROM documents" for n in _KINDS
)


@query(f"SELECT domain, identifier_type, count(*)::BIGINT AS n FROM ({_TYPED_SQL}) GROUP BY ROLLUP (domain, identifier_type)")
def type_dimension_rollup(spark, sf_dir):
    return spans.rollup_report(spans.spans_table(documents(spark, sf_dir), _KINDS))


@query(f"SELECT identifier_type, count(*)::BIGINT AS n FROM ({_TYPED_SQL}) GROUP BY ALL")
def count_by_type(spark, sf_dir):
    return spans.count_by_type(spans.spans_table(documents(spark, sf_dir), _KINDS))


@query("""SELECT doc_id, array_to_string(list_filter(['email', 'ip_address', 'api_key'], lambda n: (n = 'email' AND e) OR (n = 'ip_address' AND i) OR (n = 'api_key' AND a)), ',') AS pii_types FROM (
SELECT doc_id, """ + f"regexp_matches(text, {pattern('email')}) AS e, regexp_matches(text, {pattern('ip_address')}) AS i, regexp_matches(text, {pattern('api_key')}) AS a FROM documents)")
def scan_types(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array(*[F.when(detect.present(t, n), n) for n in _KINDS]), ",").alias("pii_types"))


@query()
def scan_default(spark, sf_dir):
    """Every type of the default domains; the country checksums have no short SQL."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(detect.scan(F.col("text")), ",").alias("pii_types"))


# ---- redaction and masking


@query(f"SELECT doc_id, sha256(regexp_replace(text, {pattern('email')}, '[EMAIL]', 'g')) AS redacted FROM documents")
def redact_email_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(redact.redact_type(F.col("text"), "email"), 256).alias("redacted"))


_STRICT_SQL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, {pattern('email')}, '[EMAIL]', 'g'), '\\b([0-9]{{1,3}})\\.(?:[0-9]{{1,3}}\\.){{2}}[0-9]{{1,3}}\\b', '\\1.***.***.***', 'g'), {quoted(BY_NAME['ip_address'].patterns[1])}, '[IP_ADDRESS]', 'g'), {pattern('api_key')}, '[API_KEY]', 'g')"


@query(f"SELECT doc_id, sha256({_STRICT_SQL}) AS redacted FROM documents")
def redact_profile_strict(spark, sf_dir):
    return redact.redact_frame(documents(spark, sf_dir), "text", _KINDS).select("doc_id", F.sha2("text", 256).alias("redacted"))


_LENIENT_SQL = _STRICT_SQL.replace(f"regexp_replace(text, {pattern('email')}, '[EMAIL]', 'g')", f"regexp_replace(text, '\\b([A-Za-z0-9_%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b)', '\\1***\\2', 'g')")


@query(f"SELECT doc_id, sha256({_LENIENT_SQL}) AS redacted FROM documents")
def redact_profile_lenient(spark, sf_dir):
    return redact.redact_frame(documents(spark, sf_dir), "text", _KINDS, "production_lenient").select("doc_id", F.sha2("text", 256).alias("redacted"))


@query()
def redact_default_strict(spark, sf_dir):
    """The whole default scan, each type found redacted by the strict profile; tests hold it against plain Python."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(redact.redact(F.col("text")), 256).alias("redacted"))


@query(f"SELECT doc_id, repeat('*', length(matched_text) - 4) || right(matched_text, 4) AS masked FROM ({_CARDS_SQL})")
def mask_card_last4(spark, sf_dir):
    return find_cards(spark, sf_dir).select("doc_id", masking.show_last(F.col("matched_text"), 4).alias("masked"))


@query("""SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 2) AS first_two, repeat('*', length(c_name) - 3) || right(c_name, 3) AS last_three,
left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS middle, repeat('*', length(c_name)) AS every, regexp_replace(c_name, '[\\pL\\pN]', '*', 'g') AS formed FROM customer""")
def mask_names(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", masking.show_first(c, 2).alias("first_two"), masking.show_last(c, 3).alias("last_three"), masking.mask_middle(c).alias("middle"),
        masking.mask_all(c).alias("every"), masking.keep_format(c).alias("formed"),
    )


@query("SELECT o_orderkey, CASE WHEN a >= 90 THEN '90+' ELSE (a // 10 * 10)::VARCHAR || '-' || (a // 10 * 10 + 9)::VARCHAR END AS bucket FROM (SELECT o_orderkey, (o_orderkey % 120)::INT AS a FROM orders)")
def age_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", masking.age_bucket((F.col("o_orderkey") % 120).cast("int")).alias("bucket"))


# ---- anonymization


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, {pattern('email')}, '<email>', 'g'), {pattern('ip_address')}, '<ip_address>', 'g')) AS anonymized,
(len(regexp_extract_all(text, {pattern('email')})) + len(regexp_extract_all(text, {pattern('ip_address')})))::INT AS n_items FROM documents""")
def anonymize_replace(spark, sf_dir):
    detections = F.transform(
        detect.find_all(F.col("text"), ["email", "ip_address"]),
        lambda s: F.struct(s["identifier_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")),
    )
    docs = documents(spark, sf_dir).select("doc_id", "text", detections.alias("detections"))
    return anon.anonymize_frame(docs, "text", "detections").select("doc_id", F.sha2("anonymized.text", 256).alias("anonymized"), F.size("anonymized.items").alias("n_items"))


def _synthetic_spans(spark, sf_dir) -> DataFrame:
    """Overlapping detections made from the line items of an order, over a text of 60 letters."""
    items = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 50).cast("int")
    span = F.struct(
        F.concat(F.lit("T"), (F.col("l_linenumber") % 3).cast("string")).alias("entity_type"), start.alias("start"),
        (start + 1 + (F.col("l_suppkey") % 9)).cast("int").alias("end"), ((F.col("l_linenumber") % 4) / 4.0).alias("score"),
    )
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span)).alias("spans")).withColumn("text", F.repeat(F.lit("abcdefghij"), F.lit(6)))


@query()
def anonymize_conflicts(spark, sf_dir):
    """The three conflict strategies over the same overlapping detections."""
    made = _synthetic_spans(spark, sf_dir)
    return made.select("l_orderkey", *[anon.anonymize(F.col("text"), F.col("spans"), {"T1": anon.Operator("redact")}, s, items=False).alias(s) for s in anon.STRATEGIES])


@query("SELECT event_id, 'sha256:' || sha256('sixteen-byte-salt' || user_id::VARCHAR) AS pseudonym FROM events")
def pseudonymize_user(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tokens.tagged_hash(F.col("user_id").cast("string"), salt="sixteen-byte-salt").alias("pseudonym"))


_HMAC_KEY = b"a key of the test tables"
_PADDED = {mask: "".join(f"\\x{b ^ mask:02X}" for b in _HMAC_KEY.ljust(64, b"\0")) for mask in (0x36, 0x5C)}


@query(f"""SELECT c_custkey, 'hmac-sha256:' || sha256('{_PADDED[0x5C]}'::BLOB || unhex(sha256('{_PADDED[0x36]}'::BLOB || encode(c_name)))) AS pseudonym FROM customer""")
def hmac_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tokens.tagged_hash(F.col("c_name"), "hmac-sha256", _HMAC_KEY.decode()).alias("pseudonym"))


@query("SELECT c_custkey, c_name AS decrypted, TRUE AS stable FROM customer")
def encrypt_round_trip(spark, sf_dir):
    kind = F.lit("name")
    sealed = tokens.encrypt(F.col("c_name"), "key", kind, deterministic=True)
    return table(spark, sf_dir, "customer").select("c_custkey", tokens.decrypt(sealed, "key", kind).alias("decrypted"), (sealed == tokens.encrypt(F.col("c_name"), "key", kind, deterministic=True)).alias("stable"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE '***' || right(json_extract_string(props, '$.k'), 1) END AS k FROM events")
def json_props_anonymize(spark, sf_dir):
    op = anon.Operator("custom", {"function": lambda v, kind: F.concat(F.lit("***"), F.right(v, F.lit(1)))})
    return table(spark, sf_dir, "events").select("event_id", F.element_at(anon.anonymize_record(F.col("props"), {"k": op}), "k").alias("k"))


@query("""SELECT c_custkey, left(c_name, 3) || repeat('#', greatest(length(c_name) - 3, 0)) AS name, c_mktsegment AS tag, 'sha256:' || sha256(c_mktsegment) AS code, c_name AS back FROM customer""")
def nested_record(spark, sf_dir):
    """Fields of a nested record by dotted path: masked, kept, hashed, and one encrypted and turned back."""
    made = F.struct(F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags")).alias("user"), F.create_map(F.lit("code"), F.col("c_mktsegment"), F.lit("raw"), F.col("c_mktsegment")).alias("props"), F.col("c_name").alias("sealed"))
    df = table(spark, sf_dir, "customer").select("c_custkey", made.alias("r"))
    kind, sealed = df.schema["r"].dataType, {"sealed": anon.Operator("encrypt", {"key": "key"})}
    rest = {"user.name": anon.Operator("custom", {"function": lambda v, k: F.concat(F.left(v, F.lit(3)), F.repeat(F.lit("#"), F.greatest(F.length(v) - 3, F.lit(0))))}), "props.code": anon.Operator("hash")}
    df = df.withColumn("r", anon.anonymize_nested(F.col("r"), kind, rest | sealed)).withColumn("r", anon.deanonymize_nested(F.col("r"), kind, sealed, strict=True))
    return df.select("c_custkey", F.col("r.user.name"), F.get(F.col("r.user.tags"), F.lit(0)).alias("tag"), F.element_at("r.props", "code").alias("code"), F.col("r.sealed").alias("back"))


@query("""SELECT o_orderkey, born, CASE WHEN born IS NULL THEN NULL ELSE 2024 - year(born) - (month(born) * 100 + day(born) > 630)::INT END AS age FROM (
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN CASE WHEN day(d) > 12 THEN d ELSE make_date(year(d), day(d), month(d)) END WHEN 3 THEN NULL ELSE d END AS born FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders))""")
def birthdates(spark, sf_dir):
    """Dates in three forms and one that no calendar has, read back, with the age of one born then."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, " M/d/yyyy ")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.concat(F.lit("02/30/"), F.year(d)))
    born = table(spark, sf_dir, "orders").select("o_orderkey", dates.birthdate(written).alias("born"))
    return born.select("o_orderkey", "born", dates.age_at(F.col("born"), F.lit("2024-06-30").cast("date")).alias("age"))


_PLAIN_TYPES = ("email", "mac_address", "uuid", "jwt")


@query(f"""SELECT lang, count(*) AS total_scans, sum(n)::BIGINT AS total_found, count(*) FILTER (n > 0) AS texts_with_any, count(*) FILTER (n > 0) / count(*) AS share
FROM (SELECT lang, {" + ".join(f"coalesce(regexp_matches(text, {pattern(n)}), FALSE)::INT" for n in _PLAIN_TYPES)} AS n FROM documents) GROUP BY lang""")
def scan_statistics(spark, sf_dir):
    found = F.array_compact(F.array(*[F.when(detect.present(F.col("text"), n), n) for n in _PLAIN_TYPES]))
    return spans.scan_stats(documents(spark, sf_dir).select("lang", found.alias("pii_types")), by=["lang"])


@query("""SELECT c_custkey, 'CUSTOMER_NAME_' || left(sha256(CASE WHEN c_custkey % 3 = 0 THEN 'older' ELSE 'secret' END || chr(31) || 's' || c_nationkey::VARCHAR || chr(31) || 'customer_name' || chr(31) || c_name), 16) AS token FROM customer""")
def vault_tokens(spark, sf_dir):
    """A third of the values are in the vault already, under tokens of an older secret, and keep them."""
    values = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("session_id"), F.lit("customer_name").alias("entity_type"), F.col("c_name").alias("original"))
    known = vault.entries(values.where("c_custkey % 3 = 0"), "older")
    return vault.get_or_put(known, values, "secret")[0].select("c_custkey", "token")


# ---- scores


@query(f"""WITH m AS ({_found_sql(HEX_SECRET)}), c AS (SELECT doc_id, matched_text, unnest(string_split(matched_text, '')) AS ch FROM (SELECT DISTINCT * FROM m)),
n AS (SELECT doc_id, matched_text, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT doc_id, matched_text, round(-sum((k / 40.0) * log2(k / 40.0)), 6) AS entropy FROM n GROUP BY ALL""")
def entropy_secrets(spark, sf_dir):
    return find_hex_secret(spark, sf_dir).distinct().withColumn("entropy", F.round(entropy.shannon(F.col("matched_text")), 6))


@query("SELECT conv_id, turn, len(list_distinct(string_split(text, '')))::INT AS n_unique FROM conversations WHERE length(text) > 0")
def text_char_diversity(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.length("text") > 0).select("conv_id", "turn", entropy.diversity(F.col("text"))["unique"].alias("n_unique"))


@query()
def entropy_words(spark, sf_dir):
    """High-entropy words of every document."""
    docs = documents(spark, sf_dir).where(F.col("text").rlike(r"\S{20,}"))
    return docs.select("doc_id", F.explode(entropy.high_entropy_words(F.col("text"))).alias("word"))


@query(f"""WITH m AS (SELECT doc_id, text, string_split_regex(text, {quoted(HEX_SECRET)}) AS gaps, regexp_extract_all(text, {quoted(HEX_SECRET)}) AS ms FROM documents),
e AS (SELECT doc_id, text, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, text, ms[i] AS matched_text, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + 40 * (i - 1))::BIGINT AS st FROM e)
SELECT doc_id, st::INT AS start, CASE WHEN len(list_filter([{', '.join(repr(w) for w in context.KEYWORDS['api_key'])}], lambda w: contains(lower(substr(text, greatest(st - 100, 0) + 1, st + 140 - greatest(st - 100, 0))), w))) > 0 THEN 0.85 ELSE 0.5 END::DOUBLE AS score FROM s""")
def context_boost(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", "text", F.inline(detect.raw_spans(F.col("text"), HEX_SECRET)))
    return found.select("doc_id", "start", context.score(F.col("text"), F.col("start"), F.col("end"), "api_key").cast("double").alias("score"))


def _offsets_sql(name: str, p: str) -> str:
    return f"""(WITH m AS (SELECT doc_id, text, string_split_regex(text, {quoted(p)}) AS gaps, regexp_extract_all(text, {quoted(p)}) AS ms FROM documents),
e AS (SELECT doc_id, text, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM m),
o AS (SELECT doc_id, text, ms[i] AS m, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS st FROM e)
SELECT doc_id, text, '{name}' AS kind, m, st, length(m)::INT AS n FROM o)"""


def _pairs_sql(kinds) -> str:
    """Pairs of spans at most 500 characters and five line breaks apart."""
    between = "substr(a.text, a.st + a.n + 1, greatest(0, b.st - a.st - a.n))"
    return f"""SELECT a.doc_id, a.kind AS primary_type, a.m AS x, a.st AS primary_start, b.kind AS secondary_type, b.m AS y, b.st AS secondary_start, greatest(0, b.st - a.st - a.n)::INT AS gap
FROM s a JOIN s b ON a.doc_id = b.doc_id AND (a.st, a.st + a.n, a.kind) < (b.st, b.st + b.n, b.kind) AND b.st - a.st - a.n <= 500 WHERE length({between}) - length(replace({between}, chr(10), '')) <= 5"""


def _spans_sql(kinds) -> str:
    return f"s AS ({' UNION ALL '.join(_offsets_sql(n, _all(n)) for n in kinds)})"


@query(f"WITH {_spans_sql(_KINDS)} SELECT doc_id, primary_type, primary_start, secondary_type, secondary_start, gap FROM ({_pairs_sql(_KINDS)})")
def proximity_pairs(spark, sf_dir):
    found = spans.spans_table(documents(spark, sf_dir), _KINDS, lines=True)
    return correlate.proximate_pairs(found).select(
        "doc_id", F.col("primary_identifier_type").alias("primary_type"), "primary_start", F.col("secondary_identifier_type").alias("secondary_type"), "secondary_start", F.col("gap").cast("int").alias("gap")
    )


_PAIRED = ("email", "password", "api_key", "jwt", "url", "uuid", "aws_access_key")
_KEY = "IN ('api_key')"
_ORDERED = lambda a, x, b, y: f"""CASE WHEN {a} = 'aws_access_key' AND {b} {_KEY} AND regexp_full_match(trim({y}), '[A-Za-z0-9+/=]{{40}}') THEN 'aws_key_pair'
WHEN {a} {_KEY} AND {b} {_KEY} AND regexp_full_match(trim({x}), 'AC[0-9a-fA-F]{{32}}') AND regexp_full_match(trim({y}), '[0-9a-fA-F]{{32}}') THEN 'twilio_pair'
WHEN ({a} = 'jwt' AND {b} IN ('jwt', 'api_key')) OR ({a} {_KEY} AND {b} = 'jwt') THEN 'token_pair'
WHEN {a} {_KEY} AND {b} {_KEY} AND ((regexp_matches(lower({x}), '^pk_|^pub_|public') AND regexp_matches(lower({y}), '^sk_|^sec_|private|secret')) OR (regexp_matches(lower({x}), '^sk_|^sec_|private|secret') AND regexp_matches(lower({y}), '^pk_|^pub_|public'))) THEN 'key_pair'
WHEN {a} IN ('url', 'domain') AND {b} IN ('api_key', 'password') AND regexp_matches(lower({x}), 'oauth|client|authorize|token|auth0|okta') THEN 'oauth_client_pair'
WHEN {a} IN ('username', 'email') AND {b} = 'password' THEN 'username_password_pair' WHEN {a} = 'uuid' AND {b} IN ('api_key', 'password') THEN 'azure_service_principal' END"""  # noqa: E731


@query(f"""WITH {_texts_sql(_PAIR_TEXTS)}, """ + f"""{_spans_sql(_PAIRED)}, p AS (SELECT *, coalesce({_ORDERED('primary_type', 'x', 'secondary_type', 'y')}, {_ORDERED('secondary_type', 'y', 'primary_type', 'x')}) AS pair_type FROM ({_pairs_sql(_PAIRED)}))
SELECT doc_id, pair_type, x AS primary_text, y AS secondary_text, gap FROM p WHERE pair_type IS NOT NULL""".replace("documents", "texts"))
def credential_pairs(spark, sf_dir):
    found = spans.spans_table(_texts(spark, sf_dir, _PAIR_TEXTS), _PAIRED, lines=True)
    return correlate.credential_pairs(correlate.proximate_pairs(found)).select(
        "doc_id", "pair_type", F.col("primary_matched_text").alias("primary_text"), F.col("secondary_matched_text").alias("secondary_text"), F.col("gap").cast("int").alias("gap")
    )


_WORDS = {"article": ("the", "la", "der"), "pair": ("in the", "de la", "in der")}
_LONGEST = max(len(phrase.split()) for phrases in words.LEXICON.values() for phrase in phrases)
_PHRASES_SQL = """WITH w AS (SELECT {key} AS k, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table}), e AS (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT k, i, ws[i] AS first, lower(array_to_string(ws[i:i + n - 1], ' ')) AS phrase FROM e, range(1, """ + str(_LONGEST + 1) + """) AS s(n) WHERE i + n - 1 <= len(ws))"""


@query(_PHRASES_SQL.format(key="conv_id", table="conversations") + "\nSELECT phrase, count(*)::BIGINT AS n FROM p WHERE phrase IN ('the', 'la', 'der', 'in the', 'de la', 'in der') GROUP BY phrase")
def lexicon_hits(spark, sf_dir):
    found = lexicon.hits(table(spark, sf_dir, "conversations"), lexicon.table(spark, _WORDS), "conv_id")
    return found.groupBy("phrase").agg(F.count("*").alias("n"))


_PLACES = ", ".join(f"('{phrase}', '{kind}', '{'low' if phrase in words.AMBIGUOUS else 'medium'}')" for kind, phrases in words.LEXICON.items() for phrase in phrases)


@query(_PHRASES_SQL.format(key="doc_id", table="documents") + f"\nSELECT k AS doc_id, i::INT - 1 AS position, phrase, kind, confidence FROM p JOIN (VALUES {_PLACES}) AS l(phrase, kind, confidence) USING (phrase) WHERE confidence <> 'low' OR regexp_matches(first, '^\\p{{Lu}}')")
def lexicon_documents(spark, sf_dir):
    return lexicon.hits(documents(spark, sf_dir), lexicon.table(spark))


# ---- audit

_EVENTS_SQL = """SELECT event_id, ts, user_id, event_type, value,
CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'info' WHEN 'purchase' THEN 'warning' WHEN 'error' THEN 'error' ELSE 'info' END AS severity FROM events"""
_RANK_SQL = "CASE severity WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 END"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", audit.default_severity(F.col("event_type")).alias("severity"))


@query(f"SELECT event_id, ts, event_type, severity FROM ({_EVENTS_SQL}) WHERE event_type IN ('purchase', 'error') AND {_RANK_SQL} >= 2 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def audit_filter_page(spark, sf_dir):
    q = audit.AuditQuery(event_types=("purchase", "error"), min_severity="warning").page(40, 20)
    return q.run(_events(spark, sf_dir), "ts", "event_id").select("event_id", "ts", "event_type", "severity")


@query(f"SELECT severity, count(*)::BIGINT AS n FROM ({_EVENTS_SQL}) WHERE {_RANK_SQL} >= 1 GROUP BY severity")
def audit_count(spark, sf_dir):
    return audit.AuditQuery(min_severity="info").filtered(_events(spark, sf_dir), "ts").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, severity FROM ({_EVENTS_SQL}) WHERE {_RANK_SQL} >= 3")
def audit_min_severity(spark, sf_dir):
    return audit.AuditQuery(min_severity="error").filtered(_events(spark, sf_dir), "ts").select("event_id", "severity")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def audit_time_range(spark, sf_dir):
    return audit.AuditQuery(since=datetime(2024, 1, 10), until=datetime(2024, 1, 20)).filtered(_events(spark, sf_dir), "ts").select("event_id", "ts")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def audit_last_days(spark, sf_dir):
    return audit.AuditQuery.last_days(7, datetime(2024, 1, 31)).filtered(_events(spark, sf_dir), "ts").select("event_id", "ts", "event_type")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 7")
def audit_by_user(spark, sf_dir):
    return audit.AuditQuery.by_user(7).run(_events(spark, sf_dir), "ts", "event_id").select("event_id", "ts", "event_type")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_recent(spark, sf_dir):
    return audit.recent(_events(spark, sf_dir), 50, "ts", "event_id").select("event_id", "ts")


@query("""SELECT event_id, user_id, n AS n_failures, n >= 2 AS locked FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events WHERE event_type = 'error')""")
def lockout_window(spark, sf_dir):
    return audit.failures_in_window(_events(spark, sf_dir), F.col("event_type") == "error", 86_400, 2).select("event_id", "user_id", "n_failures", "locked")


# ---- metrics


@query("""SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
""" + ", ".join(f"list_sort(list(value))[(floor((count(value) - 1) * {p}::DOUBLE) + 1)::INT] AS {name}" for name, p in metrics.PERCENTILES) + " FROM events WHERE value IS NOT NULL GROUP BY event_type")
def metric_histogram(spark, sf_dir):
    h = metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value")
    return h.withColumn("sum", F.round("sum", 4)).withColumn("mean", F.round("mean", 6))


@query("""SELECT event_type, round(sum(value), 4) AS total, count(*)::BIGINT AS n, round(sum(value) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS per_second FROM events GROUP BY event_type""")
def metric_counter_rate(spark, sf_dir):
    c = metrics.counter(table(spark, sf_dir, "events"), ["event_type"], "value", "ts")
    return c.withColumn("total", F.round("total", 4)).withColumn("per_second", F.round("per_second", 9))


@query("SELECT event_type, arg_max(value, {'ts': ts, 'id': event_id}) AS last, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def metric_gauge_last_min_max(spark, sf_dir):
    return metrics.gauge(table(spark, sf_dir, "events"), ["event_type"], "value", "ts", "event_id")


_STATE = "CASE WHEN value > 90 THEN 'critical' WHEN value > 60 THEN 'warning' ELSE 'normal' END"
_LIMITS = metrics.Threshold(60, 90, cooldown_s=86_400)


@query(f"""SELECT * FROM (SELECT event_id, event_type, {_STATE} AS state, coalesce(lag({_STATE}) OVER (PARTITION BY event_type ORDER BY ts, event_id), 'normal') AS previous_state FROM events) WHERE state <> previous_state""")
def threshold_transitions(spark, sf_dir):
    return metrics.transitions(table(spark, sf_dir, "events"), ["event_type"], "value", "ts", "event_id", _LIMITS).select("event_id", "event_type", "state", "previous_state")


@query(f"""WITH RECURSIVE r AS (SELECT event_id, event_type, epoch_us(ts) AS us, {_STATE} AS state, coalesce(lag({_STATE}) OVER w, 'normal') AS previous_state, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
t AS (SELECT event_type, 0::BIGINT AS i, NULL::BIGINT AS told, 0::BIGINT AS event_id, 'normal' AS state, 'normal' AS previous_state, NULL::VARCHAR AS kind FROM (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT event_type, i, CASE WHEN kind = 'alert' THEN us ELSE told END, event_id, state, previous_state, kind FROM (
SELECT r.*, t.told, CASE WHEN r.state = 'normal' THEN CASE WHEN r.previous_state <> 'normal' THEN 'recovery' END WHEN r.state <> r.previous_state OR t.told IS NULL OR r.us - t.told >= 86400000000 THEN 'alert' END AS kind
FROM t JOIN r ON r.event_type = t.event_type AND r.i = t.i + 1))
SELECT event_id, event_type, previous_state, state, kind FROM t WHERE kind IS NOT NULL""")
def threshold_alerts(spark, sf_dir):
    return metrics.alerts(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id", _LIMITS).select("event_id", "event_type", "previous_state", "state", "kind")


@query("""WITH t AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0::DOUBLE AS ms FROM events)
SELECT event_type, count(*)::BIGINT AS n, round(avg(ms), 4) AS mean, min(ms) AS min, max(ms) AS max, """ + ", ".join(f"list_sort(list(ms))[(floor((count(ms) - 1) * {p}::DOUBLE) + 1)::INT] AS {name}" for name, p in metrics.PERCENTILES) + " FROM t WHERE ms >= 0 GROUP BY event_type")
def metric_timer(spark, sf_dir):
    """Milliseconds since the user's event before, by type."""
    timed = metrics.with_previous(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["ts"], 7 * 86_400)
    return metrics.timer(timed.where(F.col("previous_ts").isNotNull()), ["event_type"], "previous_ts", "ts").drop("sum").withColumn("mean", F.round("mean", 4))


@query("""SELECT event_id, round(CASE WHEN s > 0 THEN d / s END, 6) AS rate FROM (SELECT event_id, value - lag(value) OVER w AS d, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))""")
def threshold_rate(spark, sf_dir):
    r = metrics.rate_of_change(table(spark, sf_dir, "events"), ["event_type"], "value", "ts", "event_id")
    return r.select("event_id", F.round("rate", 6).alias("rate"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS n_recent FROM events""")
def rate_limit_window(spark, sf_dir):
    return windows.trailing_counts(table(spark, sf_dir, "events"), "user_id", "ts", 3600, "n_recent").select("event_id", "user_id", "n_recent")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    w = F.window("ts", "1 day")
    return table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""")
def session_counts(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600)


@query("""SELECT '# TYPE events_total counter' AS line UNION ALL SELECT 'events_total{event_type="' || event_type || '"} ' || count(*)::VARCHAR FROM events GROUP BY event_type""")
def metric_prometheus(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return metrics.prometheus(counts, "events_total", "n", ["event_type"], "counter")


# ---- threats, urls, text

_URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


@query(f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, {quoted(_URL_HOST)}, 1)) AS host,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", network.scheme(u).alias("scheme"), network.host(u).alias("host"), network.path(u).alias("path"), network.query(u).alias("query"), network.fragment(u).alias("fragment"))


def _ip_case() -> str:
    n = "a * 16777216 + b * 65536 + c * 256 + d"
    cases = " ".join(f"WHEN {n} BETWEEN {network._number(base)} AND {network._number(base) + 2 ** (32 - bits) - 1} THEN '{name}'" for name, base, bits in network.BLOCKS)
    return f"CASE {cases} ELSE 'public' END"


@query(f"""SELECT ip_class, count(*)::BIGINT AS n FROM (SELECT {_ip_case()} AS ip_class FROM (SELECT (o_orderkey * 2654435761) % 256 AS a, (o_orderkey * 40503) % 256 AS b, o_custkey % 256 AS c, o_orderkey % 256 AS d FROM orders)) GROUP BY ip_class""")
def host_private(spark, sf_dir):
    part = lambda e: F.expr(e).cast("string")
    ip = F.concat_ws(".", part("(o_orderkey * 2654435761) % 256"), part("(o_orderkey * 40503) % 256"), part("o_custkey % 256"), part("o_orderkey % 256"))
    return table(spark, sf_dir, "orders").select(network.ip_class(ip).alias("ip_class")).groupBy("ip_class").agg(F.count("*").alias("n"))


# Urls made from the pages' own: what follows "://" stays, before it comes a host, scheme or user that is dangerous, or nearly so.
_HOSTS = ("example.com", "169.254.169.254", "localhost", "2130706433", "a.nip.io", "10.1.2.3", "0x7f000001", "127.0.0.1", "nip.io.example.com", "172.32.0.1", "db.internal", "100.100.100.200", "8.8.8.8", "[fd00:ec2::254]", "01.2.3.4")
_URLS = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'http://' || {host} || '/' || page_id WHEN 2 THEN 'https://user:word@' || {host} || '/' ELSE {scheme} || '://' || {host} || ':80/x@y' END"
_SCHEMES = ("https", "file", "gopher", "ftp", "ws")
_PART = lambda i: f"try_cast(split_part(h, '.', {i}) AS BIGINT)"
_IN = lambda names: "(" + ", ".join(quoted(n) for n in names) + ")"


def _ssrf_sql(url: str) -> str:
    return f"""WITH u AS (SELECT page_id, {url} AS url FROM pages),
k AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)) AS h FROM u),
i AS (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AND greatest(a, b, c, d) <= 255 THEN {_ip_case()} END AS kind FROM (SELECT *, {_PART(1)} AS a, {_PART(2)} AS b, {_PART(3)} AS c, {_PART(4)} AS d FROM k))
SELECT page_id, coalesce(array_to_string(list_filter([CASE WHEN h IN {_IN(network.METADATA_HOSTS)} THEN 'cloud_metadata' END,
CASE WHEN coalesce(kind IN ('loopback', 'private', 'link_local', 'shared', 'unspecified'), FALSE) OR regexp_matches(h, '^\\[?(?:::1|::|f[cd][0-9a-f]{{2}}:|fe80:)') OR h IN ('localhost', 'localhost.localdomain') OR regexp_matches(h, '\\.(?:local|internal|intranet|corp|lan|localhost)$') THEN 'internal_host' END,
CASE WHEN regexp_matches(h, '^(?:[0-9]{{8,10}}|0x[0-9a-f]{{8}}|(?:0[0-7]{{1,3}}|0x[0-9a-f]{{1,2}})(?:\\.(?:0[0-7]{{1,3}}|0x[0-9a-f]{{1,2}}|[0-9]{{1,3}})){{3}})$') THEN 'encoded_ip' END,
CASE WHEN {' OR '.join(f"h = '{n}' OR ends_with(h, '.{n}')" for n in network.REBINDING)} THEN 'dns_rebinding' END,
CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN {_IN(network.DANGEROUS_SCHEMES)} THEN 'dangerous_scheme' END,
CASE WHEN regexp_matches(url, '://[^/?#]*@') THEN 'credentials' END], lambda x: x IS NOT NULL), ','), '') AS threats FROM i"""


@query(_ssrf_sql("url"))
def ssrf_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(network.ssrf_threats(F.col("url")), ",").alias("threats"))


@query(_ssrf_sql(_URLS.format(host=f"[{', '.join(map(quoted, _HOSTS))}][page_id % {len(_HOSTS)} + 1]", scheme=f"[{', '.join(map(quoted, _SCHEMES))}][page_id % {len(_SCHEMES)} + 1]")))
def ssrf_made_urls(spark, sf_dir):
    pick = lambda names: f"element_at(array({', '.join(map(quoted, names))}), CAST(page_id % {len(names)} + 1 AS INT))"
    made = table(spark, sf_dir, "pages").select("page_id", F.expr(_URLS.format(host=pick(_HOSTS), scheme=pick(_SCHEMES))).alias("url"))
    return made.select("page_id", F.array_join(network.ssrf_threats(F.col("url")), ",").alias("threats"))


def _any_sql(col: str, patterns: dict[str, str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {quoted(p)})" for p in patterns.values()) + ")"


_K = f"regexp_matches(text, {quoted(threats.SQL_KEYWORD)})"
_Q = f"regexp_matches(text, {quoted(threats.SQL_QUOTE)})"
_SQLI = f"({_any_sql('text', threats.SQL)} OR ((regexp_matches(text, {quoted(threats.SQL_HEX)}) OR regexp_matches(text, {quoted(threats.SQL_CHAR)})) AND {_K}) OR ({_Q} AND (regexp_matches(text, {quoted(threats.SQL_COMMENT)}) OR {_K})))"


@query(f"SELECT doc_id, {_SQLI} AS sqli FROM documents")
def threat_sqli(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", threats.is_sql_injection(F.col("text")).alias("sqli"))


@query(f"SELECT conv_id, turn, {_any_sql('text', threats.SHELL)} AS shell, {_any_sql('text', threats.NOSQL)} AS nosql, {_any_sql('text', threats.XSS)} AS xss FROM conversations")
def threat_shell(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", threats.is_command_injection(t).alias("shell"), threats.is_nosql_injection(t).alias("nosql"), threats.is_xss(t).alias("xss"))


@query(f"SELECT page_id, (regexp_matches(url, {quoted(threats.PATH['traversal'])}) OR regexp_matches(url, {quoted(threats.PATH['encoded_traversal'])})) AS traversal FROM pages")
def threat_path_traversal(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", threats.is_path_traversal(F.col("url")).alias("traversal"))


@query(f"SELECT conv_id, turn, regexp_replace(text, {quoted(text.CONTROL)}, '', 'g') AS stripped FROM conversations")
def text_control_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_control(F.col("text")).alias("stripped"))


@query("""SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS line FROM conversations""")
def text_log_escape(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.log_line(F.col("text"), max_chars=None).alias("line"))


@query("""SELECT page_id, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END AS route FROM (
SELECT page_id, regexp_replace(regexp_replace('/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/[0-9]+(/|$)', '/{id}\\1', 'g') AS p FROM pages)""")
def url_routes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", network.normalize_path(network.path(F.col("url"))).alias("route"))


@query("""SELECT p_partkey, p_name || '.' || CASE p_size % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'PY' ELSE 'pem' END AS name,
CASE p_size % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'gz' WHEN 2 THEN 'py' ELSE 'pem' END AS extension, CASE p_size % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'archive' WHEN 2 THEN 'code' ELSE 'credential' END AS category FROM part""")
def path_names(spark, sf_dir):
    path = F.expr("concat('/srv/files/', p_name, '.', CASE p_size % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'PY' ELSE 'pem' END)")
    return table(spark, sf_dir, "part").select("p_partkey", files.name(path).alias("name"), files.extension(path).alias("extension"), files.category(path).alias("category"))


_COORDS = "(n_nationkey * 7 % 90)::DOUBLE AS lat, (n_nationkey * 13 % 180)::DOUBLE AS lon"


@query(f"""SELECT a.n_nationkey AS first, b.n_nationkey AS second, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (
SELECT a.n_nationkey, b.n_nationkey, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2 AS h
FROM (SELECT n_nationkey, n_regionkey, {_COORDS} FROM nation) a JOIN (SELECT n_nationkey, n_regionkey, {_COORDS} FROM nation) b ON a.n_nationkey + 1 = b.n_nationkey) x(a, b, h), LATERAL (SELECT x.a AS n_nationkey) a, LATERAL (SELECT x.b AS n_nationkey) b""")
def geo_haversine(spark, sf_dir):
    at = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 7 % 90).cast("double").alias("lat"), (F.col("n_nationkey") * 13 % 180).cast("double").alias("lon"))
    a, b = at.alias("a"), at.alias("b")
    km = network.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return a.join(b, F.col("a.n_nationkey") + 1 == F.col("b.n_nationkey")).select(F.col("a.n_nationkey").alias("first"), F.col("b.n_nationkey").alias("second"), F.round(km, 4).alias("km"))


# ---- checksums over numbers made from keys


def _weights_sql(v: str, weights, first: int = 1) -> str:
    return " + ".join(f"substr({v}, {first + i}, 1)::INT * {w}" for i, w in enumerate(weights))


_NUMBER = "lpad(((o_orderkey * 7919 + o_custkey * 104729) % 100000000000)::VARCHAR, 11, '0')"
_ELEVEN = {
    "pesel": f"(10 - ({_weights_sql('v', (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))}) % 10) % 10 = substr(v, 11, 1)::INT",
    "abn": f"({_weights_sql('v', (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0",
    "cpf": f"(CASE WHEN ({_weights_sql('v', range(10, 1, -1))}) % 11 < 2 THEN 0 ELSE 11 - ({_weights_sql('v', range(10, 1, -1))}) % 11 END) = substr(v, 10, 1)::INT AND (CASE WHEN ({_weights_sql('v', range(11, 1, -1))}) % 11 < 2 THEN 0 ELSE 11 - ({_weights_sql('v', range(11, 1, -1))}) % 11 END) = substr(v, 11, 1)::INT",
    "tckn": f"v[1] <> '0' AND (((({_weights_sql('v', (1, 0, 1, 0, 1, 0, 1, 0, 1))}) * 7 - ({_weights_sql('v', (0, 1, 0, 1, 0, 1, 0, 1))})) % 10) + 10) % 10 = substr(v, 10, 1)::INT AND ({_weights_sql('v', (1,) * 10)}) % 10 = substr(v, 11, 1)::INT",
    "luhn": LUHN_SQL.format(v="v"),
}


@query(f"SELECT {', '.join(f'sum(({e})::INT)::BIGINT AS {n}' for n, e in _ELEVEN.items())}, count(*)::BIGINT AS n FROM (SELECT {_NUMBER} AS v FROM orders)")
def checksum_eleven_digits(spark, sf_dir):
    v = F.lpad(F.expr("cast((o_orderkey * 7919 + o_custkey * 104729) % 100000000000 as string)"), 11, "0")
    made = table(spark, sf_dir, "orders").select(v.alias("v"))
    return made.agg(*[F.sum(checksums.VALIDATORS[n](F.col("v")).cast("int")).alias(n) for n in _ELEVEN], F.count("*").alias("n"))


_NINE = {
    "aba": f"({_weights_sql('v', (3, 7, 1, 3, 7, 1, 3, 7, 1))}) % 10 = 0 AND v <> '000000000' AND (left(v, 2)::INT BETWEEN 0 AND 12 OR left(v, 2)::INT BETWEEN 21 AND 32 OR left(v, 2)::INT BETWEEN 61 AND 72 OR left(v, 2) = '80')",
    "ssn": "left(v, 3) NOT IN ('000', '666') AND v[1] <> '9' AND substr(v, 4, 2) <> '00' AND substr(v, 6, 4) <> '0000' AND v NOT IN ('123456789', '078051120', '219099999')",
    "tfn": f"({_weights_sql('v', (1, 4, 3, 7, 5, 8, 6, 9, 10))}) % 11 = 0",
    "acn": f"(10 - ({_weights_sql('v', (8, 7, 6, 5, 4, 3, 2, 1))}) % 10) % 10 = substr(v, 9, 1)::INT",
}


@query(f"SELECT {', '.join(f'sum(({e})::INT)::BIGINT AS {n}' for n, e in _NINE.items())}, count(*)::BIGINT AS n FROM (SELECT lpad(((o_orderkey * 7919 + o_custkey * 104729) % 1000000000)::VARCHAR, 9, '0') AS v FROM orders)")
def checksum_nine_digits(spark, sf_dir):
    v = F.lpad(F.expr("cast((o_orderkey * 7919 + o_custkey * 104729) % 1000000000 as string)"), 9, "0")
    made = table(spark, sf_dir, "orders").select(v.alias("v"))
    return made.agg(*[F.sum(checksums.VALIDATORS[n](F.col("v")).cast("int")).alias(n) for n in _NINE], F.count("*").alias("n"))


@query(f"""SELECT sum(({LUHN_SQL.format(v="('80840' || v)")})::INT)::BIGINT AS npi, sum((((11 - ({_weights_sql('v', range(10, 1, -1))}) % 11) % 11) <> 10 AND ((11 - ({_weights_sql('v', range(10, 1, -1))}) % 11) % 11) = substr(v, 10, 1)::INT)::INT)::BIGINT AS nhs
FROM (SELECT '1' || lpad(((o_orderkey * 7919) % 1000000000)::VARCHAR, 9, '0') AS v FROM orders)""")
def checksum_ten_digits(spark, sf_dir):
    v = F.concat(F.lit("1"), F.lpad(F.expr("cast((o_orderkey * 7919) % 1000000000 as string)"), 9, "0"))
    return table(spark, sf_dir, "orders").select(v.alias("v")).agg(F.sum(checksums.npi(F.col("v")).cast("int")).alias("npi"), F.sum(checksums.nhs(F.col("v")).cast("int")).alias("nhs"))


@query("""SELECT o_orderkey, (98 - ((num || '131400')::HUGEINT % 97)::INT) = chk AS valid FROM (
SELECT o_orderkey, lpad((o_orderkey * 104729)::VARCHAR, 18, '1') AS num, (o_orderkey % 97 + 2)::INT AS chk FROM orders)""")
def checksum_iban(spark, sf_dir):
    made = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97 + 2).cast("string"), 2, "0"), F.lpad(F.expr("cast(o_orderkey * 104729 as string)"), 18, "1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", checksums.iban(made).alias("valid"))


@query("SELECT doc_id, n > 0 AS jwt FROM (SELECT doc_id, len(regexp_extract_all(text, " + pattern("jwt") + f")) AS n FROM documents)")
def jwt_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", (detect.count(F.col("text"), "jwt") > 0).alias("jwt"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers by language: the flagship report."""
    return pii_by_lang(spark, sf_dir)


# ---- structured texts

_STRUCTURED = f"""CASE c_custkey % 10 WHEN 0 THEN repeat('{{"a":[', c_custkey % 71) || '"]}}"' || repeat(']}}', c_custkey % 13) WHEN 1 THEN '<!DOCTYPE note><note>' || {_A} || '</note>'
WHEN 2 THEN '<!DOCTYPE a [<!ENTITY x' || {_A} || ' SYSTEM "file:///etc/hosts">]><a>&x;</a>' WHEN 3 THEN '<!doctype a [<!ENTITY % p' || {_A} || ' "q">]><a/>' WHEN 4 THEN '<!DOCTYPE a [<!ENTITY a "ha"><!ENTITY b "' || repeat('&a;', c_custkey % 7) || '">]><a>&b;</a>'
WHEN 5 THEN 'run: !!python/object/apply:os.system [' || {_A} || ']' WHEN 6 THEN 'base: &b' || chr(10) || '  k: 1' || chr(10) || 'all:' || chr(10) || repeat('- *b' || chr(10), c_custkey % 17) WHEN 7 THEN '- !!ruby/struct:' || {_A}
WHEN 8 THEN 'plain: ' || {_A} || chr(10) || 'list: [1, 2]' ELSE '{{"id": ' || c_custkey || ', "tags": ["x", "y"]}}' END"""
_JSON, _YAML = structure.JsonPolicy(max_depth=32, max_size=150), structure.YamlPolicy(max_aliases=2)


def _depth_sql(key: str, marks: str, opening: str, closing: str, leaf: str = "''") -> str:
    """Greatest depth by running sums: a closing mark too many lifts the ground."""
    return f"""SELECT {key}, max(depth) AS depth FROM (SELECT {key}, s - least(0, min(s) OVER w) + CAST(leaf AS INT) AS depth FROM (SELECT {key}, i, leaf, sum(d) OVER w AS s FROM
(SELECT {key}, i, c = {leaf} AS leaf, CASE WHEN c IN ({opening}) THEN 1 WHEN c IN ({closing}) THEN -1 ELSE 0 END AS d FROM (SELECT {key}, i, substr(m, i, 1) AS c FROM (SELECT {key}, m, unnest(range(1, length(m) + 1)) AS i FROM ({marks}))))
WINDOW w AS (PARTITION BY {key} ORDER BY i)) WINDOW w AS (PARTITION BY {key} ORDER BY i)) GROUP BY {key}"""


def _format_sql(key: str, rows: str) -> str:
    """`rows` gives the key and a text t."""
    has = lambda p: f"regexp_matches(t, {quoted(p)})"
    n = lambda p: f"len(regexp_extract_all(t, {quoted(p)}))"
    marks = f"SELECT {key}, regexp_replace(t, '[^{{}}\\[\\]]', '', 'g') AS m FROM r"
    return f"""WITH r AS ({rows}), d AS ({_depth_sql(key, marks, "'{', '['", "'}', ']'", 'NULL').replace('+ CAST(leaf AS INT)', '')}),
w AS (SELECT {key}, t, concat_ws(',', CASE WHEN {has(structure.EXTERNAL_ENTITY)} THEN 'xxe_external_entity' END, CASE WHEN {has(structure.PARAMETER_ENTITY)} THEN 'xxe_parameter_entity' END, CASE WHEN {has(structure.ENTITY_EXPANSION)} THEN 'xxe_billion_laughs' END) AS worse FROM r)
SELECT w.{key}, concat_ws(',', CASE WHEN strlen(t) > {_JSON.max_size} THEN 'json_size_exceeded' END, CASE WHEN depth > {_JSON.max_depth} THEN 'json_depth_exceeded' END) AS json,
CASE WHEN worse = '' AND {has(structure.DOCTYPE)} THEN 'dtd_present' ELSE worse END AS xml,
concat_ws(',', CASE WHEN {has('|'.join(structure.UNSAFE_TAGS))} THEN 'yaml_unsafe_tag' END, CASE WHEN {n(structure.ALIAS)} > {_YAML.max_aliases} OR ({n(structure.ANCHOR)} > 0 AND {n(structure.ALIAS)} > 3 * {n(structure.ANCHOR)}) THEN 'yaml_anchor_bomb' END) AS yaml,
worse = '' AND NOT {has(structure.DOCTYPE)} AS xml_safe FROM w LEFT JOIN d ON w.{key} = d.{key}"""


def _format_threats(rows: DataFrame, key: str) -> DataFrame:
    t = F.col("t")
    joined = lambda threats: F.array_join(threats, ",")
    return rows.select(
        key, joined(structure.json_threats(t, _JSON)).alias("json"), joined(structure.xml_threats(t)).alias("xml"), joined(structure.yaml_threats(t, _YAML)).alias("yaml"), structure.xml_safe(t).alias("xml_safe"),
    )


@query(_format_sql("c_custkey", f"SELECT c_custkey, {_STRUCTURED} AS t FROM customer"))
def format_threats(spark, sf_dir):
    return _format_threats(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_STRUCTURED).alias("t")), "c_custkey")


@query(_format_sql("page_id", "SELECT page_id, html AS t FROM pages WHERE html IS NOT NULL"))
def page_format_threats(spark, sf_dir):
    return _format_threats(table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.col("html").alias("t")), "page_id")


# What is no element goes first; then a mark for each tag. The SQL's patterns are plain: it runs over pages without angle brackets in attributes.
_TAGS = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z][^\[<>]*>', '', 'g'), '[\x01-\x03]', '', 'g')"
_QUOTED = """|"[^"]*"|''[^'']*''"""
_MARKS = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_TAGS}, '<[A-Za-z_:](?:[^<>"''/]{_QUOTED}|/+[^/>])*/>', chr(3), 'g'), '</[^<>]*>', chr(2), 'g'), '<[A-Za-z_:](?:[^<>"''/]{_QUOTED}|/+[^/>])*>', chr(1), 'g'), '[^\x01-\x03]', '', 'g')"""


@query(f"""WITH r AS (SELECT page_id, {_MARKS} AS m FROM pages WHERE html IS NOT NULL), d AS ({_depth_sql('page_id', 'SELECT * FROM r', 'chr(1)', 'chr(2)', 'chr(3)')})
SELECT r.page_id, CAST(coalesce(depth, 0) AS INT) AS depth, CAST(length(replace(m, chr(2), '')) AS INT) AS elements FROM r LEFT JOIN d ON r.page_id = d.page_id""")
def page_shape(spark, sf_dir):
    s = structure.xml_shape(F.col("html"))
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", s["depth"].alias("depth"), s["elements"].alias("elements"))


@query()
def format_limits(spark, sf_dir):
    """Limits that the texts break; what entities and anchors expand to has no SQL."""
    t, p = F.col("t"), structure.Limits(max_bytes=400, max_depth=20, max_elements=60, max_expansions=3)
    made = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_STRUCTURED).alias("t"))
    return made.select("c_custkey", *[F.array_join(structure.over_limits(t, kind, p), ",").alias(kind) for kind in structure.SHAPES])
