"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, embeddings, hosts, html, mixing, packing, quality, repetition, sharding, simhash, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return hosts.judge(pages, hosts.page_outcomes(pages, _table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(_table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "base_failed", "kept"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_host_reputation": op1_host_reputation,
        "op2_warc": op2_warc,
        "op3_main_text": op3_main_text,
        "op4_toxicity": op4_toxicity,
        "op5_embeddings": op5_embeddings,
        "op6_simhash": op6_simhash,
        "op7_repetition": op7_repetition,
        "op8_packing": op8_packing,
        "op9_quality": op9_quality,
        "op10_mixing": op10_mixing,
        "op11_clusters": op11_clusters,
        "op12_whitening": op12_whitening,
        "op13_shards": op13_shards,
    }


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
r AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM r
"""


def _host_sql() -> str:
    p = hosts.Params()
    part = lambda col: f"CASE WHEN instr({col}, '://') > 0 THEN substr({col}, instr({col}, '://') + 3) ELSE '' END"
    ranked = sorted(hosts.RULES, key=lambda r: -len(r[1]))
    fits = [(kind, rule, *rule.split("/", 1)) for kind, rule in ranked]
    case = lambda i: "CASE " + " ".join(f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{t}') THEN '{(k, r)[i]}'" for k, r, d, t in fits) + " END"
    seconds = ", ".join(repr(x) for x in hosts.SECOND_LEVEL)
    strength = lambda name, src, by: f"""{name}_sums AS (SELECT sum(n)::DOUBLE AS tn, sum(k)::DOUBLE AS tk, count(*) AS g, sum((n * n)::DOUBLE) AS nn, sum((k * k)::DOUBLE / n) AS kk FROM {src} {'GROUP BY ' + by if by else ''}),
{name}_r AS (SELECT sum((kk - tk * (tk / tn)) / ((tk / tn) * (1 - tk / tn)) - (g - 1)) AS a, sum(tn - nn / tn - (g - 1)) AS b FROM {name}_sums WHERE tk > 0 AND tk < tn AND g > 1),
{name} AS (SELECT CASE WHEN a IS NULL OR b <= 0 OR a <= 0 THEN {p.max_strength!r} ELSE least(greatest(round((1 - least(a / b, 0.999)) / least(a / b, 0.999), 6), {p.min_strength!r}), {p.max_strength!r}) END AS s FROM {name}_r)"""  # noqa: E731
    return f"""
WITH u AS (SELECT page_id, coalesce({part('url')}, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{hosts.UPPER}', '{hosts.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT doc_id, bool_and(coalesce(quality, 0) = 1 AND coalesce(toxic, 0) = 0) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, good FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) AS doc_id FROM p) JOIN m USING (doc_id)),
h0 AS (SELECT host, count(*) AS n, sum(good::INT) AS k, regexp_replace(host, ':[0-9]*$', '') AS nm FROM o GROUP BY host),
h1 AS (SELECT *, regexp_matches(nm, '^[0-9.]+$|^\\[') AS num, CASE WHEN regexp_extract(nm, '([^.]+)\\.[^.][^.]$', 1) IN ({seconds}) THEN 2 ELSE 1 END AS labs, string_split(nm, '.') AS x FROM h0),
hosts AS (SELECT host, n, k, CASE WHEN num THEN nm ELSE array_to_string(x[-(labs + 1):], '.') END AS domain, CASE WHEN num THEN '' ELSE array_to_string(x[-labs:], '.') END AS suffix FROM h1),
doms AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
sufs AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM doms GROUP BY ALL),
{strength('s_suf', 'sufs', '')},
{strength('s_dom', 'doms', 'suffix')},
{strength('s_host', 'hosts', 'suffix, domain')},
w AS (SELECT sum(k)::DOUBLE / sum(n) AS mean FROM hosts),
sm AS (SELECT suffix, (k + s * mean) / (n + s) AS mean FROM sufs, s_suf, w),
dm AS (SELECT suffix, domain, (k + s * mean) / (n + s) AS mean FROM doms JOIN sm USING (suffix), s_dom),
q AS (SELECT host, n, k, k + s * mean AS a, n - k + s * (1 - mean) AS b FROM hosts JOIN dm USING (suffix, domain), s_host),
rep AS (SELECT host, n, round(a / (a + b), 6) AS posterior_mean, round(least(1.0, a / (a + b) + {p.sigmas!r} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))), 6) AS posterior_upper FROM q)
SELECT page_id, p.host, path, {case(1)} AS rule,
  coalesce({case(0)}, CASE WHEN posterior_upper < (SELECT round({p.min_share!r} * mean, 6) FROM w) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n, 0)::BIGINT AS n_labelled, posterior_mean, posterior_upper
FROM p LEFT JOIN rep USING (host)"""


def _repetition_sql() -> str:
    p = repetition.Params()
    k, longer = p.min_words, p.max_repeat + 1
    leads = ", ".join(f"lead(word, {j}) OVER x AS w{j}" for j in range(1, max(3, k)))
    names = lambda n: ", ".join(["word", *(f"w{j}" for j in range(1, n))])
    repeated = lambda n: f"r{n} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, {names(n)}) AS c FROM g WHERE w{n - 1} IS NOT NULL) WHERE c > 1)"
    cover = lambda n: f"c{n} AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r{n}, range(0, {n}) AS s(j) GROUP BY doc_id)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wd AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, word, {leads} FROM wd WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
{repeated(3)}, {cover(3)}, {repeated(k)}, {cover(k)},
rl AS (SELECT r{k}.* FROM r{k} JOIN c{k} USING (doc_id) WHERE n >= {longer}),
pairs AS (SELECT doc_id, a.i, b.i - a.i AS d FROM rl a JOIN rl b USING (doc_id, {names(k)}) WHERE a.i < b.i),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS run FROM pairs) GROUP BY doc_id, d, run HAVING count(*) >= {longer - k + 1}),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{repetition.SYMBOLS}', '')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c{p.min_words}.n, 0)::BIGINT AS n_covered_words, long.doc_id IS NOT NULL AS too_long
  FROM t LEFT JOIN c3 USING (doc_id) LEFT JOIN c{p.min_words} USING (doc_id) LEFT JOIN long USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT base_failed AND n_covered_words <= {p.max_covered!r} * n_words AND NOT too_long AS kept
FROM f"""


def _clusters_sql() -> str:
    """Every vector against every centroid, round by round."""
    p = clustering.Params()
    steps = []
    for r in range(p.rounds + 1):
        steps.append(f"""d{r} AS (SELECT k.id, k.vec_id, k.x, c.cluster, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM k, c{r} c),
a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)""")
        if r < p.rounds:
            steps.append(f"""m{r} AS (SELECT cluster, i, (sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(v::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY cluster) n USING (cluster))""")
    return f"""
WITH k AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: floor({p.scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {p.width} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{p.salt}:' || vec_id) NULLS LAST, x) - 1)::INT AS cluster, x FROM k ORDER BY cluster LIMIT {p.clusters}),
{','.join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{p.rounds} a JOIN c{p.rounds} c USING (cluster)"""


def _shards_sql(shards: int = 40) -> str:
    """All scores of a record side by side; the checksum nibble by nibble."""
    word = lambda s: f"('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '{s // sharding.WORDS}')), {1 + 8 * (s % sharding.WORDS)}, 8))::BIGINT"
    u = ", ".join(f"-ln(({word(s)} + 1) / 4294967296.0::DOUBLE)" for s in range(shards + 1))
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = lambda crc, nibble: f"xor({crc} >> 4, (CAST({table} AS BIGINT[]))[(xor({crc}, {nibble}) & 15) + 1])"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, [{u}] AS u FROM documents),
b AS (SELECT doc_id, (strlen(text) + {sharding.OVERHEAD})::BIGINT AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes,
  list_position(u[1:{shards}], list_min(u[1:{shards}])) - 1 AS shard, list_position(u, list_min(u)) - 1 AS grown_shard FROM t),
r AS (SELECT doc_id, size, shard, grown_shard, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda crc, x: {step('(' + step('crc', 'x') + ')', '(x >> 4)')})) AS text_crc32 FROM b)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_host_reputation": _host_sql(), "op2_warc": WARC_SQL, "op7_repetition": _repetition_sql(), "op11_clusters": _clusters_sql(), "op13_shards": _shards_sql()}
