from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import context, entropy, files, masking, network, text, threats, tokens


def cases(V):
    return [
        (masking.mask_chars(V, 12, "*", True), "4111-1111-1111-1234", "4111-11************"), (masking.mask_chars(V, 3, "XX"), "secret", "XXXXXXret"), (masking.mask_chars(V, 99), "ab", "**"),
        (masking.show_first(V, 2), "ab", "ab"), (masking.show_last(V, 2), "abcd", "**cd"), (masking.keep_format(V), "a-1 é", "*-* *"), (masking.email(V, "show_domain"), "u@h.org", "***@h.org"),
        (masking.age_bucket(V), 42, "40-49"), (masking.age_bucket(V), 95, "90+"), (masking.age_bucket(V), 200, None),
        (entropy.shannon(V), "aabb", 1.0), (entropy.shannon(V), "", 0.0), (entropy.diversity(V)["classes"], "aB3!", 15), (entropy.is_high_entropy(V), "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", True),
        (entropy.is_high_entropy(V), "aaaaaaaaaaaaaaaaaaaaaaaa", False), (entropy.is_high_entropy(V), "123e4567-e89b-12d3-a456-426614174000", False),
        (network.host(V), "http://u:p@Ex.COM:80/x", "ex.com"), (network.port(V), "http://ex.com:8080/x", 8080), (network.ip_class(V), "10.1.2.3", "private"), (network.ip_class(V), "8.8.8.8", "public"),
        (network.ip_class(V), "300.1.1.1", None), (network.ssrf_threats(V), "http://169.254.169.254/latest", ["cloud_metadata", "internal_host"]), (network.ssrf_threats(V), "http://a.nip.io", ["dns_rebinding"]),
        (network.ssrf_threats(V), "https://example.com/", []), (network.mac_normalize(V), "AA-BB-CC-00-11-22", "aa:bb:cc:00:11:22"), (network.normalize_path(V), "//a//12/b/", "/a/{id}/b"),
        (network.path_matches(V, "/a/*/c"), "/a/b/c", True), (network.path_matches(V, "/a/*"), "/a/b/c", False), (network.path_matches(V, "/a/**"), "/a/b/c", True),
        (threats.is_sql_injection(V), "1' OR '1'='1' --", True), (threats.is_sql_injection(V), "plain words", False), (threats.sql_threats(V), "x; DROP TABLE t", ["stacked_query"]),
        (threats.is_nosql_injection(V), '{"$ne": 1}', True), (threats.is_ldap_injection(V), "*)(uid=*", True), (threats.is_command_injection(V), "a; rm -rf /", True), (threats.is_path_traversal(V), "../../etc/passwd", True),
        (threats.is_path_traversal(V), "a..b", False), (threats.is_xss(V), "<script>alert(1)</script>", True), (threats.is_xxe(V), '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc">]>', True),
        (threats.graphql_depth(V), '{ a { b { c } } d }', 3), (threats.sql_literal(V), "o'b", "'o''b'"), (threats.shell_quote(V), "a b", "'a b'"), (threats.ldap_filter_value(V), "a*(b)", "a\\2a\\28b\\29"),
        (threats.html_escape(V), "<a>", "&lt;a&gt;"), (threats.sql_like(V), "50%_", "50\\%\\_"),
        (files.normalize(V), "/a/../b//c/./d", "/b/c/d"), (files.normalize(V), "../a", "../a"), (files.normalize(V), "/../a", "/a"), (files.is_within(V, "/srv"), "../x", False), (files.is_within(V, "/srv"), "a/b", True),
        (files.safe_name(V), "con.txt", "_con.txt"), (files.safe_name(V), "a/b?.txt", "a_b_.txt"), (files.safe_name(V), "..", "unnamed"), (files.extension(V), "/a/.bashrc", ""), (files.stem(V), "x.tar.gz", "x.tar"),
        (files.file_type(V), bytearray(b"\x89PNG\r\n\x1a\n..."), "png"), (files.file_type(V), bytearray(b"PAR1"), "parquet"), (files.file_type(V), bytearray(b"plain"), None),
        (text.strip_ansi(V), "a\x1b[31mb", "ab"), (text.log_line(V), "a\nb\x07", "a\\nb"), (text.truncate(V, 5), "abcdefgh", "ab..."), (text.strip_zero_width(V), "a​b", "ab"), (text.strip_bidi(V), "a‮b", "ab"),
        (text.skeleton(V), "раypal", "paypal"), (text.is_mixed_script(V), "aб", True), (text.normalize(V, "NFD"), "é", "é"), (text.normalize_newlines(V), "a\r\nb\rc", "a\nb\nc"),
        (tokens.jwt_algorithm(V), "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxIn0.abc", "HS256"), (tokens.jwt_algorithm(V), "a.b.c", None), (tokens.is_session_id(V), "abcdefghij0123456789", True),
        (tokens.token_type(V), "sk_live_" + "a" * 24, "stripe_key"), (tokens.tagged_hash(V), "a", "sha256:ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"),
        (context.score(V, F.lit(5), F.lit(16), "ssn"), "ssn: 517-29-8346", 0.85), (context.score(V, F.lit(3), F.lit(14), "ssn"), "no 517-29-8346", 0.5), (context.confidence(V), 0.75, "high"),
    ]


def test_values(one):
    found = [(str(c)[:200], v, e, got) for c, v, e in cases(F.col("v")) if (got := one(c, v=v)) != e]
    assert found == []


def test_geo(one):
    km = one(network.haversine(F.lit(52.52), F.lit(13.405), F.lit(48.8566), F.lit(2.3522)))
    assert abs(km - 877.5) < 2
    assert one(network.from_dms(network.dms(F.lit(-12.3456)))) == pytest.approx(-12.3456, abs=1e-5)
    assert 0 <= one(network.bearing(F.lit(10.0), F.lit(10.0), F.lit(-10.0), F.lit(-10.0))) < 360


def test_hashes_in_arrow(one):
    V = F.col("v")
    assert one(tokens.tagged_hash(V, "hmac-sha3-256", "k"), v="a").startswith("hmac-sha3-256:")
    with pytest.raises(ValueError):
        tokens.tagged_hash(V, "blake3")


def test_encrypt_binds_type(one):
    sealed = tokens.encrypt(F.col("v"), "k", F.lit("email"))
    assert one(tokens.decrypt(sealed, "k", F.lit("email")), v="x") == "x"
    assert one(tokens.decrypt(sealed, "k", F.lit("phone"), strict=False), v="x") is None
