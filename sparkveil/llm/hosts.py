"""URL filters: allow and block rules, and empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host. A host's rate of good pages is shrunk through beta-binomial
priors: the host towards its registered domain, the domain towards its suffix, the suffix towards the
whole. The strength of each prior is estimated from the counts (moments of the beta-binomial). A host is
blocked when even the upper bound of its posterior rate stays below a share of the whole's rate: what is wanted
follows from the table, so a corpus of poor pages isn't blocked as a whole.

Everything here is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which country suffixes register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@dataclass(frozen=True)
class Params:
    """min_share: wanted rate of good pages, as a share of the whole's; sigmas: width of the posterior bound in standard deviations;
    min_strength, max_strength: range of a prior's weight in pages."""

    min_share: float = 0.9
    sigmas: float = 1.0
    min_strength: float = 0.5
    max_strength: float = 1000.0


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): the host lies after the first `://`, up to `/`, `?`, `#` or the end, with A-Z
    lowered; the path goes on up to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule `domain/path` fits the domain and
    all its subdomains where the url's path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, tail = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def levels(host: F.Column) -> tuple[F.Column, F.Column]:
    """(registered domain, suffix): the suffix is the last label, or the last two where the country's
    second level registers names; the domain has one label more. Numeric hosts are their own domain."""
    name = F.regexp_replace(host, r":\d*$", "")
    second = F.regexp_extract(name, r"([^.]+)\.[^.]{2}$", 1)
    labels = F.when(second.isin(*SECOND_LEVEL), 2).otherwise(1)
    number = name.rlike(r"^[\d.]+$|^\[")
    domain = F.when(number, name).otherwise(F.when(labels == 2, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2)))
    suffix = F.when(number, F.lit("")).otherwise(F.when(labels == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)))
    return domain, suffix


def _strength(children: DataFrame, parent: list[str], p: Params) -> float:
    """Prior weight of one level: rows of `children` are (parent..., n, k). The spread of the children's
    rates within their parents, beyond what chance gives, sets the intraclass correlation r of the
    beta-binomial; the weight is (1 - r) / r. One aggregate row reaches the driver."""
    n, k = F.col("n"), F.col("k")
    sums = children.groupBy(*parent).agg(
        F.sum(n).alias("N"), F.sum(k).alias("K"), F.count("*").alias("g"),
        F.sum((n * n).cast("double")).alias("nn"), F.sum((k * k).cast("double") / n).alias("kk"),
    )
    rate = F.col("K") / F.col("N")
    mixed = sums.where((F.col("K") > 0) & (F.col("K") < F.col("N")) & (F.col("g") > 1))
    spread = (F.col("kk") - F.col("K") * rate) / (rate * (1 - rate)) - (F.col("g") - 1)
    room = F.col("N") - F.col("nn") / F.col("N") - (F.col("g") - 1)
    top = mixed.agg(F.sum(spread), F.sum(room)).first()
    if top[0] is None or top[1] <= 0 or top[0] <= 0:
        return p.max_strength
    r = min(top[0] / top[1], 0.999)
    return min(max(round((1 - r) / r, 6), p.min_strength), p.max_strength)


def reputations(outcomes: DataFrame, p: Params = Params()) -> DataFrame:
    """Posterior of every host of `outcomes` (host, good boolean): host, n, k, posterior_mean,
    posterior_upper, bad; n and k count pages and good pages, bad says that the bound is too low.

    Null outcomes don't count. Each level's mean is shrunk towards its parent's shrunk mean.
    """
    hosts = outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    domain, suffix = levels(F.col("host"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    whole = (total[1] / total[0]) if total[0] else 0.5
    s_suffix = _strength(suffixes, [], p)
    s_domain = _strength(domains, ["suffix"], p)
    s_host = _strength(hosts, ["suffix", "domain"], p)
    shrunk = lambda mean, s: (F.col("k") + s * mean) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", shrunk(F.lit(whole), s_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(F.col("suffix_mean"), s_domain).alias("domain_mean"))
    alpha = F.col("k") + s_host * F.col("domain_mean")
    beta = F.col("n") - F.col("k") + s_host * (1 - F.col("domain_mean"))
    mean, size = alpha / (alpha + beta), alpha + beta
    found = hosts.join(domains, ["suffix", "domain"]).select(
        "host", "n", "k",
        F.round(mean, 6).alias("posterior_mean"),
        F.round(F.least(F.lit(1.0), mean + p.sigmas * F.sqrt(mean * (1 - mean) / (size + 1))), 6).alias("posterior_upper"),
    )
    return found.withColumn("bad", F.col("posterior_upper") < F.lit(round(p.min_share * whole, 6)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, p: Params = Params(), key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, n_labelled, posterior_mean, posterior_upper.

    `outcomes` has (host, good). The longest fitting rule decides; else the pages of bad hosts (see `reputations`) are
    blocked and all others allowed, those of hosts without outcomes too. Null urls have an empty host. Repeated rows repeat. The reputations are written first, so
    that the join meets two plain exchanges and a hot host's pages can be split. Rules that fit equally long: the first. An empty
    table gives no rows. Columns beside key and url may have any name and are not kept.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(f"`{key}`"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": ruled})
    known = materialize(reputations(outcomes, p), "reputations")
    found = judged.join(known, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return found.select(key, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_labelled"), "posterior_mean", "posterior_upper")


def page_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(host, good) of the pages whose path names a labelled document (`/<number>`): good is quality 1
    and not toxic. A document with several labels is good if all are; pages without a label drop."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    marks = materialize(marks, "marks")
    host, path = url_parts(F.col(f"`{url}`"))
    named = pages.select(host.alias("host"), path.alias("_path")).select("host", F.regexp_extract("_path", r"/([0-9]+)", 1).try_cast("bigint").alias("doc_id"))
    return named.where(F.col("doc_id").isNotNull()).join(marks, "doc_id").select("host", "good")

