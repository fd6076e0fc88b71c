"""URL filters: rules, and for urls without one the reputation of their host.

The share of bad pages of a host is estimated by empirical Bayes. Labelled outcomes are
counted by host, registered domain and suffix; each level has a beta prior whose mean is the
posterior mean of the level above and whose strength is fitted to all units of the level by
moments: with m the prior mean, x of n outcomes bad and r the correlation within a unit,
E[(x - n m)^2] = n m (1 - m) (1 + (n - 1) r), and the strength is 1 / r - 1. A host without
outcomes has its domain's prior, and so on up. A host is blocked if even the lower bound of its
posterior share is above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import fresh, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# suffixes of two labels under which domains are registered
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
                      "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
LIMIT, Z = 0.5, 1.645


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (host, path, verdict); both null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last one tried is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it, without user and port."""
    labels = F.split(F.regexp_replace(host, "^.*@|:[0-9]*$", ""), "\\.")
    n = F.when(F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".").isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(F.size(labels), n), 3), ".")


def suffix_of(domain: Column) -> Column:
    """What follows the first dot of a registered domain; empty if there is none."""
    return F.regexp_extract(domain, "^[^.]*\\.(.*)$", 1)


def _strength(units: DataFrame) -> float:
    """The prior's strength from all units (n, bad, mean): one aggregated row."""
    n, m = F.col("n"), F.col("mean")
    r = units.agg(F.sum((F.col("bad") - n * m) ** 2 - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("base")).first()
    rho = r.over / r.base if r.base else 0.0
    return 1 / min(max(rho, 1e-3), 0.9) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, z: float = Z, page_col: str = "page_id",
                    url_col: str = "url", outcome_page_col: str = "page_id", bad_col: str = "bad") -> DataFrame:
    """Per host of ``pages``: host, n and bad (labelled pages, bad ones), mean, low (the bound) and
    blocked. ``outcomes`` has one or several labels (true: bad) of some pages; several count as
    one that is bad if any is. Null labels, and labels of unknown pages, count for nothing.

    Outcomes are joined on narrow rows (page, host); hosts are pre-aggregated before their
    exchange, so a hot host is one row a task.
    """
    known = outcomes.where(F.col(bad_col).isNotNull()).groupBy(F.col(outcome_page_col).alias("page")).agg(
        F.max(F.col(bad_col).cast("int")).alias("bad"))
    rows = pages.select(F.col(page_col).alias("page"), host_of(url_col).alias("host")).join(known, "page", "left")
    hosts = rows.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))

    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(*counts).first()
    overall = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1)

    def posterior(units: DataFrame, of: str):
        m = _strength(units)
        return units.select(of, ((F.col("mean") * m + F.col("bad")) / (m + F.col("n"))).alias("mean"))

    suffixes = posterior(hosts.groupBy("suffix").agg(*counts).withColumn("mean", F.lit(overall)), "suffix")
    domains = posterior(hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix"), "domain")
    units = hosts.join(domains, "domain")
    m = _strength(units)
    a, b = F.col("mean") * m + F.col("bad"), (1 - F.col("mean")) * m + F.col("n") - F.col("bad")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    low = a / (a + b) - z * deviation
    return units.select("host", "n", "bad", (a / (a + b)).alias("mean"), low.alias("low"), (low > limit).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], page_col: str = "page_id",
               url_col: str = "url", **options) -> DataFrame:
    """Adds host, path, rule and verdict (``allow`` or ``block``) to every row of ``pages``, under names
    that are still free, in this order. Verdicts are the rule's, or else the host's; urls
    that are null or have no host have the empty host, judged like any other. Repeated rows are
    judged alike. The join on the host is Spark's to plan; AQE splits a hot host."""
    names = fresh(pages, "host", "path", "rule", "verdict")
    key, blocked = fresh(pages, "_key", "_blocked")
    hosts = host_reputation(pages, outcomes, page_col=page_col, url_col=url_col, **options).select(
        F.col("host").alias(key), F.col("blocked").alias(blocked))
    rows = pages.withColumns({names[0]: host_of(url_col), names[1]: path_of(url_col)})
    rule, verdict = rule_of(F.col(names[0]), F.col(names[1]), rules)
    rows = rows.join(hosts, F.col(names[0]) == F.col(key))
    return rows.select(*pages.columns, names[0], names[1], rule.alias(names[2]),
                       F.coalesce(verdict, F.when(F.col(blocked), "block").otherwise("allow")).alias(names[3]))


def allowed_pages(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], **options) -> DataFrame:
    """The rows of ``pages``, all columns, whose verdict is ``allow``."""
    judged = judge_urls(pages, outcomes, rules, **options)
    return judged.where(F.col(judged.columns[-1]) == "allow").select(*pages.columns)
