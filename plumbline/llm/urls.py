"""URL filter: explicit rules first, then the reputation of the host.

The reputation is an empirical-Bayes estimate of the share of bad pages.  Labelled
outcomes are counted per host.  Going down from public suffix to registered domain
to host, every level's counts are shrunk towards the level above by a beta-binomial
prior whose strength comes from the data by the method of moments.  A host is blocked
when even the lower bound of its posterior lies above the tolerated share.

All work is done with DataFrame functions.  Pages meet outcomes in one narrow join and
are then counted per host with map-side combine, so a host that holds a third of all
pages is no hot group; the table of hosts is written once and read by all levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_summary, stored
from .common import ascii_lower

#: Public suffixes of two labels; every other suffix is taken to have one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "or.jp", "com.au",
                      "net.au", "org.au", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.za")


@dataclass(frozen=True)
class Rule:
    """An explicit verdict for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """A field of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def site_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; user and port are left out."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    has_two = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(has_two, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(has_two, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(level: DataFrame, mean: str, rate: float) -> float:
    """Prior strength of a level, one number: how little its units differ beyond chance.

    With intra-unit correlation r, the expected sum of n (p - m)^2 over k units of N
    outcomes is m (1 - m) (k + (N - k) r); the strength is 1 / r - 1.
    """
    some = level.filter("n > 0")
    n, k = F.sum("n"), F.count(F.lit(1))
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(mean), 2))
    top = F.lit(rate)
    r = F.try_divide(F.try_divide(spread, top * (1 - top)) - k, n - k)
    r = F.least(F.greatest(F.coalesce(r, F.lit(0.01)), F.lit(0.01)), F.lit(0.99))
    return some.agg((1 / r - 1).alias("s")).first()[0]


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host: n, bad, posterior mean and lower bound of its share of bad pages.

    ``pages`` holds page_id and host, ``outcomes`` page_id and a boolean bad.  Several
    outcomes of one page count as one, bad if any is.  Null outcomes count as not
    labelled.  A host without outcomes has the posterior of its domain; without any
    outcome at all the mean is one tenth.
    """
    known = (outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL")
             .groupBy("page_id").agg(F.max("bad").alias("bad")))
    counted = (pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
               .agg(F.count("bad").alias("n"), F.count_if(F.col("bad")).alias("bad")))
    domain, suffix = site_of(F.col("host"))
    hosts = stored(counted.withColumn("domain", domain).withColumn("suffix", suffix))
    rate = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5)
                      / (F.coalesce(F.sum("n"), F.lit(0)) + 5.0)).alias("rate")).first()[0]

    # Each level is written once; besides it only one number goes on to the next.
    suffixes = stored(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
                      .withColumn("top", F.lit(rate)))
    k = _strength(suffixes, "top", rate)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("top"))
                                          / (F.col("n") + k)).alias("suffix_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = stored(join_summary(domains, suffixes, ["suffix"], "inner"))
    k = _strength(domains, "suffix_mean", rate)
    domains = domains.select("domain", "suffix", ((F.col("bad") + k * F.col("suffix_mean"))
                                                  / (F.col("n") + k)).alias("domain_mean"))
    joined = stored(join_summary(hosts, domains, ["domain", "suffix"], "inner"))
    k = _strength(joined, "domain_mean", rate)
    a = F.col("bad") + k * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + k * (1 - F.col("domain_mean"))
    return (joined.select("host", "n", "bad", a.alias("a"), b.alias("b"))
            .withColumn("mean", F.expr("a / (a + b)"))
            .withColumn("low", F.expr(f"mean - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"))
            .select("host", "n", "bad", "mean", "low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (),
                max_bad: float = 0.25, z: float = 1.645) -> DataFrame:
    """Judge every page's url by rule, else by the reputation of its host.

    Returns page_id, host, path, rule, verdict, bad_mean, bad_low.  A null url or one
    without ``://`` has an empty host and path; all such pages share one reputation.
    Repeated rows are judged alike, null page ids keep their row, columns of ``pages``
    other than page_id and url are not looked at, no pages give no rows.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    known = host_reputation(seen, outcomes, z).select(
        "host", F.col("mean").alias("bad_mean"), F.col("low").alias("bad_low"))
    # A host may have any share of the pages.
    judged = join_summary(seen, known, ["host"])
    method = F.when(F.col("bad_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    host, path = F.col("host"), F.col("path")
    return judged.select(
        "page_id", "host", "path", rule_for(host, path, rules, "name").alias("rule"),
        F.coalesce(rule_for(host, path, rules, "verdict"), method).alias("verdict"),
        "bad_mean", "bad_low")
