"""URL filter: host and path rules, and an empirical-Bayes reputation where no rule speaks.

Pages with a known outcome (by default the verdicts of the rules themselves) are counted by host.
The share of good pages is shrunk through beta-binomial priors: the suffix towards the whole table,
the registered domain towards its suffix, the host towards its domain. The strength of each prior
is estimated from the spread between the groups of that level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Second labels that make a two-label suffix under a country code.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


@dataclass(frozen=True)
class Prior:
    """A host is blocked if even the upper bound of its share of good pages is under ``threshold``."""

    threshold: float = 0.5
    z: float = 1.645
    default_strength: float = 10.0
    least_rho: float = 0.001
    most_rho: float = 0.999


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, AUTHORITY_PATH, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY_PATH, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    name = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    last, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    country = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(SECOND_LEVEL) & (two != name)
    return F.when(name.rlike(r"^[0-9.]+$"), F.lit("")).when(country, two).otherwise(last)


def domain_of(host: Column) -> Column:
    name = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    labels = F.when(suffix_of(host).contains("."), F.substring_index(name, ".", -3))
    return F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(
        F.coalesce(labels, F.substring_index(name, ".", -2))
    )


def rule_column(rules: Sequence[Rule], value: str) -> Column:
    """``value`` (target or verdict) of the longest rule that fits host and path, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r.target), -len(r.host), r.target))
    return F.coalesce(
        *[F.when(r.fits(F.col("host"), F.col("path")), F.lit(getattr(r, value))) for r in ranked],
        F.lit(None).cast("string"),
    )


def strength(groups: DataFrame, prior: Prior) -> DataFrame:
    """One row: the mean share ``p`` and the prior strength ``s`` by moments over the groups (n, good)."""
    labelled = groups.where(F.col("n") > 0)
    share = F.col("good") / F.col("n")
    sums = labelled.agg(
        F.count("*").alias("g"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * share * share).alias("q"),
    )
    p = F.coalesce(F.col("all_good") / F.col("all_n"), F.lit(0.5))
    spread = (F.col("q") - F.col("all_n") * p * p) / (p * (1 - p)) - (F.col("g") - 1)
    room = F.col("all_n") - F.col("n2") / F.col("all_n") - (F.col("g") - 1)
    rho = F.when((p > 0) & (p < 1) & (F.col("g") > 1) & (room > 1e-9), spread / room)
    rho = F.least(F.lit(prior.most_rho), F.greatest(F.lit(prior.least_rho), rho))
    s = F.when((p > 0) & (p < 1) & (F.col("g") > 1) & (room > 1e-9), 1 / rho - 1)
    return sums.select(p.alias("p"), F.coalesce(s, F.lit(prior.default_strength)).alias("s"))


def host_reputation(outcomes: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """host, n, good, mean, upper for every host of ``outcomes`` (host, n labelled pages, good ones).

    Every level sums up the level below it, so each page is counted once and moves once.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def scalar(groups: DataFrame, name: str) -> DataFrame:
        return strength(groups, prior).select(F.col("p").alias(f"p_{name}"), F.col("s").alias(f"s_{name}"))

    def shrunk(s: str, towards: Column) -> Column:
        return (F.col(s) * towards + F.col("good")) / (F.col(s) + F.col("n"))

    by_suffix = suffixes.join(F.broadcast(scalar(suffixes, "suffix"))).select(
        "suffix", shrunk("s_suffix", F.col("p_suffix")).alias("suffix_mean")
    )
    by_domain = (
        domains.join(by_suffix, "suffix").join(F.broadcast(scalar(domains, "domain")))
        .select("domain", "suffix", shrunk("s_domain", F.col("suffix_mean")).alias("domain_mean"))
    )
    by_host = hosts.join(by_domain, ["domain", "suffix"]).join(F.broadcast(scalar(hosts, "host")))
    mean = shrunk("s_host", F.col("domain_mean"))
    half = prior.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("s_host") + F.col("n") + 1))
    return by_host.withColumn("mean", mean).select("host", "n", "good", "mean", (F.col("mean") + half).alias("upper"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], prior: Prior = Prior(), outcomes: DataFrame | None = None
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``outcomes`` holds labelled pages (url, good: 1 or 0); without it the pages that a rule decides
    are the labelled ones. A null URL or one without ``://`` has an empty host and path and is judged
    like an unknown host. A table without any labelled page blocks nothing. Every row is kept,
    repeated or not, and columns of the input named like a new one are replaced. Rules are written
    into the plan, a list a person keeps; their number does not depend on the data.
    """
    split = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    ruled = split.withColumns({"rule": rule_column(rules, "target"), "verdict": rule_column(rules, "verdict")})
    known = F.col("verdict").isNotNull()
    seen = ruled.select("host", known.cast("long").alias("n"), F.coalesce((F.col("verdict") == "allow").cast("long"), F.lit(0)).alias("good"))
    if outcomes is not None:
        labelled = outcomes.where(F.col("good").isNotNull()).select(
            url_host(F.col("url")).alias("host"), F.lit(1).cast("long").alias("n"), F.col("good").cast("long").alias("good")
        )
        seen = ruled.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good")).unionAll(labelled)
    judged = host_reputation(seen, prior).select(
        "host", F.when(F.col("upper") < prior.threshold, "block").otherwise("allow").alias("_judged")
    )
    return (
        ruled.join(judged, "host", "left")
        .withColumn("verdict", F.coalesce("verdict", "_judged"))
        .drop("_judged")
    )
